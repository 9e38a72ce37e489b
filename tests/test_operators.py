"""Generic operators against plain Python on small inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from azanami.operators import order, prefix, stats
from azanami.operators.knn import nearest_stations
from azanami.operators.near import containing_regions, pairs_within
from azanami.operators.skew import attach_by_key, codes_by_table, heavy_codes, join_salted
from azanami.operators.small import join_small
from azanami.plans import quality


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def near_brute(p, s, r):
    def ok(x):
        return x[1] is not None and x[2] is not None and 20 <= x[1] <= 46 and 122 <= x[2] <= 154

    return sorted((a[0], b[0]) for a in p for b in s if ok(a) and ok(b) and metres(a[1], a[2], b[1], b[2]) <= r)


def test_pairs_within(spark):
    rnd = random.Random(3)
    spot = lambda: (rnd.choice([35.0, 20.0, 45.999]) + rnd.random() * 0.02, rnd.choice([139.0, 122.0]) + rnd.random() * 0.02)
    p = [(i, *spot()) for i in range(150)] + [(900 + i, 35.01, 139.01) for i in range(40)] + [(990, None, 139.0), (991, 0.0, 0.0), (992, 139.0, 35.0), (993, float("nan"), 139.0), (901, 35.01, 139.01)]
    s = [(i, *spot()) for i in range(120)] + [(500, 35.01, 139.01), (501, 35.01, 139.01), (502, None, None)]
    pd = spark.createDataFrame([(*x, "p") for x in p], "pid long, lat double, lng double, s_lat string")
    sd = spark.createDataFrame([(*x, 1) for x in s], "sid long, lat double, lng double, p_lat int")
    for r in (250.0, 2500.0):
        got = sorted((x.pid, x.sid) for x in pairs_within(pd, "pid", sd, "sid", r).collect())
        assert got == near_brute([x for x in p if not (x[1] is not None and x[1] != x[1])], s, r)
    assert pairs_within(pd.limit(0), "pid", sd, "sid").count() == 0 and pairs_within(pd, "pid", sd.limit(0), "sid").count() == 0


def inside(y, x, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a <= y) != (c <= y) and b + (d - b) * (y - a) / (c - a) <= x:
                odd = not odd
    return odd


def test_containing_regions(spark):
    rnd = random.Random(31)

    def star(y, x, r, n):
        return [(y + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n), x + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]

    regions = [(f"s{i}", [star(35 + rnd.random(), 139 + rnd.random(), rnd.choice([0.02, 0.3, 2.0]), rnd.randint(3, 40))]) for i in range(12)]
    regions += [("hole", [[(35.0, 139.0), (35.0, 141.0), (37.0, 141.0), (37.0, 139.0)], [(35.5, 139.5), (36.5, 139.5), (36.5, 140.5), (35.5, 140.5)]]), ("flat", [[(35.0, 139.0), (35.0, 140.0), (35.0, 141.0)]])]
    odd = [("none", None), ("short", [[(35.0, 139.0), (36.0, 140.0)]]), (None, regions[0][1]), ("nan", [[(float("nan"), 139.0), (36.0, 140.0), (36.0, 139.0)]])]
    points = [(i, rnd.uniform(34, 38), rnd.uniform(138, 142)) for i in range(250)] + [(500 + i, 35.2, 139.2) for i in range(60)] + [(900, None, 139.0), (901, float("inf"), 139.0)]
    pd = spark.createDataFrame([(*p, "n") for p in points], "pid long, lat double, lng double, name string")
    rd = spark.createDataFrame(regions + odd, "rid string, rings array<array<struct<lat:double,lng:double>>>")
    want = sorted((i, n) for i, y, x in points if y and y < 90 for n, rings in regions if inside(y, x, rings))
    assert sorted(map(tuple, containing_regions(pd, "pid", rd, "rid").collect())) == want and len(want) > 100
    assert sorted(map(tuple, containing_regions(pd, "pid", rd, "rid", height=0.7, slices=5, few=3).collect())) == want
    assert containing_regions(pd, "pid", rd.limit(0), "rid").count() == containing_regions(pd.limit(0), "pid", rd, "rid").count() == 0


def test_busy_tiles_are_divided(spark):
    rnd = random.Random(32)
    spot = lambda: (35 + rnd.random() * 0.004, 139 + rnd.random() * 0.004)
    p, s = [(i, *spot()) for i in range(120)], [(i, *spot()) for i in range(90)]
    pd, sd = spark.createDataFrame(p, "pid long, lat double, lng double"), spark.createDataFrame(s, "sid long, lat double, lng double")
    got = sorted(map(tuple, pairs_within(pd, "pid", sd, "sid", 150.0, slices=4, few=5).collect()))
    assert got == near_brute(p, s, 150.0) and len(got) > 500


def test_heavy_keys_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", None) for i in range(3000)] + [(9999, None, None)]
    df = spark.createDataFrame(rows, "i long, k string, n2 string")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = attach_by_key(df, per, "k", "n", slices=10, small=0).select("i", "first").collect()
    first = {}
    for i, k, _ in rows:
        first.setdefault(k, i)
    assert sorted(map(tuple, got)) == sorted((i, first[k]) for i, k, _ in rows if k)
    assert sorted(map(tuple, attach_by_key(df, per, "k", "n").select("i", "first").collect())) == sorted(map(tuple, got))
    other = spark.createDataFrame([("hot", x) for x in range(3)] + [("k3", 7)], "k string, x int")
    got = join_salted(df.select("i", "k"), other, ["k"], per.select("k", "n"), "n", "i", slices=10).count()
    assert got == 3 * sum(r[1] == "hot" for r in rows) + sum(r[1] == "k3" for r in rows)


def test_codes(spark):
    vals = ["061298"] * 30 + [" 061298", "06129-8", "０６１２９８", "6129８", None, "", "x" * 5000] + [f"0{i:05d}" for i in range(60)]
    df = spark.createDataFrame([(v, "t") for v in vals], "code string, n_rows string")
    got = {(r.src_table, r.code): (r.n_rows, r.n_all) for r in codes_by_table({"a": (df, "code"), "b": (df.limit(0), "code")}).collect()}
    assert got[("a", "061298")] == (33, len(vals)) and got[("a", None)] == (4, len(vals)) and not any(k[0] == "b" for k in got)
    assert [r.code for r in heavy_codes({"a": (df, "code")}).collect()] == ["061298"]


def test_small_join_falls_back(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    assert join_small(a, b, "k", bound=2).count() == join_small(a, b, "k").count() == 5


def test_prefix_hits(spark):
    texts = ["一番町一丁目", "一番", "", None, "二番町"]
    keys = ["一番", "一番町", "二", "", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    got = sorted((r.t, r.key, r.rest) for r in prefix.prefix_hits(t, "t", k).collect())
    assert got == sorted((x, y, x[len(y):]) for x in texts if x for y in keys if y and x.startswith(y))
    best = {r.t: r.key for r in prefix.longest_prefix(t, ["t"], "t", k, [F.asc("key")]).collect()}
    assert best == {"一番町一丁目": "一番町", "一番": "一番", "二番町": "二"}
    assert prefix.prefix_hits(t, "t", k.limit(0)).count() == 0


def test_guard(spark):
    t = spark.createDataFrame([("太子堂50番地",), ("太子堂5-1",)], "t string")
    k = spark.createDataFrame([("太子堂5", "nodigit"), ("太子堂", None)], "key string, guard string")
    got = {r.t: r.key for r in prefix.longest_prefix(t, ["t"], "t", k, [F.asc("key")], guard="guard").collect()}
    assert got == {"太子堂50番地": "太子堂", "太子堂5-1": "太子堂5"}


def axes_brute(texts, keys):
    """The best entry by axis of each text: what the SQL of longest_on_axes says, row by row."""
    def low(x):
        return x and x.replace("が", "か").replace("だ", "た")
    want = {}
    for i, tk, tr in texts:
        best = None
        for o, k, r, g in keys:
            if k and tk and tk.startswith(k) and not (g == "nodigit" and tk[len(k):][:1].isdigit()):
                hit = (len(k), 3, "key", tk[len(k):])
            elif r and tr and tr.startswith(r):
                hit = (len(r), 2, "kana", tr[len(r):])
            elif r and tr and low(tr).startswith(low(r)):
                hit = (len(r), 1, "loose", low(tr)[len(r):])
            else:
                continue
            if best is None or (hit[:2], o is not None, -(o or 0)) > (best[1][:2], best[0] is not None, -(best[0] or 0)):
                best = (o, hit)
        if best:
            want[i] = (best[0], best[1][2], best[1][0], best[1][3])
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_on_axes(spark, seed):
    rnd = random.Random(seed)
    some = lambda letters, low, high: rnd.choice([None, "", *["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(12)]])
    # Few readings with many entries each, most of which hit by spelling too; entries without an id; equal entries.
    keys = [(rnd.choice([None, *range(900)]) if rnd.random() < 0.1 else 1000 - j, some("町1", 1, 4), some("かがた", 1, 3), rnd.choice([None, "nodigit", "other"])) for j in range(120 if seed < 3 else 12)]
    texts = [(i, some("町12", 0, 6), some("かがただ", 0, 5)) for i in range(300)]
    t = spark.createDataFrame(texts, "id long, key string, kana string")
    k = spark.createDataFrame(keys + keys[:20], "o long, key string, kana string, guard string")
    got = prefix.longest_on_axes(t, "id", k, "o").collect()
    assert {r.id: (r.o, r.axis, r.matched, r.rest) for r in got} == axes_brute(texts, keys) and len(got) == len({r.id for r in got})
    assert {(r.axis, r.score) for r in got} <= set(prefix.AXES.items())
    assert prefix.longest_on_axes(t, "id", k.limit(0), "o").count() == 0


def test_longest_on_axes_sends_no_dictionary(spark, tmp_path):
    """Neither a dictionary nor cut texts are broadcast, which Spark takes for as small as their files; entries of one reading don't multiply its texts."""
    t = spark.createDataFrame([(i, f"町{i}", "かた") for i in range(200)], "id long, key string, kana string")
    k = spark.createDataFrame([(i, f"字{i}", "か", None) for i in range(300)], "o long, key string, kana string, guard string")
    t.write.parquet(f"{tmp_path}/t")
    k.write.parquet(f"{tmp_path}/k")
    t, k = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/k")
    plan = prefix.longest_on_axes(t, "id", k, "o")._jdf.queryExecution().sparkPlan().toString()
    assert [plan.count(f"SortMergeJoin [{c}#") for c in ("k_key", "_loose")] == [1, 1]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = prefix.longest_on_axes(t, "id", k, "o")
        assert {(r.o, r.axis, r.matched) for r in out.collect()} == {(0, "kana", 1)} and out.count() == 200
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_prefix(spark):
    rnd = random.Random(5)
    keys = list({"".join(rnd.choice("abc1") for _ in range(rnd.randint(2, 6))) for _ in range(40)})
    texts = list({"".join(rnd.choice("abc1") for _ in range(rnd.randint(0, 9))) for _ in range(60)})
    import re

    want = set()
    for t, k in itertools.product(texts, keys):
        if len(k) <= 3 or t.startswith(k):
            continue
        used = [u for u in (len(k) - 1, len(k), len(k) + 1) if 0 < u <= len(t) and edits(t[:u], k) == 1 and re.findall(r"\d+", t[:u]) == re.findall(r"\d+", k)]
        if used:
            want.add((t, k, t[max(used):]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kd = spark.createDataFrame([(k, k) for k in keys], "key string, by string")
    assert {(r.t, r.key, r.rest) for r in prefix.fuzzy_prefix(df, "t", kd, "by", limit=None).collect()} == want
    df = spark.createDataFrame([("世田ケ谷区太子堂5-5-5",)], "t string")
    kd = spark.createDataFrame([("世田谷区", "1"), ("世田谷", "2")], "key string, by string")
    assert [(r.key, r.rest) for r in prefix.fuzzy_prefix(df, "t", kd, "by").collect()] == [("世田谷区", "太子堂5-5-5")]


def test_order_operators(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice("xyz"), i, rnd.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v string, o long, n int")
    first, last = {}, {}
    for k, v, o, n in rows:
        first.setdefault(k, v)
        last[k] = v
    assert {r.k: r.v for r in order.first_wins(df, ["k"], "o").collect()} == first
    assert {r.k: r.v for r in order.last_wins(df, ["k"], "o").collect()} == last
    ties = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", "x", 3), ("a", "y", 4)], "k string, v string, o long")
    assert order.mode_by(ties, ["k"], "v", "o").first().v == "y"
    enc = order.delta_encode(df, ["k"], ["o"], ["n"])
    assert sorted(map(tuple, order.delta_decode(enc, ["k"], ["o"], ["n"]).select("k", "o", "n").collect())) == sorted((k, o, n) for k, _, o, n in rows)


def test_shards(spark):
    keys = [f"k{i:04d}" for i in range(95)]
    df = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "key string")
    b = {r.shard: (r.bound, r.n) for r in order.shard_bounds(df, "key", 20).collect()}
    assert b == {i: (keys[i * 20], min(20, 95 - i * 20)) for i in range(5)}
    bounds = spark.createDataFrame([(0, "b"), (1, "d"), (2, "f")], "shard long, bound string")
    texts = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "f", "z")], "t string")
    assert {r.t: r.shard for r in order.as_of_shard(texts, "t", bounds).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 2, "z": 2}


def test_greedy_parts(spark):
    df = spark.createDataFrame([("c", f"i{i}", w) for i, w in enumerate([4, 4, 4, 11, 1, 9])], "c string, i string, w long")
    assert [r.part for r in order.greedy_parts(df, "c", "i", "w", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]


def test_stats(spark):
    rnd = random.Random(2)
    vals = [rnd.random() * 100 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    h = stats.histogram(df, [], "v", 5.0, 10)
    assert {r.bucket: r.n for r in h.collect()} == {b: sum(min(int(v // 5), 10) == b for v in vals) for b in range(11)}
    g = df.withColumn("g", F.lit(1))
    q = stats.index_quantile(g, ["g"], "v", {"p50": 0.5, "p100": 1.0}).first()
    s = sorted(vals)
    assert (q.p50, q.p100) == (s[250], s[-1])
    hq = stats.histogram_quantile(stats.histogram(g, ["g"], "v", 5.0, 10), ["g"], 5.0, {"m": 0.5}).first().m
    assert hq == next(b * 5.0 for b in range(11) if sum(min(int(v // 5), 10) <= b for v in vals) >= 250)


@pytest.mark.parametrize("grouped", [False, True])
def test_nearest(spark, grouped):
    rnd = random.Random(4)
    s = [(i, i // 2, rnd.uniform(30, 40), rnd.uniform(130, 140), i) for i in range(80)] + [(900, 900, None, 1.0, 900)]
    p = [(i, rnd.uniform(25, 45), rnd.uniform(125, 145)) for i in range(25)] + [(100, -60.0, -179.0), (101, None, 1.0), (102, float("nan"), 1.0), (103, 89.9, 179.9)]
    pd, sd = spark.createDataFrame(p, "id long, lat double, lng double"), spark.createDataFrame(s, "code int, group_code int, lat double, lng double, ord int")
    got = {(r.id, r["rank"]): r.code for r in nearest_stations(pd, "id", sd, 3, grouped).collect()}
    want = {}
    for i, a, b in p:
        if a is None or a != a:
            continue
        seen, n = set(), 0
        for d, o, c, g in sorted((metres(a, b, y, x), o, c, g) for c, g, y, x, o in s if y is not None):
            if grouped and g in seen:
                continue
            seen.add(g)
            n += 1
            if n <= 3:
                want[(i, n)] = c
    assert got == want
    assert nearest_stations(pd, "id", sd, 0).count() == 0


def test_spread_and_gates(spark):
    rnd = random.Random(6)
    pts = [(rnd.choice("ab"), 35 + rnd.random(), 139 + rnd.random()) for _ in range(60)] + [("c", 35.0, 139.0), ("d", None, None)]
    got = {r.k: r.spread_m for r in quality.group_spread(spark.createDataFrame(pts, "k string, lat double, lng double"), ["k"], 3).collect()}
    for k in "abc":
        own = [(y, x) for g, y, x in pts if g == k]
        assert abs(got[k] - max(metres(*a, *b) for a in own for b in own)) < 1e-3
    now = spark.createDataFrame([("a", "coverage", 80.0), ("b", "count", 98.0), ("c", "median", 10.0), ("d", "outliers", 130.0), ("e", "count", 5.0)], "metric string, kind string, value double")
    old = spark.createDataFrame([("a", 80.4), ("b", 100.0), ("c", 9.0), ("d", 100.0)], "metric string, value double")
    assert {r.metric: r.ok for r in quality.regression_gate(now, old).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}
