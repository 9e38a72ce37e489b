"""Record parsing, files, builders, directory."""

import csv
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from azanami.fixtures import gazetteer
from azanami.plans import build, directory
from azanami.schemas import SOURCES, text_schema
from azanami.sources import files, records


def brute(line):
    """One character at a time."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, out = i + 1, ""
            while True:
                if j >= n:
                    return None
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        out += '"'
                        j += 2
                        continue
                    break
                out += line[j]
                j += 1
            j += 1
            if j < n and line[j] != ",":
                return None
        else:
            j = i
            while j < n and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            out = line[i:j]
        fields.append(out)
        if j >= n:
            return fields
        i = j + 1


def test_tokenizer_random():
    rnd = random.Random(9)
    lines = ["".join(rnd.choice('a,"町\n') for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    lines += ['"' + "x" * 5000 + '"' + ",y" * 300, ",".join(["町" * 100] * 20), "", '""', '"', '"a"b', 'a"b']
    broken, n, rows = records.tokenize([x.encode() for x in lines])
    for line, b, k, r in zip(lines, broken, n, rows):
        want = brute(line)
        assert r == want and (b >= 0) == (want is None), line
        if want is not None:
            assert k == len(want)


def test_pieces_compose():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 3, size=(1, 40)).astype(np.uint8)
    whole = records.chunk_function(c)
    for cut in range(1, 40):
        assert (records.compose(records.chunk_function(c[:, :cut]), records.chunk_function(c[:, cut:])) == whole).all()


def test_offsets_of_reasons(spark):
    good = "011002,0001000,大町,オオマチ,一丁目,1,2020-01-01,"
    cases = {1: (good, None, None), 2: (good + ",x", "column_count", len((good + ",").encode())), 3: ("011002,1", "column_count", 8), 4: ('011002,"00', "quoting", 10), 5: ('011002,"00"x,', "quoting", 11),
             6: (good.replace("大町", '大"町'), "quoting", 18), 7: ("9" + good[1:], "lg_code", 0), 8: (good.replace("011002", '"011002"').replace("0001000", "x"), "machiaza_id", 9), 9: (None, "column_count", 0)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "line_id long, raw string")
    rows = records.parse_records(df, "line_id", "raw", types={"efct_date": "date", "rsdt_addr_flg": "int"}).collect()
    assert {r.line_id: (r.reason, r.reason_offset) for r in rows} == {k: v[1:] for k, v in cases.items()}
    first = next(r for r in rows if r.line_id == 1)
    assert (str(first.efct_date), first.rsdt_addr_flg) == ("2020-01-01", 1)


def whole_file_records(data):
    """Records of a file one byte after the other."""
    out, begin, state = [], 0, records.START
    for i, c in enumerate(data):
        if c == 10 and state != records.QUOTED:
            out.append((begin, data[begin:i].decode()))
            begin, state = i + 1, records.START
        else:
            state = records.STEP[records.CLASS[c], state]
    return out + ([(begin, data[begin:].decode().removesuffix("\n"))] if begin < len(data) else [])


def test_records_of_a_cut_file(spark, tmp_path):
    rnd = random.Random(21)
    piece = lambda: rnd.choice(["a", "町", ",", '"', '""', "\n", 'x,"b\nc\n\nd"\n', "plain,line\n", '"open\r\n'])
    texts = ["".join(piece() for _ in range(rnd.randint(0, 200))).encode() for _ in range(4)] + [b"", b'"' + b"y\n" * 300 + b'",z\nlast']
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("170", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.file.rsplit("/", 1)[-1], r.offset, r.raw) for r in records.read_records(spark, str(tmp_path)).collect())
        assert got == sorted((f"f{i}.csv", at, raw) for i, t in enumerate(texts) for at, raw in whole_file_records(t))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_parse_records(spark):
    good = "011002,0001000,大町,オオマチ,一丁目,1,2020-01-01,"
    assert records.check_digit_ok("011002")
    cases = {1: (good, None), 2: (good + "\r", None), 3: (good + ",x", "column_count"), 4: ('011002,"0001000,大町', "quoting"), 5: (good.replace("011002", "011003"), "lg_code"),
             6: (good.replace("0001000", "001000"), "machiaza_id"), 7: (None, "column_count"), 8: ("", "column_count"), 9: (good.replace("大町", '"大,""町\n"'), None), 10: (good.replace("大町", 'x"y'), "quoting"),
             11: (good.replace("011002", " 011002"), "lg_code"), 12: (good.replace("011002", "481009"), "lg_code"), 13: (good.replace("大町", "長" * 100_000), None)}
    df = spark.createDataFrame([(i, r, "x", "y") for i, (r, _) in cases.items()] + [(None, good, "", "")], "line_id long, raw string, reason string, note string")
    got = {r.line_id: r for r in records.parse_records(df, "line_id", "raw").collect()}
    assert {i: got[i].reason for i in cases} == {i: w for i, (_, w) in cases.items()}
    assert got[9].oaza_cho == '大,"町\n' and got[2].note == "" and got[10].reason_offset == 16 and None in got
    assert records.parse_records(df.limit(0), "line_id", "raw").count() == 0


def test_zip_csv(spark, tmp_path):
    for name, enc in (("mt_town_pref13.csv.zip", "utf-8"), ("old.zip", "cp932")):
        text = io.StringIO()
        w = csv.writer(text)
        w.writerows([["lg_code", "name", "more"], ["131016", '高"①\n,町', "1"], [], ["131024"]])
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.csv", text.getvalue().encode(enc))
    df = files.read_zip_csv(spark, str(tmp_path / "mt_town_pref13.csv.zip"), text_schema("name", "lg_code", "none"))
    assert [(r.lg_code, r.name, r.none) for r in df.orderBy("lg_code").collect()] == [("131016", '高"①\n,町', ""), ("131024", "", "")]
    assert files.with_file_part(df, r"pref(\d+)").select("part").distinct().first().part == "13"
    old = files.read_zip_csv(spark, str(tmp_path / "old.zip"), text_schema("a", "b"), "cp932", positional=True)
    assert {r.b for r in old.collect()} == {'高"①\n,町', ""}
    assert files.latest(spark, str(tmp_path), "mt_town").endswith("mt_town_pref13.csv.zip") and files.latest(spark, str(tmp_path), "zz") is None


def test_plain_csv_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a,b"\n2,\n')
    assert [(r.y, r.z) for r in files.read_csv(spark, str(tmp_path / "a.csv"), text_schema("y", "z")).collect()] == [("a,b", ""), ("", "")]
    assert files.read_plain_split(spark, str(tmp_path / "a.csv"), text_schema("y")).first().y == '"a'
    df = spark.range(100).select(F.format_string("k%03d", "id").alias("key"), (F.col("id") % 3).alias("lg"))
    files.write_by_key(df, str(tmp_path / "t"), "key", 40)
    files.write_by_key(df, str(tmp_path / "t"), "key", 40)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    files.write_parts(df, str(tmp_path / "p"), "lg", ["key"], 10)
    assert spark.read.parquet(str(tmp_path / "p")).where("lg = 1").count() == 33
    files.write_json(df.limit(1), str(tmp_path / "j"))
    files.append_metrics(df.limit(1), str(tmp_path / "m"))
    files.append_metrics(df.limit(1), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert files.read_or_empty(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_rail_document(spark):
    doc = '{"lines":[{"code":1,"name":"L","company":"C"}],"stations":[[10,10,"S",1,13,"1000001","addr",35.1,139.2],[11,11,"T",9,13,"","",35.2,139.3]]}'
    lines, st = files.decode_rail(spark.createDataFrame([(doc,)], "d string"), "d")
    assert lines.count() == 1 and [(r.code, r.line_name, r.lat) for r in st.orderBy("ord").collect()] == [(10, "L", 35.1), (11, "", 35.2)]


def src(spark, name, rows):
    cols = SOURCES[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(c, "") for c in cols) for r in rows], SOURCES[name])


def test_build_cities(spark):
    c = build.build_cities(
        src(spark, "mt_pref", [{"lg_code": "140007", "pref": "神奈川県", "pref_kana": "カナガワケン"}, {"lg_code": "990007", "pref": "旧県", "ablt_date": "1990-01-01"}]),
        src(spark, "mt_pref_pos", [{"lg_code": "140007", "rep_lat": "35.4", "rep_lon": "139.6"}]),
        src(spark, "mt_city", [{"lg_code": "141003", "pref": "神奈川県", "city": "横浜市", "city_kana": "ヨコハマシ"}, {"lg_code": "141011", "pref": "神奈川県", "city": "横浜市", "city_kana": "ヨコハマシ", "ward": "鶴見区", "ward_kana": "ツルミク"}, {"lg_code": "143014", "pref": "神奈川県", "county": "三浦郡", "county_kana": "ミウラグン", "city": "葉山町", "city_kana": "ハヤママチ"}]),
        src(spark, "mt_city_pos", [{"lg_code": "141011", "rep_lat": "", "rep_lon": "1"}, {"lg_code": "143014", "rep_lat": "35.2", "rep_lon": "139.5"}]),
        src(spark, "mt_town", [{"lg_code": "141011"}] * 3))
    got = {r.code: r for r in c.collect()}
    assert set(got) == {"14", "141003", "141011", "143014"}
    assert (got["141011"].level, got["141011"].parent, got["141011"].towns, got["141011"].lat) == ("ward", "141003", 3, None)
    assert got["141011"].k == ["鶴見区", "横浜市鶴見区"] and got["143014"].k == ["葉山町", "3浦郡葉山町"] and got["143014"].kk == ["はやままち", "みうらぐんはやままち"]
    assert got["143014"].lat == 35.2 and got["14"].lat == 35.4


def test_town_positions(spark):
    towns = src(spark, "mt_town", [
        {"lg_code": "131121", "machiaza_id": "0001001", "oaza_cho": "甲", "chome": "一丁目", "rsdt_addr_flg": "1"}, {"lg_code": "131121", "machiaza_id": "0002000", "oaza_cho": "乙町"},
        {"lg_code": "131121", "machiaza_id": "0002101", "oaza_cho": "乙町", "koaza": "東"}, {"lg_code": "131121", "machiaza_id": "0003000", "oaza_cho": "丙"}, {"lg_code": "131121", "machiaza_id": "0004000"}])
    pos = src(spark, "mt_town_pos", [{"lg_code": "131121", "machiaza_id": "0001001", "rep_lat": "35.1", "rep_lon": "139.1"}])
    isj = src(spark, "isj_town", [{"city5": "13112", "name": "乙町", "lat": "35.2", "lng": "139.2"}])
    p = build.place_towns(towns, pos, isj)
    got = {r.machiaza_id: (r.lat, r.source, r.flags) for r in p.collect()}
    assert got == {"0001001": (35.1, "abr", 1), "0002000": (35.2, "isj", 0), "0002101": (35.2, "parent", 2), "0003000": (None, "none", 0)}
    s = build.position_stats(p).first()
    assert (s.abr, s.isj, s.parent, s.none) == (1, 1, 1, 1)
    keys, kana = build.build_towns(p)
    assert {r.key for r in keys.collect()} == {"甲1丁目", "甲1", "乙町", "乙町東", "丙"} and kana.count() == 0


def test_numbers_and_parcels(spark):
    blk = src(spark, "mt_rsdtdsp_blk", [{"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "blk_num": "5"}, {"lg_code": "a", "machiaza_id": "m", "blk_id": "2", "blk_num": "6", "ablt_date": "x"}])
    bp = src(spark, "mt_rsdtdsp_blk_pos", [{"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "rep_lat": "35.0", "rep_lon": "139.0"}])
    blocks = build.build_blocks(blk, bp)
    rs = src(spark, "mt_rsdtdsp_rsdt", [{"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "blk_num": "5", "rsdt_id": "1", "rsdt_num": "3"}, {"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "blk_num": "5", "rsdt_id": "2", "rsdt2_id": "1", "rsdt_num": "4", "rsdt_num2": "2"}])
    rp = src(spark, "mt_rsdtdsp_rsdt_pos", [{"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "rsdt_id": "1", "rep_lat": "35.000010", "rep_lon": "138.999990"}, {"lg_code": "a", "machiaza_id": "m", "blk_id": "1", "rsdt_id": "2", "rsdt2_id": "1", "rep_lat": "35.0", "rep_lon": "139.0"}])
    n = {r.no_key: (r.dlat, r.dlng, r.branch) for r in build.build_numbers(rs, rp, blocks).collect()}
    assert blocks.count() == 1 and n == {"3": (10, -10, None), "4-2": (0, 0, "2")}
    pc = src(spark, "mt_parcel", [{"lg_code": "a", "machiaza_id": "m", "prc_id": str(i), "prc_num1": str(x)} for i, x in enumerate([9, 2, 5])])
    pp = src(spark, "mt_parcel_pos", [{"machiaza_id": "m", "prc_id": str(i), "rep_lat": f"35.{i}", "rep_lon": "139", "rep_scale": "500"} for i in range(2)])
    p = build.build_parcels(pc, pp)
    assert [(r.a, r.ord, r.accuracy) for r in p.orderBy("ord").collect()] == [(2, 1, "surveyed"), (9, 2, "surveyed")]
    assert [(r.a, r.y) for r in build.parcel_deltas(p).orderBy("ord").collect()] == [(2, 5000), (7, -10000)]


def test_aliases_and_rail(spark):
    cities = spark.createDataFrame([("11", "11", "埼玉県", "pref"), ("111074", "11", "さいたま市浦和区", "ward"), ("112011", "11", "川越市", "city")], "code string, pref string, name string, level string")
    old = src(spark, "old_city", [{"geoshape_city_id": "11204A", "pref": "埼玉県", "name": "浦和", "suffix": "市/町"}, {"geoshape_city_id": "11999A", "pref": "埼玉県", "name": "霞", "suffix": "村"}, {"geoshape_city_id": "11998A", "pref": "埼玉県", "name": "無", "suffix": "村"}, {"geoshape_city_id": "11201A", "pref": "埼玉県", "name": "川越", "suffix": "市"}])
    cur = src(spark, "current_city", [{"geoshape_city_id": "11201"}])
    names = spark.createDataFrame([("霞ケ関", "112011"), ("霞東", "112011"), ("霞西", "111074")], "oaza string, lg_code string")
    got = {(r.key, r.code) for r in build.build_aliases(old, cur, cities, names).collect()}
    assert got == {("浦和市", "111074"), ("埼玉県浦和市", "111074"), ("霞村", "112011"), ("埼玉県霞村", "112011")}
    lines, st = build.build_rail(src(spark, "company", [{"company_cd": "1", "company_name": "C", "e_status": "0"}]), src(spark, "line", [{"line_cd": "5", "company_cd": "2", "line_name": "L", "e_status": "0"}]),
                                 src(spark, "station", [{"station_cd": "2", "station_g_cd": "2", "lat": "35", "lon": "139", "post": "100-0001", "line_cd": "5", "pref_cd": "13", "e_status": "0", "e_sort": "1"}, {"station_cd": "3", "station_g_cd": "3", "lat": "0", "lon": "0", "line_cd": "5", "e_status": "0"}, {"station_cd": "4", "station_g_cd": "4", "lat": "35", "lon": "139", "line_cd": "5", "e_status": "1"}]))
    assert lines.first().company == "" and [(r.code, r.postal_code) for r in st.collect()] == [(2, "1000001")]


def test_directory(spark):
    t = gazetteer(spark)
    rows = directory.list_municipalities(t.cities, "14").collect()
    assert [(r.municipality, r.ward) for r in rows] == [("横浜市", ["鶴見区"]), ("横浜市", ["神奈川区"]), ("横須賀市", None)]
    rows = directory.list_municipalities(t.cities, "14", "nested").collect()
    assert [(r.municipality, r.ward, r.lat) for r in rows] == [("横浜市", ["鶴見区", "神奈川区"], 35.44), ("横須賀市", None, 35.28)]
    assert [r.municipality for r in directory.list_municipalities(t.cities, "27").collect()] == ["大阪市中央区"]
    assert [r.code for r in directory.list_stations(t.stations, pref=13, line=11).collect()] == [1, 3]
    assert directory.list_stations(t.stations, unknown_pref=True).count() == 0
    assert [r.code for r in directory.list_lines(t.lines, t.stations, 13).collect()] == [11, 12]
    assert {r.code: r.stations for r in directory.stations_per_line(t.lines, t.stations).collect()}[13] == 0
    assert directory.get_station(t.stations, 4).first().name == "大宮"


@pytest.mark.parametrize("n", [3])
def test_stream(spark, tmp_path, n):
    from azanami.plans.engine import GeoEngine, Tables
    from azanami.streaming.addresses import geocode_stream

    spark.createDataFrame([(i, "中央区銀座1") for i in range(n)], "id long, address string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, address string").parquet(str(tmp_path / "in"))
    q = geocode_stream(GeoEngine(spark, Tables(gazetteer(spark).cities)), s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("rank = 1").count() == n
