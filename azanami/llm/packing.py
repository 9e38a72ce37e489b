"""Filling containers of fixed capacity with documents, by bulk-synchronous best fit.

Every round range-sorts the documents that are left together with the gaps of the containers, largest first.  A sweep through that
order gives each document its successor, the smallest free gap that holds it: gaps are opening and documents closing
parentheses, and a document takes the gap of its pair.  Each task sweeps its own range; what a range leaves open is a run of documents
and a run of gaps, so ranges are paired by their two counts alone, and documents and gaps by their ranks in them.  That
resolves all conflicts at once: larger documents come first, equal ones by number.  Then gaps are updated, the largest documents that
no gap can hold open new containers, as many as ``OPEN_PART`` of their volume needs, and the next round begins.  A gap
that holds several of the largest document takes part with that many places.

A document is placed by a round's sweep or waits, so rounds are few (about sixteen for usual sizes), and only documents that are
left take part.  The last ``TAIL`` rows run their rounds in one task.  ``plan`` is best fit decreasing on size classes, by
which tests judge the result.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from azanami.runtime import Stage

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Part of the volume that no gap can hold for which containers are opened at once.  Less packs tighter in more rounds.
OPEN_PART = 0.75
#: Documents and gaps that one task sweeps, and the number of them that one task finishes.
SWEEP_ROWS, TAIL = 500_000, 20_000
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row, whole texts; null text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    base = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInPandas(run, "doc_id string, tokens long").withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Assignments of size classes, and the number of containers.

    counts: size -> number of documents, sizes 1 .. capacity.  An assignment (size, first_rank, n, first_container, each) puts the
    documents with ranks first_rank .. first_rank + n - 1, ``each`` by ``each``, into containers from first_container on.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first container, number)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        for gap in sorted(g for g in gaps if g >= size):
            if not left:
                break
            each, rest = gap // size, []
            for first, m in gaps.pop(gap):
                used = min(m, left // each)
                if used:
                    out.append((size, rank, used * each, first, each))
                    gaps[gap - each * size].append((first, used))
                    rank, left = rank + used * each, left - used * each
                if used < m and 0 < left < each:
                    out.append((size, rank, left, first + used, each))
                    gaps[gap - left * size].append((first + used, 1))
                    rank, left, used = rank + left, 0, used + 1
                if used < m:
                    rest.append((first + used, m - used))
            if rest:
                gaps[gap].extend(rest)
        if left:
            each = capacity // size
            full, odd = divmod(left, each)
            if full:
                out.append((size, rank, full * each, opened, each))
                gaps[capacity - each * size].append((opened, full))
                rank, opened = rank + full * each, opened + full
            if odd:
                out.append((size, rank, odd, opened, each))
                gaps[capacity - odd * size].append((opened, 1))
                opened += 1
        gaps.pop(0, None)
    return out, opened


def sweep(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of paired documents and of their gaps, and of the documents and gaps left open, in a run of gaps (0) and documents (1) from large to small."""
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    low = np.minimum.accumulate(np.minimum(depth, 0))
    lost = np.concatenate([[0], low[:-1]]) > low  # a document before which no gap is free
    level = np.where(kind == 0, depth - low, depth - low + 1)
    at = np.flatnonzero(~lost)
    at = at[np.lexsort((at, level[at]))]
    a, b = at[:-1], at[1:]
    pair = (kind[a] == 0) & (kind[b] == 1) & (level[a] == level[b])
    gaps, docs = a[pair], b[pair]
    free = kind == 0
    free[gaps] = False
    return docs, gaps, np.flatnonzero(lost), np.flatnonzero(free)


def pair_ranges(ranges: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Pairs what the ranges (range, open documents, open gaps) leave open, in their order.

    Result: (document range, first rank, number, gap range, rank of the first one's gap, falling from there), and the number of documents
    that each range places.
    """
    stack: list[list[int]] = []
    out, placed = [], {}
    for part, n_docs, n_gaps in ranges:
        first = 0
        while first < n_docs and stack:
            top = stack[-1]
            n = min(n_docs - first, top[1])
            out.append((part, first, n, top[0], top[1] - 1))
            first, top[1] = first + n, top[1] - n
            if not top[1]:
                stack.pop()
        placed[part] = first
        if n_gaps:
            stack.append([part, n_gaps])
    return out, placed


def newly_opened(oversized: float, large: int, some: bool, capacity: int) -> int:
    """Containers to open for documents that no gap holds: their volume, how many exceed half a container, and whether there are any."""
    return max(int(-(-(oversized * OPEN_PART) // capacity)), large, int(some))


def most_places(n_docs: int, n_gaps: int) -> int:
    """Places that one gap offers at most in a round, so that there are not many more than documents."""
    return max(1, 2 * n_docs // max(n_gaps, 1))


def finish(docs: np.ndarray, containers: np.ndarray, gaps: np.ndarray, opened: int, capacity: int) -> np.ndarray:
    """The rounds for documents from large to small within one task: each one's container."""
    out = np.full(len(docs), -1, dtype=np.int64)
    left = np.arange(len(docs))
    while len(left):
        sizes = docs[left]
        slot = np.repeat(np.arange(len(gaps)), np.clip(gaps // sizes[0], 1, most_places(len(left), len(gaps))))
        size, kind = np.concatenate([gaps[slot], sizes]), np.repeat([0, 1], [len(slot), len(left)])
        order = np.lexsort((kind, -size))
        d, g, _, _ = sweep(kind[order])
        d, g = order[d] - len(slot), slot[order[g]]
        out[left[d]] = containers[g]
        gaps = gaps.copy()
        np.subtract.at(gaps, g, sizes[d])
        left = np.delete(left, d)
        if len(left):
            over = docs[left][docs[left] > (gaps.max() if len(gaps) else 0)]
            m = newly_opened(over.sum(), int((over > capacity // 2).sum()), len(over) > 0, capacity)
            out[left[:m]] = opened + np.arange(m)
            gaps, containers = np.concatenate([gaps, capacity - docs[left[:m]]]), np.concatenate([containers, out[left[:m]]])
            left, opened = left[m:], opened + m
        keep = gaps >= (docs[left[-1]] if len(left) else 1)
        gaps, containers = gaps[keep], containers[keep]
    return out


def _finish_in_task(opened: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            rows = pd.concat(rows, ignore_index=True)
            docs = rows[rows["kind"] == 1].sort_values(["size", "ident"], ascending=[False, True])
            gaps = rows[rows["kind"] == 0].sort_values("ident")
            at = finish(docs["size"].to_numpy(), gaps["ident"].to_numpy(), gaps["size"].to_numpy(), opened, capacity)
            yield pd.DataFrame({"uid": docs["ident"], "size": docs["size"], "container": at})

    return run


def _sweep_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range: paired documents (what 0, with their container), open documents (1) and open gaps (2) with their rank in the range."""
    rows = list(batches)
    if rows:
        rows = pd.concat(rows, ignore_index=True)
        ident, size = rows["ident"].to_numpy(), rows["size"].to_numpy()
        d, g, docs, gaps = sweep(rows["kind"].to_numpy())
        at = np.concatenate([d, docs, gaps])
        what = np.repeat([0, 1, 2], [len(d), len(docs), len(gaps)])
        rank = np.concatenate([np.zeros(len(d), np.int64), np.arange(len(docs)), np.arange(len(gaps))])
        container = np.concatenate([ident[g], np.full(len(docs) + len(gaps), -1)])
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "what": what, "rank": rank, "ident": ident[at], "size": size[at], "container": container})


def _assign(left: DataFrame, capacity: int, stage: Stage) -> tuple[DataFrame, int]:
    """(uid, container) of (uid, size), sizes 1 .. capacity, and the number of containers."""
    spark = left.sparkSession
    n, largest, smallest = left.agg(F.count(F.lit(1)), F.max("size"), F.min("size")).first()
    gaps, n_gaps, opened, done = spark.createDataFrame([], "container long, gap long"), 0, 0, []
    while n:
        small = n + n_gaps <= TAIL
        slots = F.lit(1) if small else F.least(F.greatest(F.floor(F.col("gap") / largest), F.lit(1)), F.lit(most_places(n, n_gaps)))
        free = gaps.where(F.col("gap") >= smallest).select(F.col("gap").alias("size"), F.lit(0).alias("kind"), F.col("container").alias("ident"), F.explode(F.array_repeat(F.lit(0), slots.cast("int"))).alias("_s")).drop("_s")
        both = left.select("size", F.lit(1).alias("kind"), F.col("uid").alias("ident")).unionByName(free)
        if small:
            last = both.coalesce(1).mapInPandas(_finish_in_task(opened, capacity), "uid long, size long, container long")
            last = stage.keep(last, "tail")
            opened = max(opened, (last.agg(F.max("container")).first()[0] or 0) + 1)
            done.append(last.select("uid", "container"))
            break
        order = [F.desc("size"), F.asc("kind"), F.asc("ident")]
        ranges = -(-(n + 2 * n_gaps) // SWEEP_ROWS)
        swept = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(_sweep_in_task, "part int, what int, rank long, ident long, size long, container long")
        swept = stage.keep(swept, "swept")
        counts = {(r["part"], r["what"]): r["n"] for r in swept.where("what > 0").groupBy("part", "what").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a task
        parts = sorted({p for p, _ in counts})
        pairs, placed = pair_ranges([(p, counts.get((p, 1), 0), counts.get((p, 2), 0)) for p in parts])
        paired = swept.where("what = 0").select(F.col("ident").alias("uid"), "size", "container")
        if pairs:
            runs = spark.createDataFrame([(p, f, f + k, gp, gr) for p, f, k, gp, gr in pairs], "part int, first long, past long, g_part int, g_rank long")
            far = swept.where("what = 1").join(F.broadcast(runs), "part").where("rank >= first and rank < past")  # at most two rows a task
            far = far.select(F.col("ident").alias("uid"), "size", F.col("g_part").alias("part"), (F.col("g_rank") - (F.col("rank") - F.col("first"))).alias("rank"))
            free = swept.where("what = 2").select("part", "rank", F.col("ident").alias("container"))
            paired = paired.unionByName(far.join(free, ["part", "rank"]).select("uid", "size", "container"))
        paired = stage.keep(paired, "paired")
        used = paired.groupBy("container").agg(F.sum("size").alias("_used"))
        gaps = stage.keep(gaps.join(used, "container", "left").select("container", (F.col("gap") - F.coalesce("_used", F.lit(0))).alias("gap")).where(F.col("gap") >= smallest), "gaps")
        widest = gaps.agg(F.max("gap")).first()[0] or 0
        # documents that are left, in order over all ranges
        base, before = [], 0
        for p in parts:
            base.append((p, placed[p], before - placed[p]))
            before += counts.get((p, 1), 0) - placed[p]
        offsets = spark.createDataFrame(base or [(-1, 0, 0)], "part int, _placed long, _base long")
        open_ = swept.where("what = 1").join(F.broadcast(offsets), "part").where("rank >= _placed").select(F.col("ident").alias("uid"), "size", (F.col("rank") + F.col("_base")).alias("place"))
        over = F.col("size") > widest
        volume, large, some = open_.agg(F.sum(F.when(over, F.col("size"))), F.count_if(over & (F.col("size") > capacity // 2)), F.count_if(over)).first()
        m = newly_opened(volume or 0, large, some > 0, capacity)
        new = open_.where(F.col("place") < m).select("uid", "size", (F.col("place") + opened).alias("container"))
        done += [paired.select("uid", "container"), new.select("uid", "container")]
        gaps = gaps.unionByName(new.select("container", (F.lit(capacity) - F.col("size")).alias("gap")))
        opened += m
        left = stage.keep(open_.where(F.col("place") >= m).select("uid", "size"), "left")
        n, largest, smallest = left.agg(F.count(F.lit(1)), F.max("size"), F.min("size")).first()
        gaps = stage.keep(gaps.where(F.col("gap") >= (smallest or 1)), "gaps")
        n_gaps = gaps.count()
    out = spark.createDataFrame([], "uid long, container long")
    for part in done:
        out = out.unionByName(part)
    return out, opened


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, first_token, tokens, container): every row of docs in one container, or in pieces if it exceeds the capacity.

    A document longer than the capacity gives full pieces, each with a container of its own, and a rest that is packed like
    any other document; no other document is split.  Documents without tokens (null or empty text) take no space and are spread
    over the containers.  Null and repeated ids are rows like any other.  An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    stage = Stage(docs.sparkSession, "packing")
    sized = token_counts(docs, tokenizer, doc_id, text).withColumnRenamed("doc_id", doc_id)
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    pieces = sized.select(doc_id, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select(doc_id, "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))
    pieces = stage.keep(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    at, opened = _assign(pieces.where("tokens > 0").select(F.col("_uid").alias("uid"), F.col("tokens").alias("size")), capacity, stage)
    none = pieces.where("tokens = 0").withColumn("container", F.pmod(F.xxhash64("_uid"), F.lit(max(opened, 1))))
    placed = pieces.where("tokens > 0").join(at.withColumnRenamed("uid", "_uid"), "_uid")
    return placed.unionByName(none).select(doc_id, "piece", "first_token", "tokens", "container")


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("used_share"))
