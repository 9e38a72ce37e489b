"""Evaluation texts that occur in a training corpus, found by backward search in an FM-index per shard.

A shard is what one task reads, cut every ``SHARD_WORDS`` words: it is indexed where it lies, so the corpus is never
shuffled.  All words of a shard are numbered by a vocabulary of its own, its suffixes sorted (prefix doubling,
each round sorting only what is still tied), and the Burrows-Wheeler transform is held in a wavelet matrix.  Every
run of ``MIN_WORDS`` words of every evaluation item is searched backwards through the matrix' ranks, all runs in step;
rows that match are walked to the next sampled suffix, which tells the document and the place in it.
Windows that overlap or touch are merged to spans, ready for removal.

The only thing sent to all tasks is the evaluation items' words, in blocks of about ``BLOCK_BYTES`` each.  The corpus is read
and indexed once however many blocks there are: a task searches one block after another in a shard's index, and holds one of
them at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 16
SHARD_WORDS = 1_000_000
SHARD_DOCS = 200_000
BLOCK_BYTES = 32 << 20
SAMPLE = 16

_WORD = re.compile(r"[^\W_]+")
#: Escapes in string literals separate words: \n, \t, ..., \x0a, é.
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[abefnrtv0])")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    return _WORD.findall(text.lower())


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t, whose last element must be its only smallest one."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length()) if n else 1
    step = max(1, min(3, 62 // bits))
    key = t.astype(np.int64)
    for j in range(1, step):
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - j] = t[j:]
        key = (key << bits) | nxt
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = _group_starts(key[sa])
    depth = step
    while True:
        starts = rank[sa]
        size = np.diff(np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1], [True]])))
        tied = np.repeat(size, size) > 1
        if not tied.any():
            return sa
        rows = np.flatnonzero(tied)
        suf = sa[rows]
        after = suf + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((follow, rank[suf]))
        suf, follow = suf[order], follow[order]
        sa[rows] = suf
        old = rank[suf]
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])])
        rank[suf] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        depth *= 2


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class WaveletMatrix:
    """Symbol at a place, and occurrences of a symbol before a place, for whole arrays of places."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((s >> b) & 1).astype(bool)
            count = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            ro, ri = ones[lo], ones[i]
            lo = np.where(one, zeros + ro, lo - ro)
            i = np.where(one, zeros + ri, i - ri)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each occurs before."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[i + 1] > ones[i]
            c = (c << 1) | one
            ro, ri = ones[lo], ones[i]
            lo = np.where(one, zeros + ro, lo - ro)
            i = np.where(one, zeros + ri, i - ri)
        return c, i - lo


class FMIndex:
    """Index of a shard's documents; words are 1 .. V, each document ends with a separator."""

    def __init__(self, docs: list[list[str]]):
        self.vocab: dict[str, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        number = self.vocab.__getitem__
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])
        n, d = int(self.start[-1]), len(docs)
        t = np.zeros(n, dtype=np.int64)
        ids = np.fromiter((number(w) for doc in docs for w in doc), np.int64, int(sizes.sum()))
        self.vocab.default_factory = None
        last = self.start[1:] - 1  # places of the separators
        inner = np.ones(n, dtype=bool)
        inner[last] = False
        t[inner] = ids + d
        t[last] = np.arange(d)[::-1]  # each its own symbol, so that no suffix compares beyond its document; the last is smallest
        sa = suffix_array(t)
        symbol = np.where(t >= d, t - d + 1, 0)  # in the transform all separators are 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=len(self.vocab) + 1))])
        self.bwt = WaveletMatrix(symbol[sa - 1])  # sa - 1 is -1 for the whole text: the last separator
        first = np.zeros(n, dtype=bool)
        first[self.start[:-1]] = True
        keep = (sa % SAMPLE == 0) | first[sa]  # documents' first places are kept: a walk never passes a separator
        self.sampled = np.concatenate([[0], np.cumsum(keep)])
        self.places = sa[keep]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of equally long patterns; a 0 in a pattern matches nothing."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), len(self.sampled) - 1, dtype=np.int64)
        hi[(patterns == 0).any(axis=1)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            c = patterns[go, j]
            lo[go] = self.before[c] + self.bwt.rank(c, lo[go])
            hi[go] = self.before[c] + self.bwt.rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the index."""
        place, walked = np.full(len(rows), -1, dtype=np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[at + 1] > self.sampled[at]
            place[left[hit]] = self.places[self.sampled[at[hit]]] + walked
            left, at = left[~hit], at[~hit]
            if len(left):
                c, r = self.bwt.access(at)
                at = self.before[c] + r
                walked += 1
        return place


def _windows(item_words: list[list[str]], k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Vocabulary of the items, their windows of k words as numbers into it, and each window's item."""
    vocab: dict[str, int] = {}
    rows, owner = [], []
    for i, ws in enumerate(item_words):
        ids = [vocab.setdefault(w, len(vocab)) for w in ws]
        if len(ids) >= k:
            w = np.lib.stride_tricks.sliding_window_view(np.array(ids, dtype=np.int64), k)
            rows.append(w)
            owner.append(np.full(len(w), i))
    if not rows:
        return [], np.zeros((0, k), np.int64), np.zeros(0, np.int64)
    w, o = np.concatenate(rows), np.concatenate(owner)
    return list(vocab), w, o


def _merge(doc: np.ndarray, item: np.ndarray, at: np.ndarray, k: int) -> pd.DataFrame:
    """Windows to maximal spans [first_word, end_word) per document and item."""
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + k)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
    return pd.DataFrame({"doc": doc[first], "item": item[first], "first_word": at[first], "end_word": at[last] + k})


def _value(shared):
    """A broadcast's value, not kept by the worker: with many blocks only one is held at a time."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value


def _scan(blocks: list, k: int, shard_words: int):
    """Index every shard once and search all blocks of items in it."""

    def find(ids: list, docs: list[list[str]]) -> Iterator[pd.DataFrame]:
        index = FMIndex(docs)
        for shared in blocks:
            item_ids, names, windows, owner = _value(shared)
            code = np.array([index.vocab.get(w, -1) + 1 for w in names], dtype=np.int64)
            lo, hi = index.search(code[windows])
            n = np.maximum(hi - lo, 0)
            rows = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            place = index.locate(rows)
            doc = np.searchsorted(index.start, place, side="right") - 1
            out = _merge(doc, np.repeat(owner, n), place - index.start[doc], k)
            yield pd.DataFrame({"doc_id": [ids[i] for i in out["doc"]], "item_id": item_ids[out["item"]], "first_word": out["first_word"], "end_word": out["end_word"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        docs: list[list[str]] = []
        n = 0
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                w = words(text)
                if len(w) < k:  # too short to hold a window
                    continue
                ids.append(i)
                docs.append(w)
                n += len(w)
                if n >= shard_words or len(ids) >= SHARD_DOCS:
                    yield from find(ids, docs)
                    ids, docs, n = [], [], 0
        if ids:
            yield from find(ids, docs)

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.toLocalIterator():  # one partition at a time; a block is all that is held
        w = words(row["text"])
        block.append((row["item_id"], w))
        size += 8 * MIN_WORDS * len(w) + sum(map(len, w))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(corpus: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Maximal runs of at least min_words consecutive words that a document shares with an item.

    Result: (doc_id, item_id, first_word, end_word), word offsets in the document.  Rows without an id, without text or with
    fewer words give nothing; repeated rows give their spans once.  Ties don't arise: every shared run is reported.
    Other columns of either table don't matter.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    schema, blocks = "doc_id long, item_id long, first_word long, end_word long", []
    for block in _blocks(wanted, block_bytes):
        names, windows, owner = _windows([w for _, w in block], min_words)
        if len(names):
            blocks.append(spark.sparkContext.broadcast((np.array([i for i, _ in block]), names, windows, owner)))
    if not blocks:
        return spark.createDataFrame([], schema)
    return docs.mapInPandas(_scan(blocks, min_words, shard_words), schema).distinct()


def leaked_items(corpus: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id) once for each document that holds at least 16 consecutive words of the item."""
    return leaked_spans(corpus, items, **how).select("doc_id", "item_id").distinct()
