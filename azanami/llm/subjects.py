"""Subject areas of documents, by propagating labels over the graph that links documents through their words.

Two documents are as similar as the words they share.  That graph is kept in factored form, as edges between
documents and words, so no pair of documents is ever written out, however many share a word: one step document -> word
-> document passes every label along all similarity edges, with joins only.  Edges are verified: a word
takes part only while it is found in at least ``MIN_DOCS`` labelled documents and is at least ``MIN_LIFT`` times
as frequent under its subject as overall, so words that all subjects share carry nothing.

Seeds are documents with annotators' labels, a label counting where at least half of the document's labels agree with it; in all rounds
seeds stay clamped to their labels (what is returned for them is recomputed from their words, since labels contain errors), and a
document or word may belong to any number of subjects.  Each round recomputes the
words' subjects from the documents and the documents' shares from the words, until no more than ``TOLERANCE`` of the
documents change.  A document's subjects are those that make up at least ``MIN_SHARE`` of all its words.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.operators.skew import attach_by_key
from azanami.runtime import Stage

MIN_DOCS = 2
MIN_LIFT = 2.0
#: Share of all words, code and comments alike; about half of a file's words are the language's own, so this is
#: about a fifth of what it speaks of.
MIN_SHARE = 0.09
TOLERANCE = 0.005
#: Rounds after which documents that still change are given up, with a warning.
MAX_ROUNDS = 30
#: Weight of the prior when a word's subjects are estimated.
PRIOR = 2.0
#: A word's lesser subjects count only from this part of it.
MIN_PART = 0.2

#: Parts of identifiers and words; scripts without spaces are cut where the kind of letter changes.
_PART = re.compile(r"[A-ZÀ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-öø-ÿ])|[゠-ヿー]+|[㐀-鿿々]+|[Ѐ-ӿ]+|[Ͱ-Ͽ]+|[가-힣]+")


def parts(text: str) -> list[str]:
    return [w.lower() for w in _PART.findall(text)]


def word_edges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word, n): every word of every document once, with its count; whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, totals, ws, ns = [], [], [], []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                c = Counter(parts(t))
                ids.append(i)
                totals.append(sum(c.values()))
                ws.append(list(c.keys()))
                ns.append(list(c.values()))
            yield pd.DataFrame({"doc_id": ids, "n_words": totals, "words": ws, "ns": ns})

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    rows = base.mapInPandas(run, "doc_id long, n_words long, words array<string>, ns array<int>")
    flat = rows.select("doc_id", "n_words", F.explode(F.arrays_zip("words", "ns")).alias("e"))
    return flat.select("doc_id", "n_words", F.xxhash64("e.words").alias("word"), F.col("e.ns").alias("n"))


def seeds(labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", subject: str = "subject") -> DataFrame:
    """(doc_id, b0 .. bK): weights of the subjects, the last one for none, from the labels that hold."""
    name = F.lower(F.trim(F.col(subject)))
    votes = labels.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("s")).where("doc_id is not null").where(F.col("s").isin([*subjects, "none"]))
    counted = votes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_all"), *(F.count_if(F.col("s") == s).alias(f"v{k}") for k, s in enumerate([*subjects, "none"])))
    kept = [F.when(F.col(f"v{k}") * 2 >= F.col("_all"), 1.0).otherwise(0.0) for k in range(len(subjects) + 1)]
    some = sum(kept[1:], kept[0])
    return counted.select("doc_id", *((c / some).alias(f"b{k}") for k, c in enumerate(kept)), (some > 0).alias("_ok")).where("_ok").drop("_ok")


def word_subjects(edges: DataFrame, beliefs: DataFrame, k: int) -> DataFrame:
    """(word, parts): the subjects of each word that tells any, as (s, w), the strongest first; weights sum to one."""
    classes = range(k + 1)
    linked = edges.select("doc_id", "word").join(beliefs, "doc_id")
    per_word = linked.groupBy("word").agg(F.count(F.lit(1)).alias("df"), *(F.sum(f"b{c}").alias(f"t{c}") for c in classes))
    prior = beliefs.agg(*(F.avg(f"b{c}").alias(f"p{c}") for c in classes)).first()
    p = [max(float(prior[c] or 0.0), 1e-6) for c in classes]
    lift = [((F.col(f"t{c}") + PRIOR * p[c]) / (F.col("df") + PRIOR) / p[c]).alias(f"l{c}") for c in range(k)]
    rated = per_word.where(F.col("df") >= MIN_DOCS).select("word", *lift)
    excess = F.array_sort(F.array(*(F.struct((-F.greatest(F.col(f"l{c}") - 1.0, F.lit(0.0))).alias("w"), F.lit(c).alias("s")) for c in range(k))))
    top = rated.where(F.greatest(F.lit(0.0), *(F.col(f"l{c}") for c in range(k))) > MIN_LIFT).select("word", excess.alias("b"))
    # a lesser subject counts if it has MIN_PART of what the word says, beside the strongest
    kept = F.filter("b", lambda x, i: (i == 0) | (x["w"] / (F.col("b")[0]["w"] + x["w"]) >= MIN_PART))
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"])
    top = top.select("word", kept.alias("b")).withColumn("_all", weight(F.col("b")))
    return top.select("word", F.transform("b", lambda x: F.struct(x["s"].alias("s"), (x["w"] / F.col("_all")).alias("w"))).alias("parts"))


def document_shares(edges: DataFrame, words: DataFrame, k: int, total: int) -> DataFrame:
    """(doc_id, sh0 ..): each subject's part of the document's words; ambiguous words follow its unambiguous ones.

    words: as of ``word_subjects``, with the number ``df`` of each word's edges; total: of all edges.
    """
    hit = attach_by_key(edges, words, "word", "df", total)
    single = F.size("parts") == 1
    own = [F.sum(F.when(single & (F.col("parts")[0]["s"] == c), F.col("n")).otherwise(0)).cast("double").alias(f"u{c}") for c in range(k)]
    several = F.collect_list(F.when(~single, F.struct("parts", "n"))).alias("amb")
    per_doc = hit.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *own, several)
    u = F.array(*(F.col(f"u{c}") + 0.05 for c in range(k)))
    drawn = lambda x: F.aggregate(x["parts"], F.lit(0.0), lambda a, y: a + u[y["s"]] * y["w"])
    per_doc = per_doc.withColumn("amb", F.transform("amb", lambda x: F.struct(x["parts"].alias("parts"), (x["n"] / drawn(x)).alias("f"))))

    def part(c: int) -> Column:
        mine = lambda x: F.aggregate(x["parts"], F.lit(0.0), lambda a, y: a + F.when(y["s"] == c, y["w"]).otherwise(0.0))
        return (F.col(f"u{c}") + 0.05) * F.aggregate("amb", F.lit(0.0), lambda a, x: a + x["f"] * mine(x))

    return per_doc.select("doc_id", *(((F.col(f"u{c}") + part(c)) / F.col("n_words")).alias(f"sh{c}") for c in range(k)))


def _beliefs(shares: DataFrame, seeded: DataFrame, k: int, min_share: float) -> DataFrame:
    """Weights of each document for the next round: its strong subjects by share, or none; seeds as they are."""
    strong = [F.when(F.col(f"sh{c}") >= min_share, F.col(f"sh{c}")).otherwise(0.0) for c in range(k)]
    total = sum(strong[1:], strong[0])
    free = shares.select("doc_id", *((F.when(total > 0, s / total).otherwise(0.0)).alias(f"b{c}") for c, s in enumerate(strong)), F.when(total > 0, 0.0).otherwise(1.0).alias(f"b{k}"))
    return free.join(seeded.select("doc_id"), "doc_id", "left_anti").unionByName(seeded)


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: list[str], min_share: float = MIN_SHARE, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, sh0 ..) for every document with at least one word that tells a subject, subjects in the given order.

    ``subjects`` is a short list that the caller names (it becomes columns).  Rows without id or text, empty texts and
    documents without telling words have no row; of repeated ids the rows' words are counted together.  Without
    usable labels there are no rows.  A warning is given if more than ``tolerance`` of the documents still change after max_rounds.  Labels outside the list (but ``none``) are ignored, letter case and
    surrounding spaces too.  Other columns don't matter.
    """
    k, stage = len(subjects), Stage(docs.sparkSession, "subjects")
    edges = stage.keep(word_edges(docs), "edges")
    seeded = stage.keep(seeds(labels, subjects), "seeds")
    freq = stage.keep(edges.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= MIN_DOCS), "freq")
    total = edges.count()
    beliefs, previous, old_path, diff = seeded, None, None, 1.0
    for _ in range(max_rounds):
        words = stage.keep(word_subjects(edges, beliefs, k).join(freq, "word"), "words")
        shares, path = stage.write(document_shares(edges, words, k, total), "shares")
        mask = sum((F.when(F.col(f"sh{c}") >= min_share, 1 << c).otherwise(0) for c in range(1, k)), F.when(F.col("sh0") >= min_share, 1).otherwise(0))
        now = shares.select("doc_id", mask.alias("m"))
        if previous is not None:
            diff = now.join(previous.withColumnRenamed("m", "m0"), "doc_id", "full").agg(F.avg(F.when(F.col("m").eqNullSafe(F.col("m0")), 0.0).otherwise(1.0))).first()[0]
            if old_path:
                stage.drop(old_path)
            diff = diff or 0.0
            if diff <= tolerance:
                break
        previous, old_path = now, path
        beliefs = _beliefs(shares, seeded, k, min_share)
    if (diff or 0.0) > tolerance and max_rounds > 1:
        warnings.warn(f"subjects of {diff:.1%} of the documents still change after {max_rounds} rounds", stacklevel=2)
    return shares


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, min_share: float = MIN_SHARE, **how) -> DataFrame:
    """(doc_id, subject), each pair once, for the subjects that make up at least min_share of a document's words.

    areas: the subjects' table, column ``subject``.  Its size is the number of result columns inside, so it must be short.
    """
    names = sorted(r[0] for r in areas.select(F.lower(F.trim("subject"))).where("subject is not null").distinct().limit(257).collect())
    if len(names) > 256:
        raise ValueError("more than 256 subjects")
    if not names:
        return docs.sparkSession.createDataFrame([], "doc_id long, subject string")
    shares = subject_shares(docs, labels, names, min_share, **how)
    pairs = F.filter(F.array(*(F.when(F.col(f"sh{c}") >= min_share, F.lit(s)) for c, s in enumerate(names))), lambda x: x.isNotNull())
    return shares.select("doc_id", F.explode(pairs).alias("subject"))
