"""Rows that fail to parse: a quote-aware finite-state tokenizer over raw records.

A record is a run of bytes; a field either holds no quote or is wrapped in quotes with inner ones
doubled.  The automaton has five states.  A batch of records is laid out as one byte array and cut into
chunks of ``CHUNK`` bytes; for each chunk the *transition function* (the state it ends in, for each of the
five it may begin in) is found for all chunks at once, the functions are composed along each record by doubling, and
a second sweep then knows the true state at every byte.

Composition is associative, so a file may be cut anywhere too: ``read_records`` composes the functions of a file's lines and then
of its splits, which tells every task whether its split begins inside quotes, and joins the records that cross a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.runtime import Stage

START, PLAIN, QUOTED, CLOSED, BAD = range(5)
N_STATES = 5
#: Byte classes: other, quote, comma, end of record.
OTHER, QUOTE, COMMA, END = range(4)
#: STEP[class, state] is the next state.
STEP = np.array([
    [PLAIN, PLAIN, QUOTED, BAD, BAD],
    [QUOTED, BAD, CLOSED, QUOTED, BAD],
    [START, START, QUOTED, START, BAD],
    [START, START, QUOTED, START, BAD],
], dtype=np.uint8)
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[ord('"')], CLASS[ord(",")] = QUOTE, COMMA
CHUNK = 64

#: Reasons in the order in which they apply.
QUOTING, COLUMN_COUNT, LG_CODE, MACHIAZA_ID = "quoting", "column_count", "lg_code", "machiaza_id"
TOWN_COLUMNS = ["lg_code", "machiaza_id", "oaza_cho", "oaza_cho_kana", "chome", "rsdt_addr_flg", "efct_date", "note"]


def chunk_function(classes: np.ndarray) -> np.ndarray:
    """End state for each beginning state, of every row of a (chunks, width) array of byte classes; pad with END + 1."""
    f = np.tile(np.arange(N_STATES, dtype=np.uint8), (len(classes), 1))
    table = np.vstack([STEP, np.arange(N_STATES, dtype=np.uint8)])  # padding keeps the state
    for j in range(classes.shape[1]):
        f = table[classes[:, j, None], f]
    return f


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The function of two adjacent pieces, from the functions of either."""
    return np.take_along_axis(then, first, axis=-1)


def prefix_functions(fun: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Functions of the chunks of each record up to and with each chunk, by doubling; ``place``: each chunk's number in its record."""
    step, longest = 1, int(place.max(initial=0)) + 1
    while step < longest:
        rows = np.flatnonzero(place >= step)
        fun[rows] = compose(fun[rows - step], fun[rows])
        step *= 2
    return fun


def _grid(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes in rows of CHUNK, sizes of the records, first row of each record (and the end), and the composed functions."""
    n = len(records)
    sizes = np.fromiter(map(len, records), np.int64, n)
    chunks = np.maximum(-(-sizes // CHUNK), 1)
    begin = np.concatenate([[0], np.cumsum(chunks)])
    flat = np.full(int(begin[-1]) * CHUNK, END + 1, dtype=np.uint8)
    raw = np.frombuffer(b"".join(records), dtype=np.uint8)
    at = np.repeat(begin[:-1] * CHUNK - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(raw))
    flat[at] = CLASS[raw]
    grid = flat.reshape(-1, CHUNK)
    place = np.arange(len(grid)) - np.repeat(begin[:-1], chunks)
    return grid, sizes, begin, prefix_functions(chunk_function(grid), place)


def tokenize(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str] | None]]:
    """For each record: offset of the byte where the quoting breaks (-1: nowhere), number of fields, and the fields.

    A quote that is never closed breaks at the record's end.  The fields are None where the quoting is broken.
    """
    return _tokenize(records)[:3]


def _tokenize(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str] | None], list[list[int]]]:
    """As ``tokenize``, with the offsets at which the fields begin."""
    n = len(records)
    grid, sizes, begin, fun = _grid(records)
    flat = grid.reshape(-1)
    enter = np.full(len(grid), START, dtype=np.uint8)
    later = np.ones(len(grid), dtype=bool)
    later[begin[:-1]] = False
    enter[later] = fun[np.flatnonzero(later) - 1, START]
    table = np.vstack([STEP, np.arange(N_STATES, dtype=np.uint8)])
    state, trail = enter, np.empty_like(grid)
    for j in range(CHUNK):
        state = table[grid[:, j], state]
        trail[:, j] = state
    last = begin[1:] - 1
    final = trail[last, -1]
    flat_trail = trail.reshape(-1)
    split = (flat == COMMA) & (flat_trail == START)
    fields = np.add.reduceat(split.reshape(-1, CHUNK).sum(1), begin[:-1]) + 1 if n else np.zeros(0, np.int64)
    broken = np.full(n, -1, dtype=np.int64)
    for i in np.flatnonzero(final == BAD):
        one = flat_trail[begin[i] * CHUNK : begin[i] * CHUNK + sizes[i]]
        broken[i] = int(np.argmax(one == BAD))
    broken[final == QUOTED] = sizes[final == QUOTED]
    values: list[list[str] | None] = []
    starts: list[list[int]] = []
    cut_rows = np.flatnonzero(split)
    owner = np.searchsorted(begin * CHUNK, cut_rows, side="right") - 1
    where = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) if n else np.zeros(1, int)
    for i, rec in enumerate(records):
        if broken[i] >= 0:
            values.append(None)
            starts.append([])
            continue
        cuts = (cut_rows[where[i] : where[i + 1]] - begin[i] * CHUNK).tolist()
        row = []
        for a, b in zip([-1, *cuts], [*cuts, len(rec)]):
            v = rec[a + 1 : b].decode("utf-8", "replace")
            row.append(v[1:-1].replace('""', '"') if v[:1] == '"' else v)
        values.append(row)
        starts.append([0, *(c + 1 for c in cuts)])
    return broken, fields, values, starts


def check_digit_ok(code: str) -> bool:
    """Six ASCII digits, prefecture 01 to 47, and the last digit (11 - S mod 11) mod 10 of the first five."""
    if len(code) != 6 or not (code.isascii() and code.isdigit()) or not "01" <= code[:2] <= "47":
        return False
    s = sum(int(d) * w for d, w in zip(code, (6, 5, 4, 3, 2)))
    return int(code[5]) == (11 - s % 11) % 10


def reason_of(row: list[str] | None, broken: int, n_fields: int, width: int) -> str | None:
    if row is None or broken >= 0:
        return QUOTING
    if n_fields != width:
        return COLUMN_COUNT
    if not check_digit_ok(row[0]):
        return LG_CODE
    if len(row[1]) != 7 or not (row[1].isascii() and row[1].isdigit()):
        return MACHIAZA_ID
    return None


def offset_of(why: str | None, broken: int, starts: list[int], size: int, width: int) -> int | None:
    """Byte of the record to which a reason points: where the quoting breaks, the first field too many or the record's end, or the field at fault."""
    if why is None:
        return None
    if why == QUOTING:
        return broken
    if why == COLUMN_COUNT:
        return starts[width] if len(starts) > width else size
    return starts[0 if why == LG_CODE else 1]


def parse_records(df: DataFrame, key: str, raw: str, columns: list[str] = TOWN_COLUMNS, types: dict[str, str] | None = None) -> DataFrame:
    """Every row of df once: its key, its fields as columns or nulls, and the first reason against it.

    Result: ``line_id`` (the key's type), the given columns as strings, ``reason`` (null for a valid row) and ``reason_offset``
    (the byte in the record to which the reason points, null for a valid row).  ``types`` (column -> Spark type) casts columns of valid rows, a
    value that the type can't hold becoming null.  The first two columns must be an lg_code
    and a machiaza_id.  A null record has the reason ``column_count`` (it has no fields); an empty one is one
    empty field and has it too.  One carriage return at the end is dropped.  Other columns of df don't matter.
    Rows are independent: no shuffle, and memory is that of one Arrow batch.
    """
    kind = df.schema[key].dataType
    schema = "line_id string, " + ", ".join(f"`{c}` string" for c in columns) + ", reason string, reason_offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            missing = pdf["raw"].isna().to_numpy()
            texts = ["" if m else (t[:-1] if t.endswith("\r") else t) for t, m in zip(pdf["raw"], missing)]
            raw_bytes = [t.encode() for t in texts]
            broken, n_fields, rows, starts = _tokenize(raw_bytes)
            n_fields = np.where(missing, 0, n_fields)
            why = [reason_of(r, b, n, len(columns)) for r, b, n in zip(rows, broken, n_fields)]
            cells = [r if w is None else [None] * len(columns) for r, w in zip(rows, why)]
            out = pd.DataFrame(cells, columns=columns, dtype=object)
            out.insert(0, "line_id", pdf["line_id"].to_numpy())
            out["reason"] = pd.Series(why, dtype=object)
            out["reason_offset"] = pd.array([offset_of(w, b, f, len(r), len(columns)) for w, b, f, r in zip(why, broken, starts, raw_bytes)], dtype="Int64")
            yield out

    out = df.select(F.col(key).cast("string").alias("line_id"), F.col(raw).alias("raw")).mapInPandas(run, schema)
    out = out.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})
    return out.withColumn("line_id", F.col("line_id").cast(kind))  # as text on the way, so that null ids and large ones survive


def line_functions(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each line, whether a quoted field is open after it if none, and if one, is open before it; the line's end closes anything else."""
    if not lines:
        return np.zeros(0, bool), np.zeros(0, bool)
    _, _, begin, fun = _grid(lines)
    last = fun[begin[1:] - 1]
    return last[:, START] == QUOTED, last[:, QUOTED] == QUOTED


def _split_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every split: whether a field is open at its end if none, and if one, was open before; and its bytes."""
    splits: dict = {}
    for pdf in batches:
        for key, part in pdf.groupby(["file", "block"], sort=False):
            lines = [t.encode() for t in part["value"]]
            f = splits.setdefault(key, [False, True, 0])
            for closed, opened in zip(*line_functions(lines)):
                f[0], f[1] = (opened if f[0] else closed), (opened if f[1] else closed)
            f[2] += sum(map(len, lines)) + len(lines)
    if splits:
        yield pd.DataFrame([(*k, bool(a), bool(b), n) for k, (a, b, n) in splits.items()], columns=["file", "block", "closed", "opened", "bytes"])


def _split_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each split; what continues the record before it (head), and what its end leaves open (tail), apart."""
    state: dict = {}  # split -> [offset, begin of the open record, its lines]
    for pdf in batches:
        out = []
        for key, part in pdf.groupby(["file", "block"], sort=False):
            at = state.setdefault(key, [int(part["begin"].iloc[0]), int(part["begin"].iloc[0]), [], bool(part["inside"].iloc[0]), bool(part["inside"].iloc[0])])
            lines = list(part["value"])
            for line, closed, opened in zip(lines, *line_functions([t.encode() for t in lines])):
                at[2].append(line)
                at[0] += len(line.encode()) + 1
                if not (opened if at[3] else closed):
                    out.append((*key, at[1], "head" if at[4] else "whole", "\n".join(at[2])))
                    at[1], at[2], at[3], at[4] = at[0], [], False, False
                else:
                    at[3] = True
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "offset", "what", "raw"])
    rest = [(*key, at[1], "through" if at[4] else "tail", "\n".join(at[2])) for key, at in state.items() if at[2]]
    if rest:
        yield pd.DataFrame(rest, columns=["file", "block", "offset", "what", "raw"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, raw): records of text files, with the byte at which each begins; line breaks inside quotes belong to the record.

    Files are read twice in splits of any size, and no line is shuffled but those of records that cross a cut.  Three small rows a
    split are: its function, and at most two fragments.  A quote that is never closed makes the rest of its file, without
    its last line break, one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = Stage(spark, "splits").keep(lines.mapInPandas(_split_functions, "file string, block long, closed boolean, opened boolean, bytes long"))
    w = Window.partitionBy("file").orderBy("block")
    # composition of the functions before a split: the last constant one decides, turned by those after it that exchange both states
    fixed = F.when(F.col("closed") == F.col("opened"), F.col("closed"))
    turns = F.sum((F.col("closed") & ~F.col("opened")).cast("int")).over(w)
    splits = splits.withColumns({"_fixed": fixed, "_turns": turns}).withColumn("_at", F.when(F.col("_fixed").isNotNull(), F.col("_turns")))
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    odd = (F.coalesce(F.lag("_turns").over(w), F.lit(0)) - F.coalesce(last("_at"), F.lit(0))) % 2 == 1
    inside = F.coalesce(last("_fixed"), F.lit(False)) != odd
    begin = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = splits.select("file", "block", inside.alias("inside"), begin.alias("begin"))
    # one row a split of, say, 128 MB; a shuffle would lose the order of the lines
    found = lines.join(F.broadcast(known), ["file", "block"]).mapInPandas(_split_records, "file string, block long, offset long, what string, raw string")
    found = Stage(spark, "records").keep(found)
    parts = found.where("what <> 'whole'")
    first = F.last(F.when(F.col("what") == "tail", F.col("offset")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    order = F.struct("offset", "raw")
    crossing = parts.withColumn("_first", first).groupBy("file", "_first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["raw"]), "\n").alias("raw"))
    return found.where("what = 'whole'").select("file", "offset", "raw").unionByName(crossing.select("file", F.col("_first").alias("offset"), "raw"))
