"""Line dedup by repeated runs of lines.

Runs are built from units: every window of two neighbouring lines, and each line
of `LONG` words or more by itself; blank lines are passed over.  A window's hash
rolls over the hashes of its lines, so it depends on nothing outside, and a run
that several texts share is the union of its windows wherever it stands; the
edges of a run are where windows stop being repeated.  (Boundaries that a hash
condition picks within the lines miss short passages: see README.)

Windows are counted by digest first (64 bits each).  Only the lines of windows
whose digest comes twice are fetched with their bytes; lines are the same if
their 128-bit digests are and the least and greatest text of that digest agree,
byte for byte.  An occurrence of a unit is removed if an earlier one, by
(doc_id, text hash, line), is kept whole, and if the run of such lines has
`LEAST` words.  Whether the earlier one is kept depends on what stands before
it, so this is decided in rounds over the repeated units alone (a few numbers a
row) until nothing changes: what a text decides rests on earlier texts only, so
each round settles at least the first that was wrong.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import _IS_SPACE, _ODD, _P, for_python, mix, query, read, stored, text_blocks, trimmed

LONG, LEAST = 50, 25
#: Positions of the bit map of repeated digests that spares other chunks.
BITS = 1 << 22


def _n_words(line: str) -> int:
    return len(line.encode().split())


def without(text: str, spans) -> tuple[str, int]:
    """A text without the lines of `spans` (by non-blank line), and how many
    of them went: only runs of LEAST words or more do.  A blank line goes with
    the line before it."""
    if spans is None or not len(spans):
        return text, 0
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
    gone = np.zeros(len(full) + 1, bool)
    for i, j in spans:
        gone[i:j] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    for i, j in zip(edges[::2], edges[1::2]):
        if sum(_n_words(lines[full[k]]) for k in range(i, j)) < LEAST:
            gone[i:j] = False
    keep, last = [], True
    own = iter(gone[:len(full)])
    at = set(full)
    for i, x in enumerate(lines):
        if i in at:
            last = not next(own)
        if last:
            keep.append(x)
    return "\n".join(keep), int(gone.sum())


def _layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to, words) of the non-blank lines of a block of texts, as
    `without` and `_n_words` have them."""
    full = ~_IS_SPACE[data]
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    cut = off[:-1][off[:-1] < len(data)]
    starts[cut] = full[cut]  # a text's first word starts there, whatever ends the text before
    ends = np.flatnonzero(data == 10)
    # by text both are in order, so sorting pairs them
    begin, end = np.sort(np.concatenate([off[:-1], ends + 1])), np.sort(np.concatenate([ends, off[1:]]))
    at = np.flatnonzero(starts)
    words = np.searchsorted(at, end) - np.searchsorted(at, begin)
    begin, end, words = begin[words > 0], end[words > 0], words[words > 0]
    return np.searchsorted(off, begin, "right") - 1, begin, end, words


def _each(batch):
    """(row, from, to, words of each non-blank line, bytes, the long lines, the
    lines that have a next one, hashes of the units) of each block of texts: a
    unit is a long line or two neighbours, whose hash rolls over those of the
    lines."""
    for first, data, off in text_blocks(batch.column("text")):
        text, begin, end, words = _layout(data, off)
        if not len(text):
            continue
        raw = data.tobytes()
        h = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(begin.tolist(), end.tolist())], np.uint64)
        long, pair = np.flatnonzero(words >= LONG), np.flatnonzero(text[1:] == text[:-1])
        hashes = np.concatenate([mix(h[long] + _ODD[0]), mix(h[pair] * _P + h[pair + 1] * _ODD[1])])
        yield first + text, begin, end, words, raw, long, pair, hashes


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [x[-1] for x in _each(b)]
            out = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["digest"])
    return docs.select("text").mapInArrow(trimmed(run), "digest long")


def _lines(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_id, hash, line, words, digest, text) of the lines of units whose
    digest is repeated (and of a few others that share a place of the bit map)."""
    at = digests.select(F.pmod(F.col("digest"), F.lit(BITS)).cast("int").alias("b")).distinct()
    bits = np.zeros(BITS, bool)
    bits[at.toPandas()["b"].to_numpy(np.int64)] = True  # at most BITS integers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        mask = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for row, begin, end, words, raw, long, pair, h in _each(b):
                # Spark's pmod is of signed numbers
                hit = mask[np.mod(h.view(np.int64), BITS)]
                own = np.zeros(len(row), bool)
                own[long[hit[:len(long)]]] = True
                two = pair[hit[len(long):]]
                own[two] = own[two + 1] = True
                k = np.flatnonzero(own)
                if len(k):
                    x = [raw[i:j] for i, j in zip(begin[k].tolist(), end[k].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(row[k])), b.column("hash").take(pa.array(row[k])),
                         pa.array(k - np.searchsorted(row, row[k])), pa.array(words[k]),
                         pa.array([xxhash.xxh3_128_digest(t) for t in x], pa.binary()),
                         pa.array(x, pa.binary()).cast(pa.string())], names=names)

    names = ["doc_id", "hash", "line", "words", "digest", "text"]
    return docs.select("doc_id", "hash", "text").mapInArrow(
        trimmed(run), "doc_id long, hash long, line long, words long, digest binary, text string")


def _named(found: DataFrame) -> DataFrame:
    """Lines with `lid`, the same for equal bytes alone, of those that come twice."""
    same = stored(found.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"),
                                              F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "digest", (F.col("a") == F.col("b")).alias("agree"), F.monotonically_increasing_id().alias("lid")), "lines")
    rows = found.select("doc_id", "hash", "line", "words", "digest")
    named = rows.join(same.filter("agree"), "digest").select("doc_id", "hash", "line", "words", "lid")
    apart = same.filter("NOT agree").select("digest")
    if apart.isEmpty():
        return named
    # different lines of one digest: told apart by their bytes
    odd = found.join(apart, "digest", "left_semi")
    by_text = stored(odd.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "text", (-1 - F.monotonically_increasing_id()).alias("lid")), "lines")
    return named.unionByName(odd.join(by_text, "text").select("doc_id", "hash", "line", "words", "lid"))


def _occurrences(named: DataFrame) -> DataFrame:
    """(doc_id, hash, line, to, words, a, b): the units made of named lines that
    come in two places, `words` of each line, `a` and `b` their lines (b is -1
    for a long line by itself).  Rows equal in doc_id and text are one text."""
    texts = named.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct("line", "lid", "words"))).alias("l"))
    none = F.lit(-1).cast("long")

    def pair(x, i):
        nxt = F.get("l", i + 1)
        return F.when(nxt["line"] == x["line"] + 1, F.struct(
            x["line"].alias("line"), (x["line"] + 2).alias("to"), F.array(x["words"], nxt["words"]).alias("words"),
            x["lid"].alias("a"), nxt["lid"].alias("b")))

    alone = F.transform(F.filter("l", lambda x: x["words"] >= LONG), lambda x: F.struct(
        x["line"].alias("line"), (x["line"] + 1).alias("to"), F.array(x["words"]).alias("words"),
        x["lid"].alias("a"), none.alias("b")))
    both = F.concat(F.array_compact(F.transform("l", pair)), alone)
    rows = stored(texts.select("doc_id", "hash", F.explode(both).alias("u")).select("doc_id", "hash", "u.*"), "units")
    twice = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    return rows.join(stored(twice, "units"), ["a", "b"])


def settle(rows: list[tuple]) -> tuple[list[bool], list[tuple[int, int]]]:
    """Of one text, given (line, to, words, unit, whether an earlier text keeps
    the unit whole) in order: which units lose a line, and the runs that go."""
    gone: dict[int, int] = {}  # line -> words
    kept: dict = {}
    for line, to, words, unit, earlier in rows:
        here = kept.get(unit)
        if earlier or (here is not None and here[1] <= line and not any(k in gone for k in range(*here))):
            gone.update(zip(range(line, to), words))
        elif here is None or any(k in gone for k in range(*here)):
            kept[unit] = (line, to)
    runs: list[list[int]] = []
    for k in sorted(gone):
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    runs = [(i, j) for i, j in runs if sum(gone[k] for k in range(i, j)) >= LEAST]
    lost = {k for i, j in runs for k in range(i, j)}
    return [any(k in lost for k in range(line, to)) for line, to, *_ in rows], runs


_TURN_DDL = ("doc_id long, hash long, units array<struct<line:long,to:long,words:array<long>,a:long,b:long,lost:boolean>>, "
             "spans array<struct<line:long,to:long>>, moved boolean")


def _decide(batches):
    for b in batches:
        units = b.column("units")
        ends = _ends(units)
        u = dict(zip((f.name for f in units.type.value_type), units.flatten().flatten()))
        to_words = _ends(u["words"])
        words = u["words"].flatten()
        line, to, a, b_, earlier, was = (u[c].to_pylist() for c in ("line", "to", "a", "b", "earlier", "lost"))
        n, flat = to_words.tolist(), words.to_pylist()
        lost, spans, count, moved = [], [], [0], []
        for i, j in zip(ends.tolist(), ends[1:].tolist()):
            now, runs = settle([(line[k], to[k], flat[n[k]:n[k + 1]], (a[k], b_[k]), earlier[k]) for k in range(i, j)])
            lost += now
            spans += runs
            count.append(len(spans))
            moved.append(now != was[i:j])
        turned = pa.StructArray.from_arrays(
            [u["line"], u["to"], pa.ListArray.from_arrays(pa.array(to_words), words), u["a"], u["b"],
             pa.array(lost, pa.bool_())], fields=list(_UNIT))
        gone = pa.StructArray.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in (0, 1)], fields=list(_SPAN))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("hash"), pa.ListArray.from_arrays(pa.array(ends), turned),
             pa.ListArray.from_arrays(pa.array(count, pa.int32()), gone), pa.array(moved, pa.bool_())], schema=_TURN)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where the lists begin among all their values, and the end."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)


_UNIT = pa.struct([("line", pa.int64()), ("to", pa.int64()), ("words", pa.list_(pa.int64())), ("a", pa.int64()),
                   ("b", pa.int64()), ("lost", pa.bool_())])
_SPAN = pa.struct([("line", pa.int64()), ("to", pa.int64())])
_TURN = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("units", pa.list_(_UNIT)),
                   ("spans", pa.list_(_SPAN)), ("moved", pa.bool_())])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, spans): the runs of non-blank lines that go."""
    rows = for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text"))
    twice = _digests(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    found = stored(_lines(rows, stored(twice, "digests")), "lines")
    state = _occurrences(stored(_named(found), "lines")).withColumn("lost", F.lit(False))
    state = stored(state, "units")
    while True:
        # the first text that keeps a unit whole; stored, so that the join can
        # split a passage that stands everywhere
        whole = stored(state.filter("NOT lost").groupBy("a", "b").agg(
            F.min(F.struct("doc_id", "hash")).alias("first")), "whole")
        own = F.struct("doc_id", "hash")
        judged = state.join(whole, ["a", "b"], "left").withColumn(
            "earlier", F.coalesce(F.col("first") < own, F.lit(False)))
        texts = judged.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(
            F.struct("line", "to", "words", "a", "b", "earlier", "lost"))).alias("units"))
        turn = stored(for_python(texts).mapInArrow(trimmed(_decide), _TURN_DDL), "turn")
        if turn.filter("moved").isEmpty():
            return turn.filter(F.size("spans") > 0).select("doc_id", "hash", "spans")
        state = turn.select("doc_id", "hash", F.explode("units").alias("u")).select("doc_id", "hash", "u.*")


def deduplicated(docs: DataFrame, n_removed: str | None = None) -> DataFrame:
    """`docs`, all rows and columns, with repeated runs of lines taken from
    `text`; n_chars, if there, follows it.  `n_removed` names a column for the
    number of lines that went.

    A null or empty text stays as it is.  What goes stands whole in an
    earlier text or place, by (doc_id, hash of the text, line), a null doc_id first; rows equal
    in doc_id and text count as one document and are treated alike.  An empty
    table gives no rows.
    """
    spans = repeated_spans(docs).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "spans")

    @F.pandas_udf("text string, gone long")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else without(t, [(s["line"], s["to"]) for s in p] if p is not None else None)
                             for t, p in zip(text, spans)], columns=["text", "gone"])

    names = docs.columns
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_key"),
                      F.xxhash64("text").alias("_own"))
    out = own.join(spans, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    # every row goes through Python, but only texts with something to remove go along
    some = F.when(F.col("spans").isNotNull(), F.col("_row.text"))
    out = out.withColumn("_new", cut(some, F.col("spans")))
    text = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(F.col("_new.text"))
    cols = [text.alias(c) if c == "text"
            else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("_row")[c].alias(c) for c in names]
    if n_removed:
        cols.append(F.coalesce(F.col("_new.gone"), F.lit(0).cast("long")).alias(n_removed))
    return out.select(*cols)


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), "n_removed_lines")
