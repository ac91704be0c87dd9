"""Best-fit decreasing packing of whole documents into training sequences.

Documents go in by descending length, each into the open sequence that it
leaves with the least room; a segment tree over the remaining capacities finds
that one in logarithmic time, and a new sequence is opened only when none has
room.  Documents of one length are alike, and so are sequences with the same
room, so the tree holds numbers of sequences, and a step places all documents
of a length that the tightest capacity takes.  That gives the very packing of
the document-by-document rule over *all* rows, while the plan depends on the
capacity alone and not on the number of documents: the driver gets a count for
each length and gives back runs ("the i-th to j-th document of length L go to
sequences from s on, at offset o").  Ranks within a length come from counts
for each task and length, so no group is ever gathered, however many documents
share a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, stored
from fitlake.llm.packing import WordTokens, merged, word_tokenizer


class CapacityTree:
    """A segment tree over remaining capacities 0..n: numbers of open
    sequences, and the smallest capacity >= x that has one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, x: int) -> int | None:
        if x >= self.size:
            return None
        i = x + self.size
        if self.count[i]:
            return x
        # up until a right neighbour holds something, then down its left edge
        while i > 1 and (i & 1 or not self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i <<= 1
            if not self.count[i]:
                i += 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, rank, documents, per sequence, first sequence, offset):
    of the documents of `length`, those from `rank` on go `per sequence` at a
    time into consecutive sequences, side by side from `offset` on."""
    tree, open_, runs, fresh = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, k = capacity, capacity // length
                first, n = fresh, -(-left // k)
                fresh += n
            else:
                k = room // length
                first, n = open_[room].pop()
                tree.add(room, -n)
            full = min(n, left // k)
            took = [(full, k)] if full else []
            if full < n and left > full * k and left < (full + 1) * k:
                took.append((1, left - full * k))
            for m, k_ in took:
                runs.append((length, rank, m * k_, k_, first, capacity - room))
                after = room - k_ * length
                open_[after].append((first, m))
                tree.add(after, m)
                rank, left, first, n = rank + m * k_, left - m * k_, first + m, n - m
            if n:
                open_[room].append((first, n))
                tree.add(room, n)
    return np.array(runs, np.int64).reshape(-1, 6)


def placed(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of documents given by length and rank."""
    # runs of a length follow one another by rank: one sorted key finds a document's run
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    at = np.zeros(len(length), np.int64)
    for x in np.unique(length):
        lo, hi = np.searchsorted(plan[:, 0], [x, x + 1])
        mine = length == x
        at[mine] = lo + np.searchsorted(plan[lo:hi, 1], rank[mine], "right") - 1
    run = plan[at]
    i = rank - run[:, 1]
    return run[:, 4] + i // run[:, 3], run[:, 5] + i % run[:, 3] * length


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """The documents' pieces, each with its task and its place among the
    task's pieces of the same length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, met = TaskContext.get().partitionId(), [0] * (tokens + 1)
        for b in merged(batches):
            out = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for key, ids in zip(b.column("doc_id").to_pylist(), WordTokens(tokenizer)(texts)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * tokens)):
                    x = ids[lo:lo + 4 * tokens]
                    n = len(x) // 4
                    out.append((key, k, lo // 4, n, zlib.crc32(x), part, met[n]))
                    met[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)],
                                                 schema=_PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return for_python(rows).mapInArrow(run, _PIECES_DDL)


def best_fit_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tokens: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row
    for each piece: whole documents (their ids by `tokenizer`, the path of a
    tokenizers file that drops white space, and `end_id`), packed best-fit
    decreasing over all rows.  Only a document of more than `tokens` ids is
    cut, into pieces of `tokens` and a last one of what is left.

    A null or empty text is its end id alone.  Repeated rows and null ids are
    documents of their own; of documents of one length, which goes where
    depends on the files' order.  An empty table gives no rows; other columns
    are not read.
    """
    pieces = stored(_pieces(docs, tokenizer, end_id, tokens), "best-fit")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "best-fit-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= tokens rows
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_plan(totals, tokens))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = placed(plan.value, length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_documents(read(spark, sf_dir, "documents"), word_tokenizer())
