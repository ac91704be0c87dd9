"""Benchmark decontamination by greedy string tiling.

A document is held against a benchmark item when they share a seed, a run of
`min_match` words.  For such a pair greedy string tiling marks the longest
matches of words that no earlier match covers, again and again, from long to
short; candidates of a length come from running Karp-Rabin window hashes and
are extended word by word.  The share of the item's words under tiles is its
coverage; reordered sentences of an item are caught because tiles may stand
in any order.  Every text is read whole, once for each block of the
benchmark, and nothing is shuffled: a block of at most BLOCK_BYTES of items is
sent to all tasks, and larger benchmarks take several passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import NOT_ALNUM, for_python, mix, query, read, text_blocks, trimmed, word_hashes, _ODD

#: Bytes of benchmark text that tasks hold at a time.
BLOCK_BYTES = 8 << 20
_MAP = 1 << 20


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words, by prefix sums."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, inv = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    p, q = np.full(len(h), base, np.uint64), np.full(n, inv, np.uint64)
    p[0] = q[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(p))])
    return mix((total[size:] - total[:n]) * np.cumprod(q) + _ODD[size % 64])


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` words without a marked word."""
    n = len(marked) - size + 1
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:n]) if n > 0 else np.zeros(0, np.int64)


def _matches(a, b, ma, mb, size):
    """Maximal runs (length, i, j) of unmarked equal words, `size` or longer;
    stops at the first that is longer than twice `size`."""
    ia, ib = _free(ma, size), _free(mb, size)
    if not len(ia) or not len(ib):
        return []
    at: dict[int, list[int]] = {}
    for i, h in zip(ia.tolist(), window_hashes(a, size)[ia].tolist()):
        at.setdefault(h, []).append(i)
    hb = window_hashes(b, size)[ib]
    hit = np.isin(hb, np.fromiter(at, np.uint64, len(at)))
    found = []
    for j, h in zip(ib[hit].tolist(), hb[hit].tolist()):
        for i in at[h]:
            if i and j and a[i - 1] == b[j - 1] and not ma[i - 1] and not mb[j - 1]:
                continue  # part of the run that starts one word earlier
            n = 0
            while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                   and not ma[i + n] and not mb[j + n]):
                n += 1
            if n >= size:
                found.append((n, i, j))
                if n > 2 * size:
                    return found
    return found


def tiles(a: np.ndarray, b: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (length, i, j)
    of non-overlapping equal runs, `min_match` words or longer."""
    ma, mb = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out, size = [], max(min_match, 16)
    while True:
        found = _matches(a, b, ma, mb, size)
        longest = max((m[0] for m in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not ma[i:i + n].any() and not mb[j:j + n].any():
                ma[i:i + n] = mb[j:j + n] = True
                out.append((n, i, j))
        if found:
            continue  # what a longer tile has cut may still hold a run of this size
        if size == min_match:
            return out
        size = max(min_match, size // 2)


class Index:
    """Seeds of a block of items: (item, its words' hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_match: int):
        self.items, self.min_match = items, min_match
        self.by_size = {}
        for size in {min(min_match, len(h)) for _, h in items if len(h)}:
            own = [(k, window_hashes(h, size)) for k, (_, h) in enumerate(items) if min(min_match, len(h)) == size]
            seeds = np.concatenate([s for _, s in own])
            of = np.concatenate([np.full(len(s), k) for k, s in own])
            order = np.argsort(seeds, kind="stable")
            bits = np.zeros(_MAP, bool)
            bits[(seeds % np.uint64(_MAP)).astype(np.int64)] = True
            self.by_size[size] = seeds[order], of[order], bits

    def found(self, h: np.ndarray):
        """(item, its words, words under tiles) for items sharing a seed."""
        held: set[int] = set()
        for size, (seeds, of, bits) in self.by_size.items():
            w = window_hashes(h, size)
            w = np.unique(w[bits[(w % np.uint64(_MAP)).astype(np.int64)]])
            for lo, hi in zip(np.searchsorted(seeds, w), np.searchsorted(seeds, w, "right")):
                held.update(of[lo:hi].tolist())
        for k in sorted(held):
            item, a = self.items[k]
            yield item, len(a), sum(n for n, _, _ in tiles(a, h, min(self.min_match, len(a))))


def _text_words(col):
    """The hashes of each text's words."""
    for _, data, off in text_blocks(col):
        h, doc = word_hashes(data, off, NOT_ALNUM)
        at = np.searchsorted(doc, np.arange(len(off)))
        for r in range(len(off) - 1):
            yield h[at[r]:at[r + 1]]


def _blocks(benchmark: DataFrame, min_match: int):
    """The benchmark as broadcast indexes of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * int(total) // BLOCK_BYTES) or 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        hashes = list(_text_words(pa.array([r["text"] for r in rows], pa.large_string()))) if rows else []
        yield benchmark.sparkSession.sparkContext.broadcast(
            Index([(r["item_id"], h) for r, h in zip(rows, hashes)], min_match))


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_matched, coverage) of the pairs whose
    coverage reaches `least`.

    Words are runs of letters and digits (everything outside ASCII counts as
    such), A-Z folded.  An item with fewer words than `min_match` must stand
    whole.  Null or empty texts and items match nothing; repeated rows of
    `docs` give a row each, repeated items one; null ids are carried.
    """
    def scan(shared):
        def run(batches):
            for b in batches:
                out = [(r, i, n, m) for r, h in enumerate(_text_words(b.column("text")))
                       for i, n, m in shared.value.found(h) if m >= least * n]
                if out:
                    r, i, n, m = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(r)), pa.array(i, pa.int64()), pa.array(n, pa.int64()),
                         pa.array(m, pa.int64()), pa.array(np.array(m) / np.array(n))], names=names)
        return run

    names = ["doc_id", "item_id", "n_item_words", "n_matched", "coverage"]
    rows = for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = None
    for shared in _blocks(benchmark, min_match):
        part = rows.mapInArrow(trimmed(scan(shared)), "doc_id long, item_id long, n_item_words long, n_matched long, coverage double")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, least: float = 0.5) -> DataFrame:
    """`docs`, whole rows, without those that `contamination` names."""
    def keep(shared):
        def run(batches):
            for b in batches:
                clean = [not any(m >= least * n for _, n, m in shared.value.found(h))
                         for h in _text_words(b.column("text"))]
                yield b.filter(pa.array(clean, pa.bool_()))
        return run

    for shared in _blocks(benchmark, min_match):
        docs = for_python(docs).mapInArrow(trimmed(keep(shared)), docs.schema)
    return docs


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
