"""Ranked lexical search of a query set by dual trees.

Both sides are hierarchies whose nodes hold coordinate maxima: an item node
the largest weighted count that any of its items has of each term, a document
node the largest contribution that any of its documents makes for each term.
The dot product of two nodes is at least the score of any item below the one
with any document below the other; if it is under the weakest k-th score that
the node's items have so far, the whole batch of pairs is passed over, and no
result is lost by it.  All sums are of whole numbers and exact.

Spark deals out the documents: a first pass turns each text into its number of
terms and the counts of the items' terms (stored, a fraction of the text); the
second builds a tree for each batch of rows and searches it for all items of a
block.  Tasks give their k best rows an item, which are merged in two steps.
Items are handled in blocks of bounded size, one pass for each block.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, stored

#: A block of items: so many at most, and so many distinct terms (or one item).
BLOCK_ITEMS, BLOCK_TERMS = 512, 16_384
#: Rows below a leaf of the trees; rows that others are compared with to lay them out.
LEAF_ITEMS, LEAF_DOCS, PIVOTS = 8, 16, 8
#: Documents that are searched first, for thresholds that prune from the start.
FIRST_DOCS = 2048
#: Tasks' results are merged in so many groups an item first.
MERGES = 16

#: Byte by byte: A-Z to a-z, digits, letters and all of UTF-8 beyond ASCII stay, the rest separates.
_TERM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32
              for i in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM).split() if text else []


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of (item_id, counts of its terms), each small enough for the driver and a broadcast."""
    block, seen = [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        count = Counter(terms(r.text))
        if block and (len(block) == BLOCK_ITEMS or len(seen | count.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((r.item_id, count))
        seen |= count.keys()
    if block:
        yield block


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): number of all terms of a document and counts
    of those in the (broadcast) vocabulary; documents without terms go."""
    def run(batches):
        number = vocabulary.value
        for b in batches:
            ids, sizes, found, tfs = [], [], [], []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                all_ = terms(text)
                if all_:
                    count = Counter(filter(number.__contains__, all_))
                    ids.append(key), sizes.append(len(all_))
                    found.append([number[t] for t in count]), tfs.append(list(count.values()))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                     pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return for_python(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """Rows of a matrix halved again and again, down to leaves of at most
    `leaf` rows.  Rows are laid out by which of a few rows, each as unlike the
    earlier ones as can be, they are most like, so that a half holds like rows."""

    def __init__(self, x: np.ndarray, leaf: int, rows: np.ndarray | None = None):
        self.rows = np.arange(len(x)) if rows is None else rows
        self.kids: list[Tree] = []
        if len(self.rows) > leaf:
            mine = x[self.rows]
            mine = mine / (np.sqrt((mine * mine).sum(axis=1, keepdims=True)) + 1e-9)
            likes = [mine @ mine[0]]
            while len(likes) < PIVOTS:
                likes.append(mine @ mine[np.max(likes, axis=0).argmin()])
            likes = np.array(likes)
            order = np.lexsort((-likes.max(axis=0), likes.argmax(axis=0)))
            half = len(order) // 2
            self.kids = [Tree(x, leaf, self.rows[o]) for o in (order[:half], order[half:])]

    def maxima(self, x: np.ndarray) -> np.ndarray:
        self.top = (np.maximum(*(k.maxima(x) for k in self.kids)) if self.kids else x[self.rows].max(axis=0))
        return self.top

    def nodes(self) -> list[Tree]:
        return [self] + [n for k in self.kids for n in k.nodes()]


class Search:
    """The items of a block, and the k best documents of each so far.  An item
    is (weight of each of its terms) as a row of `weights`."""

    def __init__(self, weights: np.ndarray, k: int, floor: np.ndarray):
        self.k, self.weights = k, weights
        self.floor = floor.copy()  # what a score must reach to count
        self.best: list[list[tuple]] = [[] for _ in weights]  # (-score, doc id last if null, doc id)
        self.tree = Tree(weights.astype(np.float32), LEAF_ITEMS)
        self.tree.maxima(weights)
        self.used = {id(n): np.flatnonzero(n.top) for n in self.tree.nodes()}
        self.pairs = 0

    def documents(self, ids: list, values: np.ndarray, columns: np.ndarray) -> None:
        """Searches documents, given as rows of contributions for the terms `columns`."""
        at = np.full(self.weights.shape[1], -1)
        at[columns] = np.arange(len(columns))
        tree = Tree(values, LEAF_DOCS)
        tree.maxima(values)
        here: dict[int, tuple] = {}

        def mine(node: Tree):
            """An item node's columns among those of these documents, and its weights there."""
            if id(node) not in here:
                cols = at[self.used[id(node)]]
                t = self.used[id(node)][cols >= 0]
                here[id(node)] = cols[cols >= 0], node.top[t], None if node.kids else self.weights[node.rows][:, t].T
            return here[id(node)]

        def bound(i: Tree, d: Tree, items: np.ndarray | None) -> np.ndarray:
            """What a node's items can score at most with a document below d;
            at a leaf of the items, for each of those still searched for."""
            cols, top, w = mine(i)
            best = d.top[cols].astype(top.dtype)
            return best @ w[:, items] if w is not None else np.array([best @ top])

        def visit(i: Tree, d: Tree, items: np.ndarray | None, most: np.ndarray):
            if i.kids:
                if most[0] < self.floor[i.rows].min():
                    return
            else:
                items = items[most >= self.floor[i.rows[items]]]
                if not len(items):
                    return
            if not i.kids and not d.kids:
                cols, _, w = mine(i)
                which = i.rows[items]
                self.pairs += len(items) * len(d.rows)
                scores = values[d.rows][:, cols].astype(w.dtype) @ w[:, items]
                for r, c in zip(*np.nonzero(scores >= self.floor[which])):
                    self._add(int(which[c]), ids[d.rows[r]], int(scores[r, c]))
                return
            below = []
            for a in i.kids or [i]:
                rest = items if not i.kids else None if a.kids else np.arange(len(a.rows))
                below += [(a, b, rest, bound(a, b, rest)) for b in d.kids or [d]]
            for a, b, rest, most_ in sorted(below, key=lambda x: -x[3].max()):
                visit(a, b, rest, most_)

        whole = None if self.tree.kids else np.arange(len(self.tree.rows))
        visit(self.tree, tree, whole, bound(self.tree, tree, whole))

    def _add(self, item: int, doc, score: int) -> None:
        if score < self.floor[item]:
            return
        best = self.best[item]
        insort(best, (-score, doc is None, doc or 0))
        del best[self.k:]
        if len(best) == self.k:
            self.floor[item] = max(self.floor[item], -best[-1][0])


_FOUND_DDL = "item int, item_id long, doc_id long, score long, part int"


def _searched(counted: DataFrame, block, n_docs: int, n_terms: int, k: int, floor: list[int]) -> DataFrame:
    """The k best documents an item of each task."""
    def run(batches):
        item_ids, weights = block.value
        search = Search(weights, k, np.array(floor, weights.dtype))
        part = TaskContext.get().partitionId()
        for b in batches:
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            number = b.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            columns, at = np.unique(number, return_inverse=True)
            values = np.zeros((len(sizes), len(columns)), np.float32)  # under 10**6: exact
            values[row, at] = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            if len(columns):
                search.documents(b.column("doc_id").to_pylist(), values, columns)
        out = [(i, item_ids[i], None if null else doc, -s, part)
               for i, best in enumerate(search.best) for s, null, doc in best]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["item", "item_id", "doc_id", "score", "part"])

    return for_python(counted).mapInArrow(run, _FOUND_DDL)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked, by way of MERGES groups an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("item", F.col("part") % MERGES).orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `items` (item_id, text)
    its k best rows of `docs` (doc_id, text) with a score above 0, by falling
    score, then doc_id (null last).

    Terms are runs of ASCII letters and digits and of any code points beyond
    ASCII, A-Z lower-cased.  Null and empty texts have no terms: such items
    find nothing, such documents are not found and not counted.  Rows that
    repeat are items or documents of their own.  Without items or documents
    there are no rows.
    """
    spark, parts = docs.sparkSession, []
    for block in item_blocks(items):
        names = sorted(set().union(*(c.keys() for _, c in block)))
        if not names:
            continue
        number = {t: i for i, t in enumerate(names)}
        counted = stored(_counted(docs, spark.sparkContext.broadcast(number)), "search-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = {r.t: r.df for r in counted.select(F.explode("terms").alias("t")).groupBy("t")
              .agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each term of the block
        w = [weight(n_docs, df.get(i, 0)) for i in range(len(names))]
        most = max(sum(c * w[number[t]] for t, c in count.items()) for _, count in block) * 1_000_000
        # doubles add whole numbers below 2**53 exactly
        weights = np.zeros((len(block), len(names)), np.float64 if most < 1 << 53 else np.int64)
        for i, (_, count) in enumerate(block):
            for t, c in count.items():
                weights[i, number[t]] = c * w[number[t]]
        sent = spark.sparkContext.broadcast(([i for i, _ in block], weights))
        floor = [1] * len(block)
        first = _best(_searched(counted.limit(FIRST_DOCS), sent, n_docs, n_terms, k, floor).withColumn(
            "item_id", F.col("item").cast("long")), k)
        for r in first.filter(F.col("rank") == k).collect():  # a row for each item of the block
            floor[r.item_id] = r.score
        parts.append(_best(_searched(counted, sent, n_docs, n_terms, k, floor), k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


_SQL = r"""
WITH doc_terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
item_terms AS (
  SELECT row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS row FROM benchmark)),
sizes AS (SELECT row, doc_id, count(*) AS n FROM doc_terms GROUP BY ALL),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
tf AS (SELECT row, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
wanted AS (SELECT row, item_id, term, count(*) AS c FROM item_terms GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, nd),
scores AS (
  SELECT wanted.row, item_id, doc_id, tf.row AS doc_row,
         CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes ON sizes.row = tf.row, total
  GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_lexical_search", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))
