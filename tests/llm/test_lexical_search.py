"""op12: ranked lexical search against a plain scoring of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fitlake.llm import lexical_search
from fitlake.llm.lexical_search import Search, Tree, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(items, docs, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        count, scores = Counter(plain_terms(text)), []
        for i, bag in bags:
            n = sum(bag.values())
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in count.items() if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item is None, item or 0, rank, null, i, -s))
    return sorted(out)


def rows(df):
    return sorted((r.item_id is None, r.item_id or 0, r.rank, r.doc_id is None, r.doc_id or 0, r.score)
                  for r in df.collect())


def frames(spark, items, docs, parts=3):
    return (spark.createDataFrame(items, "item_id long, text string"),
            spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))


def random_text(rnd, words, most):
    # squares: some words are common, most rare
    return " ".join(words[int(len(words) * rnd.random() ** 2)] for _ in range(rnd.randint(0, most)))


@pytest.mark.parametrize("seed, k", [(1, 10), (2, 1), (3, 3)])
def test_all_pairs(spark, seed, k):
    rnd = random.Random(seed)
    words = [f"{c}{i}" for i in range(60) for c in ("a", "É", "中")]
    docs = [(i // 2, random_text(rnd, words, 60)) for i in range(600)]
    items = [(i, random_text(rnd, words, 25)) for i in range(40)] + [(3, docs[5][1]), (3, docs[5][1]), (None, "a1 É2")]
    assert rows(ranked_search(*frames(spark, items, docs), k)) == plain_search(items, docs, k)


def test_ties_and_copies(spark):
    """A third of the rows are one text: the smallest ids win, null ids come last."""
    docs = [(i if i % 7 else None, "the same words here") for i in range(300)] + [(i, f"other text {i} same") for i in range(600)]
    items = [(1, "same words"), (2, "words words"), (3, "nothing")]
    assert rows(ranked_search(*frames(spark, items, docs))) == plain_search(items, docs, 10)


def test_blocks_of_items(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, random_text(rnd, words, 40)) for i in range(200)]
    items = [(i, random_text(rnd, words, 12)) for i in range(11)]
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 30)
    assert rows(ranked_search(*frames(spark, items, docs))) == plain_search(items, docs, 10)


def test_edges(spark, edges, empty):
    from tests.llm.conftest import EDGES
    items = [(1, "same WORDS text"), (2, None), (3, ""), (4, "x"), (None, "中文 ñandú"), (6, "endoftext " * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score long")
    assert rows(ranked_search(frame, edges)) == plain_search(items, EDGES, 10)
    out = ranked_search(frame, empty)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search(frame.limit(0), edges).count() == 0


def test_large_sums_stay_exact(spark):
    """An item whose score passes 2**53 is scored in whole numbers."""
    docs = [(i, "a b " * (i + 1) + f"r{i}") for i in range(30)]
    items = [(1, "a r3 " * 600000 + "r7 " * 600001)]
    assert max(r[-1] for r in plain_search(items, docs, 10)) > 1 << 50
    assert rows(ranked_search(*frames(spark, items, docs))) == plain_search(items, docs, 10)


def test_whole_batches_are_pruned():
    """Bounds keep most pairs of unlike items and documents from being scored."""
    rng = np.random.default_rng(4)
    values, weights = np.zeros((512, 400), np.float32), np.zeros((64, 400))
    for r in range(512):  # documents of 16 kinds with terms of their own
        values[r, r % 16 * 25 + rng.integers(0, 25, 20)] = rng.integers(1, 900_000, 20)
    for r in range(64):
        weights[r, r % 16 * 25 + rng.integers(0, 25, 12)] = rng.integers(1, 9000, 12)
    search = Search(weights, 10, np.ones(64))
    search.documents(list(range(512)), values, np.arange(400))
    scores = values.astype(float) @ weights.T
    for i in range(64):
        want = sorted((-s, d) for d, s in enumerate(scores[:, i].astype(int).tolist()) if s > 0)[:10]
        assert [(s, d) for s, _, d in search.best[i]] == want
    assert search.pairs < 512 * 64 / 4


def test_tree_holds_every_row_once():
    x = np.random.default_rng(1).random((77, 9)).astype(np.float32)
    tree = Tree(x, 8)
    tree.maxima(x)
    leaves = [n for n in tree.nodes() if not n.kids]
    assert sorted(np.concatenate([n.rows for n in leaves])) == list(range(77)) and max(len(n.rows) for n in leaves) <= 8
    for n in tree.nodes():
        assert (n.top == x[n.rows].max(axis=0)).all()
