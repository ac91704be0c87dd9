"""op11: spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from fitlake.llm import variants
from fitlake.llm.variants import near_words, variant_groups, word_counts


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts: dict[str, int], ratio: int = 5):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], form[w] and counts[form[w]], root))
    return out


def some_words(rnd, n, letters, lengths):
    words = {"".join(rnd.choices(letters, k=rnd.choice(lengths))) for _ in range(n)}
    for w in list(words):  # and edits of them, also at the ends and within runs of one letter
        i = rnd.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:]}
    return {w: rnd.choice([1, 2, 5, 9, 40, 41, 300, 2000]) for w in words if w}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("seed, letters, lengths", [
    (1, "ab", [1, 2, 3, 4, 5, 6, 7, 8]), (2, "abcdeé", [6, 7, 8]), (3, "aaaab", [6, 9, 12]), (4, "xyz中文😀", [2, 5, 6])])
def test_all_pairs(spark, seed, letters, lengths):
    counts = some_words(random.Random(seed), 60, letters, lengths)
    got = {tuple(r) for r in variant_groups(frame(spark, counts)).select(
        "word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == plain_groups(counts)


@pytest.mark.parametrize("rows, cells", [(3, 1 << 20), (1024, 40)])
def test_large_tiles_are_dealt_again(spark, monkeypatch, rows, cells):
    """Tiles of three rows: down to a single place, and no pair is lost."""
    monkeypatch.setattr(variants, "TILE_ROWS", rows)
    monkeypatch.setattr(variants, "TILE_CELLS", cells)
    counts = some_words(random.Random(5), 60, "abc", [5, 6, 7])
    got = {r.word: r.n_near for r in near_words(frame(spark, counts)).collect()}
    assert got == {w: k for w in counts if (k := sum(one_edit(w, v) for v in counts))}


def test_small_and_shared_tiles_agree(spark, monkeypatch):
    counts = some_words(random.Random(6), 80, "abcd", [6, 7])
    want = sorted(map(tuple, near_words(frame(spark, counts)).collect()))
    monkeypatch.setattr(variants, "SHARED_ROWS", 1)
    assert sorted(map(tuple, near_words(frame(spark, counts)).collect())) == want


def test_counts(spark, documents):
    rows = documents[:60] + [(None, "Überall überall ÜBERALL abcdefgh"), (7, None), (7, ""), (8, "x" * 70000)]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 7 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    got = {r.word: r.n for r in word_counts(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6}


def test_long_words(spark):
    long = "ab" * 40000
    counts = {long: 3, long[:50000] + "c" + long[50000:]: 40, long + "x": 2, "b" + long: 1, long[:-3]: 9}
    got = {r.word: (r.n_near, r.root) for r in variant_groups(frame(spark, counts)).collect()}
    more = long[:50000] + "c" + long[50000:]
    assert got == {long: (3, more), more: (1, more), long + "x": (1, long + "x"), "b" + long: (1, "b" + long),
                   long[:-3]: (0, long[:-3])}


def test_edges(spark, edges, empty):
    words = word_counts(edges)
    assert {r.word: r.n for r in words.collect()}["endoftext"] == 2
    assert variant_groups(word_counts(empty)).count() == 0
    odd = spark.createDataFrame([("word", 3, "x"), ("word", 4, "y"), (None, 9, "z"), ("", 1, None), ("ward", 40, None)],
                                "word string, n long, form string")
    assert sorted(map(tuple, variant_groups(odd).collect())) == [
        ("ward", 40, 1, None, None, "ward"), ("word", 7, 1, "ward", 40, "ward")]
    with pytest.raises(ValueError):
        variant_groups(odd, ratio=1)


def test_chains_are_followed_to_the_end(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbbc"]
    counts = {w: 6 ** k for k, w in enumerate(words)}
    assert {r.root for r in variant_groups(frame(spark, counts)).collect()} == {"bbbbbc"}
