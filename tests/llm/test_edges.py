"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns, for every operator and every stage; and the pipeline as a whole."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from fitlake.llm import (base, decontaminate, html_text, licenses, line_dedup, lm_scoring, ngram_join, packing, pii,
                         quality, secrets)
from fitlake.llm.base import scratch, stored
from tests.llm.conftest import EDGES, SF

N = len(EDGES)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_scan(edges, empty):
    rows = licenses.license_scan(edges).collect()
    assert len(rows) == N and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in rows)
    assert {r.doc_id: r.n_words for r in rows}[1] == 0 and licenses.license_scan(empty).count() == 0


def test_license_places(spark):
    df = spark.createDataFrame([(1, "MIT-License mit license; Licensed under the Apache License, Version 2.0"),
                                (2, "GNU Lesser General Public License. all rights reserved"), (3, "license mit")],
                               "doc_id long, text string")
    r = by_id(licenses.license_scan(df))
    assert (r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (3, 0, 7, "apache,mit") and r[1].score == 1
    assert (r[2].base_labels, r[2].labels) == ("gpl", "gpl,lgpl,proprietary") and r[3].n_base == 0


def test_scores(edges, empty):
    rows = lm_scoring.scores(edges, lm_scoring.piece_vocabulary()).collect()
    assert len(rows) == N and {r.doc_id: r.n_tokens for r in rows}[7] == 40001
    assert {(r.n_tokens, r.score) for r in rows if r.doc_id == 1} == {(r.n_tokens, r.score) for r in rows if r.doc_id == 2}
    assert lm_scoring.scores(empty, lm_scoring.piece_vocabulary()).count() == 0


def test_packing(edges, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.word_tokenizer())
    rows = packing.pack_documents(edges, packing.word_tokenizer()).collect()
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in EDGES)
    assert sum(r.length for r in rows) == want and packing.pack_documents(empty, packing.word_tokenizer()).count() == 0


def test_ngram_components(edges, empty):
    rows = ngram_join.ngram_components(edges).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 4, 5, 6, 7, 8, None))
    assert len(rows) == N
    assert [x for x in got if x[0]] == [(1, 0, 1), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 2, 8), (8, 2, 8)]
    assert {x[1:] for x in got if not x[0]} == {(2, 8), (0, None)}
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_components_of_many_near_copies(spark):
    """A chain and a cloud of near copies against all pairs in plain Python."""
    import random
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(80)]
    docs, t = [], list(base)
    for i in range(120):  # a cloud around one text, edits of 0 to 4 words
        x = list(base)
        for _ in range(rng.randrange(5)):
            x[rng.randrange(80)] = rng.choice(vocab)
        docs.append((1000 - i, " ".join(x)))
    for i in range(30):  # a chain: neighbours link, its ends do not
        t = t[:]
        t[(7 * i) % 80] = f"chain{i}"
        docs.append((i, " ".join(t)))
    docs += [(5000 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(40)]
    sets = {i: {tuple(x.split()[k:k + 5]) for k in range(len(x.split()) - 4)} for i, x in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in ids}


def test_lists_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 8)
    test_ngram_components_of_many_near_copies(spark)


def test_pairs_that_share_many_lists_come_once(spark):
    """Rows out of the last step are pairs, not pairs times n-grams."""
    prof = bytes([2]) * ngram_join.CLASSES  # 256 n-grams
    nodes = [(i, i, 256, prof) for i in range(1, 13)]
    rows = [(t, i, 256 << 32 | t) for t in range(40) for i in range(1, 13 if t % 2 else 12)]  # equal lists, and shorter ones
    lists = spark.createDataFrame(rows, "token long, node long, size_at long").repartition(5)
    classes = spark.createDataFrame(nodes, "node long, least long, n long, profile binary")
    roots = spark.createDataFrame([(2, 1)], "node long, root long")
    one = ngram_join._distinct(lists)
    assert sorted({r.token for r in one.collect()}) == [0, 1]
    want = sorted((a, b) for a in range(1, 13) for b in range(a + 1, 13) if (a, b) != (1, 2))
    for x in (lists, one):
        assert sorted((r.a, r.b) for r in ngram_join._rest(x, roots, classes, 80, False).collect()) == want


def test_finer_counts_lose_no_link():
    """What the finer counts reject is below the threshold, and of long sets they reject nearly all that is far below."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 128, 1000, 6000):
        pool = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
        for pct in (30, 80, 100):
            for m in range(0, n + 1, max(1, n // 40)):
                for q in {n, max(m, 1), n + n // 5}:
                    x, y = np.sort(pool[:n]), np.sort(pool[n - m:n - m + q])
                    fx, fy = ngram_join._fine(x), ngram_join._fine(y)
                    link = ngram_join._linked(x.tobytes(), y.tobytes(), pct)
                    shared = len(np.intersect1d(x, y))
                    assert link == (100 * shared >= pct * (len(x) + len(y) - shared))
                    assert ngram_join._may_link(fx, fy, pct) or not link
                    if n >= 1000 and pct == 80 and shared < 0.6 * n:
                        assert not ngram_join._may_link(fx, fy, pct)
        assert len(ngram_join._fine(pool[:n])) <= 8 + n + 1


def test_only_sets_of_likely_pairs_are_sent_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000)) for _ in range(12)]
    texts += [texts[0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = ngram_join.stored
    sizes = []

    def stored(df, name):
        out = kept(df, name)
        if name == "sets":
            sizes.append(sum(len(r.grams) for r in out.dropDuplicates(["node"]).collect()))
        return out

    both = ngram_join._nodes(docs, 5).filter("node IS NOT NULL")
    classes = kept(both.selectExpr("node", "doc_id AS least", "n", "profile"), "classes")
    of = {r.least: r.node for r in classes.collect()}
    ids = sorted(of.values())
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]], "a long, b long")
    monkeypatch.setattr(ngram_join, "stored", stored)
    got = [(r.a, r.b) for r in ngram_join._verified(docs, pairs, classes, 5, 80).collect()]
    assert got == [(max(of[0], of[12]), min(of[0], of[12]))]
    assert sum(sizes) < 13 * 2996 * 8 / 2  # of 13 whole sets


def test_stored_leaves_no_shuffle_files(spark):
    def files():
        disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
        all_, out = disk.getAllFiles(), set()
        for i in range(all_.size()):
            out.add(all_.apply(i).getName())
        return {x for x in out if x.startswith("shuffle_")}

    was, before = spark.conf.get(base.CLEANUP, None), files()
    kept = ngram_join.stored(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "rows")
    left = time.time() + 20
    while (new := files() - before) and time.time() < left:
        time.sleep(0.2)
    assert not new and kept.count() == 10 and spark.conf.get(base.CLEANUP, None) in (was, "false")


def test_pages(spark):
    rows = [(1, None, None, "k"), (2, "u", "", "k"), (3, "u", "plain text only", "k"), (None, "u", "<p", "k"),
            (4, "u", "<article>" + "<p>Some words stand here, as they do.</p>" * 5000 + "</article>", "k"),
            (4, "u", "<article><p>a</article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extracted(df).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert max(r.n_chars for r in got) > 100_000 and html_text.extracted(df.limit(0)).count() == 0


def test_line_dedup(edges, empty):
    rows = line_dedup.deduplicated(edges).collect()
    assert len(rows) == N and rows[0].__fields__ == edges.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in EDGES)
    assert line_dedup.deduplicated(empty).count() == 0


def test_quality(edges, empty):
    rows = quality.judged(edges).collect()
    assert len(rows) == N and {r.doc_id: (r.n_words, r.n_repeat_words) for r in rows}[7] == (40000, 40000)
    assert not any(r.kept for r in rows) and quality.judged(empty).count() == 0
    assert quality.filtered(edges).count() == 0


def test_decontamination(spark, edges, empty):
    bench = spark.createDataFrame([(1, "same words in this text here", "z"), (1, "same words in this text here", "z"),
                                   (None, None, "z")], "item_id long, text string, doc_id string")
    rows = decontaminate.contamination(edges, bench).collect()
    assert [r.doc_id for r in sorted(rows, key=str)].count(8) == 2 and len(rows) == 3
    left = decontaminate.decontaminated(edges, bench)
    assert left.columns == edges.columns and left.count() == N - 3
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edges, bench.limit(0)).count() == 0


def test_secrets(spark, edges, empty):
    rows = secrets.secret_scan(edges, scratch(spark, "t")).collect()
    assert len(rows) == N and all(r.spans == "" for r in rows)
    assert secrets.secret_scan(empty, scratch(spark, "t")).count() == 0


def test_pseudonyms(edges, empty):
    out = pii.pseudonymised(edges, "k")
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in EDGES)
    assert set(edges.columns) <= set(out.columns) and pii.pseudonymised(empty, "k").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, edges, empty, k):
    name, stage = CP.STAGES[k]
    out = stored(stage(spark, edges, SF), "t")
    if k < 4:
        assert out.columns == edges.columns
        assert out.count() == {0: 0, 1: N, 2: 10, 3: N}[k]
        if k == 2:  # one of each group; empty texts are alone; rows of one id (null too) are one
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    else:
        assert {r.doc_id for r in out.collect()} == {i for i, _ in EDGES}
    assert stage(spark, empty, SF).count() == 0


def test_unlinked_rows_stay_whatever_their_id(spark):
    """Different texts with null and equal ids; one of each group of links."""
    text = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    near = text("c", 39) + " end"
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, ""), (None, None), (None, text("z")),
            (None, text("z")), (None, text("z").upper()), (5, text("d")), (5, text("e")), (5, ""), (7, near), (8, text("c")),
            (9, text("f")), (5, text("f")), (5, text("f")), (5, text("f").upper())]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, node int").repartition(4)
    out = CP.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    # of rows 6 and 7 / 15 to 16 the smallest by text goes on, capitals first
    assert sorted(r.node for r in out.collect()) == [0, 1, 3, 4, 7, 8, 9, 10, 11, 16]


def test_pipeline(spark):
    """Stage by stage, each against what its operator says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.judged(docs).collect() if r.kept}
    one = stored(CP.quality_rules(spark, docs, SF), "t")
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = stored(CP.line_deduplication(spark, one, SF), "t")
    cut = {r.doc_id: (r.text, r.gone) for r in line_dedup.deduplicated(one, "gone").collect()}
    assert {r.doc_id: r.text for r in two.collect()} == {i: t for i, (t, n) in cut.items() if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = stored(CP.near_duplicates(spark, two, SF), "t")
    comp = {r.doc_id: r.component_id for r in ngram_join.ngram_components(two).collect()}
    assert {r.doc_id for r in three.collect()} == set(comp.values())
    four = stored(CP.benchmark_decontamination(spark, three, SF), "t")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(three, bench).collect()}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - bad
    last = CP.run(spark, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in four.collect()}
