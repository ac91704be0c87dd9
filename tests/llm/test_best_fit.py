"""op13: best-fit decreasing packing against a document-by-document version."""

import bisect
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fitlake.llm.best_fit import CapacityTree, best_fit_documents, best_fit_plan, placed
from fitlake.llm.packing import WordTokens, word_tokenizer


def plain_best_fit(lengths, cap):
    """What is left in each sequence, documents placed one by one."""
    room = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        left = room.pop(i) if i < len(room) else cap
        bisect.insort(room, left - n)
    return Counter(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_rule(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([5, 16, 31, 64, 2048])
    lengths = [min(cap, max(1, int(rnd.lognormvariate(np.log(cap / rnd.choice([2, 4, 10])), 1))))
               for _ in range(rnd.randint(1, 500))]
    counts = Counter(lengths)
    length = np.array(sorted(lengths), np.int64)
    rank = np.concatenate([np.arange(counts[x]) for x in sorted(counts)])
    sequence, offset = placed(best_fit_plan(counts, cap), length, rank)
    used = Counter()
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
        assert used[s] == o  # gapless from 0
        used[s] += n
    assert Counter(cap - n for n in used.values()) == plain_best_fit(lengths, cap)


def test_tree_finds_the_tightest():
    rnd, tree, open_ = random.Random(3), CapacityTree(50), Counter()
    for _ in range(2000):
        c = rnd.randint(0, 50)
        n = 1 if not open_[c] or rnd.random() < 0.5 else -1
        tree.add(c, n)
        open_[c] += n
        x = rnd.randint(0, 50)
        assert tree.tightest(x) == min((k for k, v in open_.items() if v and k >= x), default=None)


def plain_pieces(tokenizer, texts, end_id, tokens):
    out = []
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for k, lo in enumerate(range(0, len(ids), tokens)):
            x = ids[lo:lo + tokens]
            out.append((i, k, lo, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    return Counter(out)


def check(rows, tokenizer, texts, tokens):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == \
        plain_pieces(tokenizer, texts, 0, tokens)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= tokens
    assert Counter(tokens - sum(n for _, n in p) for p in sequences.values()) == \
        plain_best_fit([r.length for r in rows], tokens)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(word_tokenizer())


def test_documents(spark, documents, tokenizer):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    check(best_fit_documents(df, word_tokenizer()).collect(), tokenizer, documents, 2048)


def test_edges(edges, empty, tokenizer):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    check(best_fit_documents(edges, word_tokenizer(), tokens=64).collect(), tokenizer, rows, 64)
    out = best_fit_documents(empty, word_tokenizer())
    assert out.count() == 0
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_a_third_of_one_length(spark, tokenizer):
    rows = [(i, "same words " * 10 if i % 3 == 0 else "word " * (i % 200)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(best_fit_documents(df, word_tokenizer(), tokens=128).collect(), tokenizer, rows, 128)


def test_letters_before_stops(tokenizer):
    """Every letter of Unicode, at the end of a word before a comma or full
    stop: words encoded apart give the tokenizer's own ids (op3 and op13)."""
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo")]
    common = ("CJK UNIFIED", "CJK COMPAT", "HANGUL SYLLABLE", "TANGUT", "CUNEIFORM", "EGYPTIAN", "ANATOLIAN", "BAMUM")
    letters = [c for i, c in enumerate(letters) if i % 97 == 0 or not unicodedata.name(c, "").startswith(common)]
    texts = [f"ab{c}, x{c}. {c},{c}" for c in letters]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = WordTokens(word_tokenizer())(texts)
    assert [t for t, a, b in zip(texts, want, got) if a != b] == []
