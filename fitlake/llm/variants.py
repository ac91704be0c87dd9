"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

Two words differ by exactly one inserted, deleted or replaced code point when
their common prefix and common suffix together reach the longer one's length
less one.  Words lie in tiles as padded code-point matrices, and a tile
compares all pairs of its rows column by column.  The place of the edit (the
length m of the longer word, and the end of the common prefix) lies in one of
two halves of the word, and what is outside that half is equal: so words are
dealt to tiles by m, the half, and what is outside it.  Tiles with too many
words are dealt again by halves of the half, down to a single place, where a
tile holds no more words than the alphabet has letters.  No pair is lost, each
is found in exactly one tile, no tile grows with the data, and a tile gives one
row for each of its words, not one for each pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, stored

#: Rows and cells (rows times code points that may differ) of a tile.
TILE_ROWS, TILE_CELLS = 1024, 1 << 20
#: Small groups are compared together, up to so many rows.
SHARED_ROWS = 192
#: Words that a task counts before it passes its counts on.
COUNTED = 400_000

#: One byte for each code point up to U+00FF: the letters A-Z (folded), a-z
#: and U+00C0 to U+00FF stay, all else separates.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def word_counts(docs: DataFrame, typo_every: int | None = None, shortest: int = 6) -> DataFrame:
    """(word, n): the runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z
    lower-cased, of `shortest` code points at least, and how often each occurs.

    With `typo_every`, a run whose crc32 of "<doc_id>:<run>" (null id: nothing
    before the colon) is divisible by it loses the code point at that crc
    modulo its length.  Null and empty texts have no words; repeated rows
    count again.
    """
    def run(batches):
        total: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in total]
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return got

        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                found = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                start = zlib.crc32(b":" if key is None else b"%d:" % key)
                for w, n in found.items():
                    if len(w) < shortest:
                        continue
                    if typo_every:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % typo_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < shortest:
                                continue
                    total[w] += n
                if len(total) >= COUNTED:
                    yield out()
        if total:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part = for_python(rows).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


#: Where an edit may lie: the place [s, e) of the longer word, of length m.
_PLACE = ["m", "s", "e"]


def _dealt(words: DataFrame) -> DataFrame:
    """(m, s, e, key, word, n): `key` is what is outside [s, e) in a word of m
    code points, or of m - 1, which has one place less there."""
    return words.select(*_PLACE, F.expr("concat(substring(word, 1, s), right(word, m - e))").alias("key"), "word", "n")


def _halves(words: DataFrame) -> DataFrame:
    """Each row for either half of its [s, e)."""
    mid = F.expr("s + (e - s) div 2").cast("int")
    parts = F.array(F.struct(F.col("s"), mid.alias("e")), F.struct(mid.alias("s"), F.col("e")))
    return (words.withColumn("p", F.explode(parts))
            .select("word", "n", "m", F.col("p.s").alias("s"), F.col("p.e").alias("e")).filter("s < e"))


def near_matrix(words: list[str], m: int, s: int, e: int, group: np.ndarray) -> np.ndarray:
    """Which words of a tile are one edit apart, that edit in [s, e) of the
    longer word; words of m or m - 1 code points, equal outside within a
    group.  The matrices hold [s, e) alone, padded to the right."""
    k, w = len(words), e - s
    codes = np.array([x[s:e] for x in words], f"<U{w}").view(np.uint32).reshape(k, w)
    if codes.max(initial=0) < 256:
        codes = codes.astype(np.uint8)
    longer = np.fromiter((len(x) == m for x in words), bool, k)
    near = np.zeros((k, k), bool)
    ix = np.flatnonzero(longer)
    if not len(ix):
        return near
    kind = np.uint8 if w < 250 else np.int32
    x = np.ascontiguousarray(codes[ix].T)
    for shift, iy in ((0, ix), (1, np.flatnonzero(~longer))):
        if not len(iy):
            continue
        y = np.ascontiguousarray(codes[iy].T)
        same = group[ix][:, None] == group[iy][None, :]
        run, reach = same.copy(), np.zeros(same.shape, kind)
        for c in range(w):
            run &= x[c][:, None] == y[c][None, :]
            reach += run
        ok = same & (reach < w)  # else the prefix goes on past this place
        run = same
        for c in range(w - 1, shift - 1, -1):
            run &= x[c][:, None] == y[c - shift][None, :]
            reach += run
        ok &= reach >= w - 1
        near[np.ix_(ix, iy)] = ok
        if shift:
            near[np.ix_(iy, ix)] = ok.T
    return near


_NEAR_DDL = "word string, n_near long, near_n long, near string"


def _tiles(batches):
    """Sorted by place, key, n (falling) and word: (word, number of near words
    in its tile, n of the most frequent, that word), of words that have one."""
    place, group, groups = None, ([], [], []), []  # rows of the last key, complete ones before it

    def compare():
        if not groups:
            return None
        keys, words, n = (sum((g[i] for g in groups), []) for i in range(3))
        groups.clear()
        ids = np.concatenate([[0], np.cumsum([a != b for a, b in zip(keys[1:], keys)])]).astype(np.int32)
        near = near_matrix(words, *place, ids)
        count = near.sum(axis=1)
        has = np.flatnonzero(count)
        if not len(has):
            return None
        best = near[has].argmax(axis=1)  # the first of a row: rows lie by n and word
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in has], pa.string()), pa.array(count[has].astype(np.int64)),
             pa.array([n[i] for i in best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
            names=["word", "n_near", "near_n", "near"])

    def close():
        """The last key's rows are all there; a word alone has no pair."""
        nonlocal group
        if len(group[1]) > 1:
            groups.append(group)
        group = ([], [], [])

    for b in batches:
        m, s, e, key, word, n = (b.column(c).to_pylist() for c in ("m", "s", "e", "key", "word", "n"))
        for p, k, w, x in zip(zip(m, s, e), key, word, n):
            if p != place or k != (group[0][0] if group[0] else None):
                close()
                if groups and (p != place or sum(len(g[1]) for g in groups) >= SHARED_ROWS):
                    if (got := compare()) is not None:
                        yield got
                place = p
            group[0].append(k), group[1].append(w), group[2].append(x)
    close()
    if (got := compare()) is not None:
        yield got


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): for each word of `counts` (word, n; words
    distinct, not empty) that has one, the number of words one edit away, and
    of those the one of largest n, the smallest in code-point order of ties."""
    first = counts.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"))
    rows = _halves(first.select("word", "n", "m", F.lit(0).alias("s"), F.col("m").alias("e")))
    found = []
    while True:
        dealt = stored(_dealt(rows), "variants-tiles")
        width = F.col("e") - F.col("s")
        large = (dealt.groupBy(*_PLACE, "key").agg(F.count(F.lit(1)).alias("k"))
                 .filter((width > 1) & ((F.col("k") > TILE_ROWS) | (F.col("k") * width > TILE_CELLS))))
        large = stored(large.select(*_PLACE, "key"), "variants-large")
        tiles = dealt.join(large, [*_PLACE, "key"], "left_anti")
        parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tiles = (tiles.repartition(parts, *_PLACE, "key")
                 .sortWithinPartitions(*_PLACE, "key", F.desc("n"), "word"))
        found.append(for_python(tiles).mapInArrow(_tiles, _NEAR_DDL))
        if large.isEmpty():
            break
        rows = _halves(dealt.join(large, [*_PLACE, "key"], "left_semi"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))
    return (reduce(DataFrame.unionByName, found).groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.k")).alias("near_n"), F.col("b.w").alias("near")))


def _last(links: DataFrame) -> DataFrame:
    """(word, root): `links` (word, form) followed to the end, by doubling:
    after k rounds a row stands 2**k steps on.  Forms are ever more frequent
    words, so that no chain is a ring, and few rounds are needed."""
    at = stored(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(at.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
            "variants-roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variant_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words with counts (word, n):
    `form` is the near word of largest n (ties: the smallest in code-point
    order) if that n is `ratio` times the word's at least, else null; `root`
    the last form on the way from form to form, the word itself without one.

    Null and empty words are left out, the counts of repeated ones added up;
    an empty table gives no rows; further columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    counts = stored(counts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "variants-words")
    near = near_words(counts)
    form = F.col("near_n") >= ratio * F.col("n")
    got = stored(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("near")).alias("form"),
        F.when(form, F.col("near_n")).alias("form_n")), "variants-forms")
    roots = _last(got.filter("form is not null"))
    return got.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_SQL = r"""
WITH RECURSIVE crc_step AS (
  SELECT i AS byte, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM crc_step WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (
  SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                   ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS b
  FROM runs),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, b),
    lambda h, c: xor(h >> 8, tab[(xor(h, c) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:]
              ELSE w END AS word, n
  FROM hashed),
counted AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM counted, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN counted w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN counted w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM pairs GROUP BY word),
forms AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * c.n THEN other END AS form,
         CASE WHEN top >= 5 * c.n THEN top END AS form_n
  FROM counted c LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL
  SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, (SELECT arg_max(here, step) FROM walk WHERE walk.word = forms.word) AS root
FROM forms
"""


@query("op11_spelling_variants", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(read(spark, sf_dir, "documents"), typo_every=199)
    return variant_groups(counts.filter("n >= 5"))
