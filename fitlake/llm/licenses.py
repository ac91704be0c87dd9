"""License scans by a positional index of rare licence words, in DataFrame
operations only.

A template is a licence notice as words, with a mandatory key phrase inside.
The index has, for each template, the two words of its key phrase with the
highest inverse document frequency (counted over all texts) and their
positions.  A text's occurrences of such words are looked up; the starts that
the two words propose, each by its relative position, are intersected, and the
key phrase is verified word for word at what is left.  All of this happens
inside the text's row: nothing but the document frequencies is shuffled, one
row for each licence word and task.

The score is the largest share of a template's words that stand at their
positions around a verified key phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import ascii_lower, query, read, words

#: What separates words: all of ASCII but 0-9, A-Z, a-z (A-Z is folded first).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k)


#: Usual notices of public licences; the key phrase must stand.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license", True),
    Template("apache", "licensed under the apache license version 2 0", "apache license", True),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license", True),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "made available under the eclipse public license version 2 0", "eclipse public license"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons"),
    Template("cc-by", "licensed under cc by 4 0", "under cc by"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "released under the cc0 1 0 public domain dedication", "cc0 1 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("isc", "released under the isc license", "isc license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("proprietary", "copyright all rights reserved", "all rights reserved"),
)


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of a fixed vocabulary stands, and (as "")
    the number of texts; at most one row a word reaches the driver."""
    hit = F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary)))
    rows = (texts.select(F.explode(F.concat(F.array(F.lit("")), hit)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
    return {r["word"]: r["n"] for r in rows}


def _anchors(t: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """The (word, place in the key phrase) of the two highest IDF."""
    total = df.get("", 0)
    idf = lambda w: math.log((total + 1) / (df.get(w, 0) + 1))
    first: dict[str, int] = {}
    for i, w in enumerate(t.key_words):
        first.setdefault(w, i)
    return sorted(first.items(), key=lambda x: (-idf(x[0]), x[0]))[:2]


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, places), one row for each row of `docs` (doc_id, text and any other
    columns).

    places: (label, start, share) of every verified key phrase, by start and
    label.  base_labels, labels: distinct, sorted, joined by commas, empty if
    there are none; score 0 then.  A null or empty text has no words; repeated
    rows and null ids are scanned like others; an empty table gives no rows.
    """
    text = ascii_lower(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", words(text, BETWEEN).alias("w"))
    vocabulary = sorted({w for t in templates for w in t.key_words})
    df = document_frequencies(rows, vocabulary)
    anchors = {t: _anchors(t, df) for t in templates}
    looked_up = sorted({w for a in anchors.values() for w, _ in a})

    # occurrences of the index's words, in order of place
    d = rows.withColumn("hits", F.filter(F.transform(
        "w", lambda x, i: F.when(x.isin(looked_up), F.struct(x.alias("word"), i.alias("at")))),
        lambda h: h.isNotNull()))

    def starts(t: Template) -> Column:
        def shifted(word: str, p: int) -> Column:
            return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - p)

        lists = [shifted(word, p) for word, p in anchors[t]]
        both = reduce(F.array_intersect, lists[1:], F.array_distinct(lists[0]))
        key = t.key_words
        return F.filter(both, lambda s: reduce(
            lambda a, b: a & b, [F.get("w", s + j) == F.lit(k) for j, k in enumerate(key)],
            s >= 0) & F.get("w", s + len(key) - 1).isNotNull())

    def share(t: Template, s: Column) -> Column:
        same = [F.when((s + (j - t.key_at) >= 0) & (F.get("w", s + (j - t.key_at)) == F.lit(word)), 1).otherwise(0)
                for j, word in enumerate(t.words)]
        return reduce(lambda a, b: a + b, same) / float(len(t.words))

    none = F.array().cast("array<struct<label:string,start:long,share:double,base:boolean>>")

    def places(t: Template) -> Column:
        return F.transform(starts(t), lambda s: F.struct(
            F.lit(t.label).alias("label"), s.cast("long").alias("start"), share(t, s).cast("double").alias("share"),
            F.lit(t.base).alias("base")))

    found = F.flatten(F.array(*[places(t) for t in templates]))
    d = d.withColumn("found", F.when(F.size("hits") > 0, found).otherwise(none))
    base = F.filter("found", lambda p: p["base"])
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    at = F.transform(base, lambda p: p["start"])
    return d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform("found", lambda p: F.struct(p["start"].alias("start"), p["label"].alias("label"),
                                                             p["share"].alias("share")))).alias("places"))


def _oracle() -> str:
    """DuckDB: every key phrase tried at every word."""
    rows = ",\n".join(
        f"('{t.label}', {t.key_words!r}, {t.words!r}, {t.key_at}, {str(t.base).lower()})" for t in TEMPLATES)
    return rf"""
WITH t(label, key, notice, key_at, base) AS (VALUES {rows}),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') AS ws FROM documents),
p AS (SELECT r, label, notice, key_at, base, ws,
    unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1] = key[1] AND ws[i + 1:i + len(key)] = key)) AS s
  FROM w, t WHERE list_has_all(ws, key)),
f AS (SELECT r, label, base, s, list_sum(list_transform(range(0, len(notice)), lambda j:
    CASE WHEN s + j - key_at >= 0 AND ws[s + j - key_at + 1] = notice[j + 1] THEN 1 ELSE 0 END)) / CAST(len(notice) AS DOUBLE) AS share
  FROM p),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN g USING (r)
"""


@query("op1_license_scan", _oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("places")
