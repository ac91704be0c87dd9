"""Quality rules: robust multivariate outliers by minimum covariance
determinant, in DataFrame operations only.

Each text becomes a vector of transformed statistics.  For every language and
source the location and scatter of the vectors are estimated on the closer half
of the rows, so that nearly half of a group may be junk: starting from medians
and absolute deviations, concentration steps take the `SUBSET` share of rows
with the smallest Mahalanobis distances and compute mean and covariance of those
anew, which lowers the covariance's determinant each time, until it stands
still.  A row is rejected when its squared distance under the last estimate
passes `CUTOFF`: a quantile of chi-square, times the factor by which the
distances under a half's covariance are too large.  Groups with fewer than `LEAST_ROWS` rows have
too few for a covariance and use their language's estimate, languages with
fewer the estimate of all rows.

Texts are read once for the vectors; those (a few numbers a row) are stored in
the shared folder, and every later step works on them with partial
aggregation, so that a source with a third of all rows is no burden.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import query, read, stored, unused, words

_LOG = logging.getLogger(__name__)

#: Transformed statistics.  Counts are shrunk towards a usual text by SHRINK
#: words, so that short texts do not scatter wildly: mean word length, then
#: marks, capitals, repeated words per word and repeated lines per line.
FEATURES = ("f_length", "f_marks", "f_capitals", "f_lines", "f_repeats")
SHRINK, USUAL_LENGTH = 50.0, 5.0
#: Least standard deviation of each: many groups have no marks at all.
FLOOR = (0.15, 0.02, 0.02, 0.05, 0.03)
SUBSET, STEPS, LEAST_ROWS = 0.5, 30, 50
#: Change of the determinant's logarithm at which a group's steps end (STEPS at most).
STILL = 1e-4
#: Parts of a group that are joined and pre-aggregated apart.
SALTS = 64
#: Consistency factor of the half, SUBSET / P(chi2_7 <= median of chi2_5), and the 0.9999 quantile of chi2_5.
CONSISTENCY, QUANTILE = 1.912208, 25.7448
#: Squared Mahalanobis distance, as measured under the half's covariance, beyond which a row is an outlier.
CUTOFF = CONSISTENCY * QUANTILE
_N = len(FEATURES)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines and n_capitals of the whole texts (longs, 0 for a
    null or empty text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast("array<long>")
    d = docs.withColumn("_w", words(F.col(text))).withColumn(
        "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_w").cast("long"))
    # hashes of all 5-word windows, and whether any comes twice
    h = F.col("_h")
    d = d.withColumn("_g", F.when(F.col("n_words") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("_h") - 5),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))).otherwise(nothing))
    d = d.withColumn("_twice", F.size(F.array_distinct("_g")) < F.size("_g"))
    g = F.col("_g")
    d = d.withColumn("_s", F.when(F.col("_twice"), F.array_sort(F.transform(
        "_g", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))))
    s = F.col("_s")
    same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]  # noqa: E731  null beyond the ends
    d = d.withColumn("_at", F.when(F.col("_twice"), F.sort_array(F.filter(F.transform(
        F.sequence(F.lit(0), F.size("_s") - 1),
        lambda k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
                         F.get(s, k)["i"])), lambda x: x.isNotNull()))))
    at = F.col("_at")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_at") - 1), F.lit(0).cast("long"),
        lambda acc, k: acc + F.coalesce(F.least(F.lit(5).cast("long"), F.get(at, k + 1) - F.get(at, k)),
                                        F.lit(5).cast("long")))
    d = d.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.when(F.col("_twice"), covered).otherwise(F.lit(0).cast("long")),
    })
    return d.drop("_w", "_l", "_h", "_g", "_s", "_at", "_twice")


def base_rule() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _features() -> dict[str, Column]:
    n = F.col("n_words") + SHRINK
    return dict(zip(FEATURES, (
        (F.col("word_chars") + SHRINK * USUAL_LENGTH) / n,
        F.log1p(F.col("n_symbols") / n),
        F.log1p(F.col("n_capitals") / n),
        F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
        F.col("n_repeat_words") / n)))


def _distance(m: list[Column], root: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky
    factor of the covariance (columns of the group's estimate)."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        z.append((F.col(f) - m[i] - reduce(lambda a, b: a + b, [root[i][j] * z[j] for j in range(i)], F.lit(0.0)))
                 / root[i][i])
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _m(i: int) -> Column:
    return F.col(f"m{i}")


def _l(i: int, j: int) -> Column:
    return F.col(f"l{i}{j}")


def _d2() -> Column:
    return _distance([_m(i) for i in range(_N)], [[_l(i, j) for j in range(i + 1)] for i in range(_N)])


def _cholesky(est: DataFrame) -> DataFrame:
    """c{i}{j} (covariance) to l{i}{j}, one column after another."""
    for i in range(_N):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - reduce(lambda a, b: a + b, [_l(i, k) * _l(j, k) for k in range(j)], F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j
                                 else rest / _l(j, j))
    return est.select("grp", *[f"m{i}" for i in range(_N)], *[f"l{i}{j}" for i in range(_N) for j in range(i + 1)])


def _beside(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """Rows with the columns of their group, one row a group, which goes to
    SALTS parts of each: a group with a third of all rows is spread out, and
    what is summed after it is summed in parts first."""
    spread = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["grp", "salt"])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and absolute deviations of each group."""
    med = rows.groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 10000).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    mad = _beside(rows, med).groupBy("grp").agg(
        *[F.percentile_approx(F.abs(F.col(f) - _m(i)), 0.5, 10000).alias(f"a{i}") for i, f in enumerate(FEATURES)])
    est = med.join(mad, "grp")
    return est.select("grp", *[f"m{i}" for i in range(_N)], *[
        F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOOR[i])).alias(f"l{i}{j}") if i == j else F.lit(0.0).alias(f"l{i}{j}")
        for i in range(_N) for j in range(i + 1)])


def _step(rows: DataFrame, est: DataFrame) -> DataFrame:
    """A concentration step: mean and covariance of the closest rows."""
    near = _beside(rows, est).withColumn("d2", _d2())
    cut = near.groupBy("grp").agg(F.percentile_approx("d2", SUBSET, 10000).alias("cut"))
    kept = _beside(near, cut).filter("d2 <= cut")
    cov = [(i, j) for i in range(_N) for j in range(i + 1)]
    out = kept.groupBy("grp").agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v{i}{j}") for i, j in cov])
    return _cholesky(out.select("grp", *[f"m{i}" for i in range(_N)], *[
        (F.col(f"v{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in cov]))


def _log_det() -> Column:
    return reduce(lambda a, b: a + b, [F.log(_l(i, i)) for i in range(_N)])


def _settled(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Concentration steps until each group's determinant stands still; groups
    that do are left out of later steps.  Every step reads the stored rows and
    the stored estimates of the step before, so its plan is the same size; one
    that does not settle in STEPS steps keeps its last estimate and is logged."""
    done: list[DataFrame] = []
    for _ in range(STEPS):
        was = est.select("grp", _log_det().alias("was"))
        new = stored(_step(rows, est).join(was, "grp").withColumn("still", F.abs(_log_det() - F.col("was")) <= STILL)
                     .drop("was"), "mcd")
        done.append(new.filter("still").drop("still"))
        est = new.filter("NOT still").drop("still")
        if est.isEmpty():
            break
    else:
        _LOG.warning("%d groups have not settled in %d steps", est.count(), STEPS)
    return stored(reduce(DataFrame.unionByName, done, est), "mcd")


def _group_names(stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, grp, fits): the estimate that a language and source
    uses (its own, the language's or that of all), and those it helps to fit:
    of its own, its language's and that of all, the ones that somebody uses.
    One row for each language and source."""
    some = stats.groupBy("g_lang", "g_source").agg(F.count(F.when(F.col("fit"), 1)).alias("n"))
    some = stored(some, "quality-groups")
    langs = some.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    own, lang, every = F.to_json(F.array("g_lang", "g_source")), F.to_json(F.array("g_lang")), F.lit("[]")
    names = stored(some.join(langs, "g_lang").select(
        "g_lang", "g_source", F.when(F.col("n") >= LEAST_ROWS, own).when(F.col("n_lang") >= LEAST_ROWS, lang)
        .otherwise(every).alias("grp")), "quality-groups")
    used = names.select("grp").distinct()
    levels = names.select("g_lang", "g_source", F.explode(F.array(own, lang, every)).alias("level"))
    fits = (levels.join(used, F.col("level") == F.col("grp"), "left_semi").groupBy("g_lang", "g_source")
            .agg(F.collect_set("level").alias("fits")))  # three names at most
    return names.join(fits, ["g_lang", "g_source"])


def _with_group(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    """Rows with what their language and source has, joined in SALTS parts."""
    spread = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["g_lang", "g_source", "salt"], "left")


def _estimates(stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, and the estimate to use), one row a group.

    A pooled estimate is fitted on all rows of its language (or all rows), not
    only on those of its small groups."""
    names = stored(_group_names(stats), "quality-groups")
    fit = _with_group(stats.filter("fit"), names.select("g_lang", "g_source", "fits"))
    fit = stored(fit.select(F.explode("fits").alias("grp"), "salt", *FEATURES), "quality-fit")
    est = _settled(fit, stored(_start(fit), "mcd"))
    return names.join(est, "grp", "left").drop("grp", "fits")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept), one row for each row of
    `docs` (doc_id, text, lang, source).

    A null or empty text has no words and fails the base rule.  Null languages
    and sources are groups of their own.  Repeated rows are judged alike.  An
    empty table gives no rows.  A row that passes the base rule in a table
    without any estimate cannot be (it would itself be the estimate).
    """
    src = docs.select("doc_id", F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "text")
    # a null becomes [null] in the key, never equal to a string
    stats = text_statistics(src).withColumns({
        "text_hash": F.xxhash64("text"), "base_failed": base_rule(),
        "g_lang": F.to_json(F.array("g_lang")), "g_source": F.to_json(F.array("g_source"))})
    # a part for each row by its place in its file, so that copies are spread too
    salt = (F.monotonically_increasing_id() % SALTS).cast("int")
    stats = stored(stats.withColumns(_features()).withColumns({"fit": ~F.col("base_failed"), "salt": salt})
                   .drop("text"), "quality")
    est = stored(_estimates(stats), "quality-estimates")
    return (_with_group(stats, est).withColumn("distance", _d2())
            .select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "distance",
                    (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept")))


def filtered(docs: DataFrame) -> DataFrame:
    """`docs`, whole rows and all columns, without those that are rejected."""
    key, digest = unused(docs.columns, "_bad_id"), unused(docs.columns, "_bad_hash")
    bad = judged(docs).filter("NOT kept").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key))
                     & (F.xxhash64(docs["text"]) == F.col(digest)), "left_anti")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents")).drop("text_hash")
