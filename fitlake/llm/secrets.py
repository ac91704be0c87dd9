"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content.  The
ledger (Parquet, appended to) has the findings of each pair of blob and rule
version that was ever scanned.  A scan takes the versions' distinct blobs,
leaves out those that the ledger has for the current rules, reads the text of
one version of each of the others, appends their findings and joins the ledger
back to all paths.  Texts move once, to the blob's chosen version, without a
sort; the rest of the work is on addresses.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read, scratch

# Base rules (kind, pattern, group that is tested, least length), in their order.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Rules of the scanner's own, in the order of kinds after the base ones.
MORE = (
    ("key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S), 0, 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("github", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{40,}"), 0, 1),
    ("slack", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("google", re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0, 1),
    ("bearer", re.compile(r"\bBearer\x20+[A-Za-z0-9+/_.=-]{20,}"), 0, 1),
    ("url", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/@]{1,200}@"), 0, 1),
)
#: Literals of which each of these patterns needs one, to pass texts without them quickly.
_NEEDS = {"access": ("AKIA",), "key": ("PRIVATE KEY",), "jwt": ("eyJ",), "github": ("gh", "github_pat_"), "slack": ("xox",),
          "google": ("AIza",), "bearer": ("Bearer",), "url": ("://",)}
KINDS = tuple(k for k, *_ in BASE + MORE)
#: Changes with any rule or its literals; part of the ledger's key.
RULES = hashlib.sha256("\n".join(f"{k}\t{p.pattern}\t{p.flags}\t{g}\t{n}\t{_NEEDS.get(k)}"
                                 for k, p, g, n in BASE + MORE).encode()).hexdigest()[:16]


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the spans in a text, leftmost and
    non-overlapping for each kind, in order; code points, end exclusive."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE + MORE):
        if kind in _NEEDS and not any(x in text for x in _NEEDS[kind]):
            continue
        if kind == "hex":  # the same, without a match for each short run
            out += [(m.start(), k, m.end()) for m in _HEX.finditer(text)]
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


_HEX = re.compile(r"[0-9a-f]{24,}")


def _scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of (blob, text)."""
    def run(batches):
        for b in batches:
            found = [findings(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("blob"), pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in found], kind)],
                names=["blob", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    return for_python(blobs.select("blob", "text")).mapInArrow(
        run, "blob binary, spans array<struct<start:long,kind:int,end:long>>")


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_new(versions: DataFrame, ledger: str) -> DataFrame:
    """Scans the blobs of `versions` (doc_id, text) that the ledger folder
    lacks for these rules, appends them, and returns the ledger's rows
    (blob, rules, spans).

    A blob is taken from the version with the smallest (doc_id, hash of the
    text); versions that agree in both are copies of one row.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col("doc_id").alias("path"), address(F.col("text")).alias("blob"), "text")
    blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
    old = read_ledger(spark, ledger)
    if old is not None:
        blobs = blobs.join(old.filter(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    chosen = blobs.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"))
    # the addresses are the hashed side; texts stream through unsorted
    texts = rows.join(chosen.hint("shuffle_hash"),
                      (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")
    # a version may stand there in several rows of the same id and text
    out = _scan(texts).dropDuplicates(["blob"]).select("blob", F.lit(RULES).alias("rules"), "spans")
    out.write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("blob binary, rules string, spans array<struct<start:long,kind:int,end:long>>").parquet(ledger)


def secret_scan(versions: DataFrame, ledger: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans), one
    row for each row of `versions`.

    A null text is empty; texts without a finding have zeros, the SHA-256 of
    the empty string and empty spans.  Repeated rows, null ids and extra
    columns do no harm; an empty table gives no rows.
    """
    # a scan that was repeated or ran beside another may have written a blob twice
    known = (scan_new(versions, ledger).filter(F.col("rules") == RULES).dropDuplicates(["blob"])
             .select(F.col("blob").alias("_blob"), "spans"))
    paths = versions.select("doc_id", address(F.col("text")).alias("blob"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return paths.join(known, F.col("blob") == F.col("_blob")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"), scratch(spark, "ledger"))
