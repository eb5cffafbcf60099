"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger holds
which (blob, rule version) pairs were scanned and what was found. A scan reads the text only of blobs
that the ledger lacks for this rule version, once per distinct text, appends them, and joins the
findings back to all paths and versions that hold the blob. Where few blobs are new (up to `few`, some 250 bytes each as a broadcast row), their keys are
broadcast and no other text moves; else texts are merged by blob on the way, copies before the shuffle.

A ledger is a folder of two Parquet tables, `scanned` and `findings`, partitioned by rule version, to
which runs append. Findings are written first: a run that dies between the two leaves findings without
their `scanned` rows, so the blob is scanned again, and readers take distinct findings.

Null texts count as empty. Repeated rows each get their own result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.shingles import one_by_one
from seamark.llm.store import new_path, written

#: The base kinds in order; further kinds follow them in the order of the same spot.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
RULES: dict[str, re.Pattern] = {
    "assign": ASSIGN,
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "forge": re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat": re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    "cloud": re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
}
#: Text without which a rule cannot match; a plain search for it is quicker than the pattern.
NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "chat": "xox", "cloud": "AIza"}
RULE_VERSION = hashlib.sha256("\n".join(f"{k}={p.pattern}/{p.flags}" for k, p in RULES.items()).encode()).hexdigest()[:12]
FEW = 20_000
FINDINGS = "blob string, kind string, start long, end long"


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each secret, by start, then by the kinds' order."""
    found = []
    for kind, pattern in RULES.items():
        if kind in NEEDS and NEEDS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "assign" and m.end(1) - m.start(1) < 6 or kind == "access" and m.end() - m.start() < 20:
                continue
            found.append((m.start(), kind, m.end()))
    rank = {k: i for i, k in enumerate(RULES)}
    return sorted(found, key=lambda x: (x[0], rank[x[1]], x[2]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("blob", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        rows = [(blob, kind, start, end) for blob, text in zip(batch.column(0).to_pylist(), one_by_one(batch.column(1)), strict=True) for start, kind, end in find(text)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """What was scanned, by blob and rule version, and what was found, under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def read(self, table: str, schema: str, version: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", rule_version string").parquet(f"{self.path}/{table}").filter(F.col("rule_version") == version).drop("rule_version")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self, version: str = RULE_VERSION) -> DataFrame:
        return self.read("scanned", "blob string", version)

    def findings(self, version: str = RULE_VERSION) -> DataFrame:
        return self.read("findings", FINDINGS, version).distinct()

    def update(self, docs: DataFrame, text_col: str = "text", version: str = RULE_VERSION, few: int = FEW) -> DataFrame:
        """Scans the blobs of docs that this rule version has not seen; returns them (blob)."""
        texts = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        new = written(texts.select("blob").distinct().join(self.scanned(version), "blob", "left_anti"), "secret-new")
        if new.count() <= few:
            texts = texts.join(F.broadcast(new), "blob", "left_semi")
            once = texts.groupBy("blob").agg(F.first("text").alias("text"))
        else:
            once = texts.groupBy("blob").agg(F.first("text").alias("text")).join(new, "blob", "left_semi")
        once.mapInArrow(scan_batches, FINDINGS).withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(f"{self.path}/findings")
        new.withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(f"{self.path}/scanned")
        return new


def joined(rows: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, rank, kind, end) in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def by_blob(ledger: Ledger, name: str, of) -> DataFrame:
    """blob, and `of` applied to the array of its findings (start, rank, kind, end)."""
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(RULES) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    return ledger.findings().groupBy("blob").agg(of(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias(name))


def scan(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_assign, n_access, n_hex, base_sha256, spans (all kinds), blob, and whether this call scanned the blob (else the ledger had it)."""
    ledger = ledger or Ledger(docs.sparkSession)
    new = ledger.update(docs, text_col).select("blob", F.lit(True).alias("scanned_now"))
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    base = F.filter(found, lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    paths = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
    blobs = new.join(by_blob(ledger, "found", lambda x: x), "blob", "full_outer")
    joined_rows = paths.join(blobs, "blob", "left")
    return joined_rows.select(F.col("id").alias(id_col), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"), "blob", F.coalesce("scanned_now", F.lit(False)).alias("scanned_now"))


def redact_batches(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose last column holds the spans; the text column is changed in its place, and the last one goes."""
        for batch in batches:
            out = []
            for text, found in zip(one_by_one(batch.column(text_at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if found:
                    parts, at = [], 0
                    for kind, start, end in ((k, int(a), int(b)) for k, a, b in (x.split(":") for x in found.split(","))):
                        if start >= at:
                            parts += [text[at:start], f"[{kind}]"]
                        at = max(at, end)
                    text = "".join(parts) + text[at:]
                out.append(text)
            columns = [*batch.columns[:text_at], pa.array(out, pa.string()), *batch.columns[text_at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def redact(docs: DataFrame, ledger: Ledger | None = None, text_col: str = "text") -> DataFrame:
    """docs with each secret replaced by its kind in brackets, overlapping ones once. n_chars, if there, follows the text. Any further columns, whatever their names, stay as they are."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, text_col)
    blob, spans = (next(f"{n}{i}" for i in range(len(docs.columns) + 1) if f"{n}{i}" not in docs.columns) for n in ("blob", "spans"))
    found = by_blob(ledger, spans, joined).withColumnRenamed("blob", blob)
    marked = docs.withColumn(blob, blob_of(F.col(f"`{text_col}`"))).join(found, blob, "left").drop(blob)
    plain = marked.filter(F.col(spans).isNull()).drop(spans)
    hit = marked.filter(F.col(spans).isNotNull())
    out = plain.unionByName(hit.mapInArrow(redact_batches(docs.columns.index(text_col)), docs.schema))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
