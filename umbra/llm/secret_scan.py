"""Secret scans over an incremental blob ledger, with Spark expressions only.

Every version of a file is addressed by the SHA-256 of its content. Only pairs of
blob and rule version that the ledger does not hold are scanned; findings are kept
by blob and joined back to all paths and versions with that content.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import match_spans, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` characters are asked of ``group`` of each leftmost match."""

    kind: str
    pattern: str
    group: int
    least: int
    gate: str


#: Base kinds and common token formats, in order; fixed values.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i:passw(?:or)?d|secret|token|api_?key)"),
    # runs of one class that start at the same places: asking for the length in the pattern leaves the same spans
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abprs]-"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", 0, 1, r"AIza"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 1, r"k_(?:live|test)_"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,128}:[^\s:/@]{1,128}@", 0, 1, r"://"),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "2"
_SPANS = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules as a sorted array<struct<start, ord, stop, kind>>."""

    def of(n: int, r: Rule) -> Column:
        spans = match_spans(text, r.pattern)
        if r.group:
            inner = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
            spans = F.zip_with(spans, inner, lambda s, h: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), h.alias("hit")))
        kept = F.filter(spans, lambda s: F.length(s["hit"]) >= r.least)
        plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("ord"), s["stop"].alias("stop"), F.lit(r.kind).alias("kind")))
        return F.when(F.rlike(text, F.lit(r.gate)), plain).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*(of(n, r) for n, r in enumerate(rules))))


def gate(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule can match at all."""
    return F.rlike(text, F.lit("|".join(r.gate for r in rules)))


def addressed(versions: DataFrame, column: str = "text") -> DataFrame:
    """Add the content address ``blob`` of each row; a null text counts as empty."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, rule_version, spans) of blobs that ``ledger`` (blob, rule_version) lacks.

    Each blob is scanned once, however many paths hold it; a blob that no gate lets
    through has no row and is not moved at all.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    found = addressed(versions.select(text.alias("text")).where(gate(F.col("text"), rules)))
    if ledger is not None:
        found = found.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    blobs = found.groupBy("blob").agg(F.first("text").alias("text"))
    # no filter on the spans: it would be pushed below and find them twice
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), find_secrets(F.col("text"), rules).alias("spans"))


def join_back(versions: DataFrame, findings: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` without its text, with blob and spans (empty where there are none).

    Rows that no gate lets through have no findings and are not moved.
    """
    rows = addressed(versions.drop("blob", "spans"), column).withColumn("__may", gate(F.coalesce(F.col(column), F.lit("")), rules)).drop(column)
    none = F.array().cast(_SPANS)
    clear = rows.where("NOT __may").withColumn("spans", none)
    found = rows.where("__may").join(findings.select("blob", "spans"), "blob", "left").select(*clear.columns[:-1], F.coalesce("spans", none).alias("spans"))
    return clear.unionByName(found).drop("__may")


class BlobLedger:
    """Ledger and findings as Parquet tables under ``root``.

    A batch of versions is scanned, its findings are written, and only then are its
    blobs entered in the ledger; a run that dies between the two scans them again and
    writes equal findings, which readers take once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """(blob, rule_version) of all that was scanned."""
        return self._read("ledger", "blob string, rule_version string").distinct()

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """blob, rule_version, spans of the blobs that a gate let through."""
        rows = self._read("findings", f"blob string, rule_version string, spans {_SPANS}")
        return rows.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])

    def advance(self, versions: DataFrame, rule_version: str = RULE_VERSION, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen in ``versions`` and give all its rows, without their texts, with blob and spans.

        A null text counts as empty; repeated rows stay; a text of any length is scanned
        whole, in time in proportion to its length and matches; no rows give none.
        """
        seen = self.entries().where(F.col("rule_version") == rule_version)
        scan_unseen(versions, seen, rule_version, column, rules).write.mode("append").parquet(f"{self.root}/findings")
        fresh = addressed(versions.select(column), column).select("blob").distinct().join(seen.select("blob"), "blob", "left_anti")
        fresh.select("blob", F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{self.root}/ledger")
        return join_back(versions, self.findings(rule_version), column, rules)


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(joined: DataFrame) -> DataFrame:
    """doc_id with counts and digests of the spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return joined.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def scan_documents(documents: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text; others ignored) with blob and spans, through a ledger.

    Without ``ledger`` a fresh one in the shared folder is advanced, so all is unseen. A
    null text counts as empty and has no spans; a null doc_id keeps its row; repeated
    rows stay; an empty table gives no rows.
    """
    if ledger is None:
        ledger = BlobLedger(documents.sparkSession, f"{shared_dir(documents.sparkSession)}/umbra-ledger-{uuid.uuid4().hex}")
    return ledger.advance(documents.select("doc_id", "text"))
