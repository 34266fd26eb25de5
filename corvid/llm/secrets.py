"""Secret scanning over an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. A rule has a version. The ledger is a table in
the shared folder with the rule versions that each blob has been scanned under and what they found. Only
pairs of blob and rule version that it hasn't seen are scanned, and appended to it; findings then go from
the ledger to every path that holds the blob. DataFrame functions only.

Each call appends what it has scanned as one folder, which Spark makes visible when it is whole. If two
calls scan the same pair at once, it is in the ledger twice, with equal findings, and counts once.

Edge cases: a null text counts as the empty blob; it has no findings. Rows stay rows, so a path
that occurs twice is returned twice. Columns of the input other than path and text aren't
touched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.skew import spread_join
from corvid.storage import fresh_path, shared_dir, stored

FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: ``rules`` are kind and version, like ``hex/1``; a blob without findings has none, and needn't be scanned again.
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java pattern; ``hint`` a cheaper one that matches wherever it does.

    ``counted`` is the group whose length has to be ``least`` or more; other matches are dropped
    after matching, so that what they cover isn't searched again.
    """

    kind: str
    version: int
    pattern: str
    counted: int
    least: int
    hint: str

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# The three base kinds, in the order of their listing.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:password|passwd|secret|token|api_?key)[\x20\"':=]"),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"([0-9a-f]+)", 1, 32, r"[0-9a-f]{32}"),
)
# Further public formats of credentials.
MORE = (
    Rule("pem", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 24, r"eyJ[A-Za-z0-9_-]+\."),
    Rule("forge", 1, r"(gh[pousr]_[A-Za-z0-9]+)", 1, 24, r"gh[pousr]_[A-Za-z0-9]"),
)
RULES = (*BASE, *MORE)


def _spans(text: Column, rule: Rule) -> Column:
    """Code-point spans of the matches that are long enough, leftmost and not overlapping.

    Splitting at the same pattern gives the pieces between matches, so a match starts after all
    pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.counted)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), counted.alias("counted"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["whole"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["counted"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = F.aggregate(steps, start, step, lambda state: state["found"])
    return F.when(text.rlike(rule.hint), found).otherwise(none)


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def blobs_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each distinct text. Copies merge before the shuffle, so none of them weighs."""
    return docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was appended at ``path`` so far; an empty table before the first time."""
    try:
        return spark.read.schema(LEDGER).parquet(path).select("blob", "rules", "found")
    except AnalysisException as none_yet:
        if none_yet.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split(" ", 1) for x in LEDGER.split(", "))])


def scan_blobs(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: what each blob gives under the rule versions that the ledger lacks for it.

    ``blobs`` has ``blob`` and ``text``, a row for each blob.
    """
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    every = F.array(*[F.lit(r.name) for r in rules])
    todo = blobs.join(seen, "blob", "left").select("blob", "text", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen")).alias("rules")).where(F.size("rules") > 0)
    one = lambda r: F.transform(_spans(F.col("text"), r), lambda s: F.struct(F.lit(r.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    found = F.concat(*[F.when(F.array_contains("rules", r.name), one(r)).otherwise(none) for r in rules])
    return todo.select("blob", "rules", found.alias("found"))


def extend_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks for ``docs``, and returns the rows appended to it."""
    spark = docs.sparkSession
    run = f"{path}/run={uuid.uuid4().hex}"
    scan_blobs(blobs_of(docs, text), read_ledger(spark, path), rules).write.parquet(run)
    return spark.read.schema(LEDGER).parquet(run)


def pairs_in(ledger: DataFrame) -> int:
    """How many pairs of blob and rule version those ledger rows stand for."""
    return ledger.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0)).cast("bigint")).first()[0]


def findings_of_blobs(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and ``findings`` (kind, start, end; by start, then kind as in ``rules``) of blobs with any under ``rules``."""
    current = ledger.where(F.size("found") > 0).select("blob", F.filter("found", lambda f: f["rule"].isin([r.name for r in rules])).alias("found"))
    whole = current.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found")).where(F.size("found") > 0)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    ranked = F.array_sort(F.transform("found", lambda f: F.struct(f["start"].alias("start"), rank[f["rule"]].alias("rank"), f["end"].alias("end"), f["rule"].alias("rule"))))
    return whole.select("blob", F.transform(ranked, lambda f: F.struct(kind[f["rule"]].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings"))


def shared_ledger(spark: SparkSession) -> str:
    """The ledger that all runs share which have the same shared folder."""
    return f"{shared_dir(spark)}/corvid/secrets-ledger"


def scan_secrets(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path``, ``blob`` and ``findings``, a row for each row of ``docs``.

    ``ledger`` is where the ledger is; without it a new one is begun.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    extend_ledger(docs, ledger, text, rules)
    paths = stored(docs.select(F.col(path), blob_of(text).alias("blob")), "paths")
    found = findings_of_blobs(read_ledger(spark, ledger), rules)
    return spread_join(paths, found, "blob", "left").select(path, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def mask_secrets(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret of the texts replaced; the ledger is extended first."""
    extend_ledger(docs, ledger, text, rules)
    found = findings_of_blobs(read_ledger(docs.sparkSession, ledger), rules)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), blob_of(text).alias("blob"))
    clean = redacted(F.col("doc").getField(text), F.coalesce("findings", F.array().cast(FINDINGS)))
    return spread_join(whole, found, "blob", "left").select(*[(clean if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def joined(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """``text`` with each finding replaced by ``mask``; of findings that overlap, the union."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        out = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, out).otherwise(state["out"]).alias("out"))

    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
