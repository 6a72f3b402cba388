"""Secret scans over a ledger of blobs.

Every version of every file is addressed by its content.  The ledger, a table on
shared storage, holds what was found in a blob by a rule at a version of that rule,
finds or none.  A scan looks only at blobs and rule versions that the ledger does
not have, adds them to it, and joins the findings to all rows with that content.
A scan that fails leaves the ledger as it was, since a parquet write commits whole;
two scans at once can add the same lines, so readers take one line for each.

Only DataFrame functions are used.  Offsets are code points, the end exclusive.

Rows: a null text counts as empty, an empty text has no findings; rows with null
or repeated keys each keep a line; an empty table gives an empty table.  Columns
named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from couponlab.llm.tables import bound, fresh_path, running_starts, set_aside, shuffles_dropped, text_or_empty, written

BLOB = "blob_id"
SPANS = "array<struct<start:bigint,`order`:int,kind:string,`end`:bigint>>"
OUTPUT = (BLOB, "spans")


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least``: characters that group ``part`` of a match must have, or the match is dropped."""

    kind: str
    pattern: str
    part: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the three kinds, in the order in which kinds at one start are listed.  A run of
# hex digits or of key characters matches whole or not at all, so its length can stand in the pattern; a failed
# assignment takes up its text, so its length is tested afterwards.
RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Where the rule matches: leftmost, not overlapping, failing matches dropped.

    A text split by the pattern gives the lengths between matches, from which starts follow.
    """
    pattern = F.lit(rule.pattern)

    def lengths(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)

    gaps = F.transform(F.split(text, rule.pattern), F.length)
    measured = F.struct(gaps.alias("gap"), lengths(0).alias("whole"), lengths(rule.part).alias("part"))

    def placed(m):
        steps = F.zip_with(F.slice(m["gap"], F.lit(1), F.size(m["whole"])), m["whole"], lambda a, b: a + b)
        zipped = F.arrays_zip(running_starts(steps).alias("at"), steps.alias("step"), m["whole"].alias("whole"), m["part"].alias("part"))
        spans = F.transform(
            F.filter(zipped, lambda z: z["part"] >= rule.least),
            lambda z: F.struct(
                (z["at"] + z["step"] - z["whole"]).alias("start"),
                F.lit(order).alias("order"),
                F.lit(rule.kind).alias("kind"),
                (z["at"] + z["step"]).alias("end"),
            ),
        )
        return spans.cast(SPANS)

    return F.when(F.rlike(text, pattern), bound(measured, placed)).otherwise(F.array().cast(SPANS))


class BlobLedger:
    """What has been found so far, in a parquet table at ``path`` on shared storage: a line for each blob and rule version."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self._spark, self._path, self._rules = spark, path, rules

    def lines(self) -> DataFrame:
        """``blob_id``, ``rule`` and ``spans`` for the rule versions in use; no lines if nothing was scanned yet."""
        schema = f"{BLOB} string, rule string, spans {SPANS}"
        try:
            rows = self._spark.read.schema(schema).parquet(self._path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self._spark.createDataFrame([], schema)
        return rows.where(F.col("rule").isin([r.name for r in self._rules]))

    def _unseen(self, addressed: DataFrame) -> DataFrame:
        """Blobs that lack a rule version, each once, with their text and the rules already applied."""
        # Copies meet map-side before anything is joined, so a blob of many copies sends one row from each task.
        texts = addressed.groupBy(BLOB).agg(F.first("text").alias("text"))
        none = F.array().cast("array<string>")
        if self.lines().isEmpty():
            return texts.withColumn("seen", none)
        seen = self.lines().groupBy(BLOB).agg(F.collect_set("rule").alias("seen"))
        joined = texts.join(seen, BLOB, "left").select(BLOB, "text", F.coalesce("seen", none).alias("seen"))
        return joined.where(F.size("seen") < len(self._rules))

    def add(self, addressed: DataFrame) -> None:
        """Scan what the ledger does not have of ``addressed`` (``blob_id``, ``text``) and append it."""
        unseen = self._unseen(addressed)
        found = [
            F.when(
                ~F.array_contains("seen", rule.name),
                F.struct(F.lit(rule.name).alias("rule"), spans_of(F.col("text"), rule, order).alias("spans")),
            )
            for order, rule in enumerate(self._rules)
        ]
        lines = unseen.select(BLOB, F.explode(F.array_compact(F.array(*found))).alias("line")).select(BLOB, "line.*")
        with shuffles_dropped(self._spark):
            lines.write.mode("append").parquet(self._path)

    def findings(self) -> DataFrame:
        """``blob_id`` and its spans of all rules, for blobs that have any, in order of start and rule."""
        lines = self.lines().where(F.size("spans") > 0).dropDuplicates([BLOB, "rule"])
        return lines.groupBy(BLOB).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def scan(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """The versions with ``blob_id`` and ``spans``: add what is unseen, then join findings to every row."""
        content = text_or_empty(text)
        self.add(versions.select(F.sha2(content, 256).alias(BLOB), content.alias("text")))
        found = written(self.findings(), "findings")
        # Both sides come straight from a table, so adaptive execution can split a blob with very many rows.
        kept = versions.drop(*OUTPUT).withColumn(BLOB, F.sha2(content, 256))
        return kept.join(found, BLOB, "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every found span replaced by its kind in angle brackets; overlapping spans are one gap.

    Spans come in order of start.  What is kept before each is the part behind all ends so far.
    """

    def pieces(s):
        def piece(span, i):
            reach = F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda e: e["end"])), F.lit(0).cast("bigint"))
            before = F.substring(text, (reach + 1).cast("int"), F.greatest(span["start"] - reach, F.lit(0)).cast("int"))
            mark = F.when(span["start"] >= reach, F.concat(F.lit("<"), span["kind"], F.lit(">"))).otherwise(F.lit(""))
            return F.concat(before, mark)

        last = F.coalesce(F.array_max(F.transform(s, lambda e: e["end"])), F.lit(0).cast("bigint"))
        return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, bound(spans, pieces)).otherwise(text)


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every found secret masked in the text."""
    own, back = set_aside(documents, *OUTPUT)
    scanned = BlobLedger(documents.sparkSession, fresh_path(documents.sparkSession, "ledger")).scan(own, text)
    return scanned.withColumn(text, masked(F.col(text), F.col("spans"))).select(*back)


def op1_secret_scan(spark, folder: str) -> DataFrame:
    """Secrets of every document, by way of a new ledger."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    scanned = BlobLedger(spark, fresh_path(spark, "ledger")).scan(documents).select("doc_id", "spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(r.kind) for r in RULES],
        F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
