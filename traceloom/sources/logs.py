"""JSON-lines scans: numbered lines, trace classification, ingest report, id checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import vocab
from traceloom.functions import jsonx as jx
from traceloom.functions import text as tx
from traceloom.operators import dedup
from traceloom.operators.normalize import normalize_traces, redact_traces, with_identity
from traceloom.session import durable, with_row_index


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and line number; a file larger than a split is still numbered right.

    Lines are ordered by file, split start and place in the split; numbers come from the
    distributed row index minus the file's first.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
    )
    numbered = with_row_index(raw, "file", "__start", "__at", name="ordinal")
    first = numbered.groupBy("file").agg(F.min("ordinal").alias("__first"))
    return numbered.join(first, "file").select(
        "file",
        (F.col("ordinal") - F.col("__first") + 1).alias("line_number"),
        "ordinal",
        "value",
    )


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(tx.trimmed_or_null("value").isNotNull())


def classify_lines(lines: DataFrame, privacy_mode: str = vocab.DEFAULT_PRIVACY_MODE) -> DataFrame:
    """Every non-blank line as malformed, rejected or valid; valid ones redacted, with identity."""
    parsed = normalize_traces(drop_blank(lines), privacy_mode)
    return with_identity(redact_traces(parsed))


def ingest(
    lines: DataFrame,
    stored: DataFrame | None = None,
    *,
    known: DataFrame | None = None,
    run_id: int = 1,
    privacy_mode: str = vocab.DEFAULT_PRIVACY_MODE,
    near_threshold: float | None = dedup.THRESHOLD,
    chunk_rows: int = 20_000,
) -> DataFrame:
    """Classified rows with their final status: accepted, duplicate, rejected or malformed.

    ``lines`` has ``value`` and a unique ``ordinal``; ``stored`` holds the traces accepted by
    earlier runs; with their (content_hash, trace_id) in ``known``, its newest rows are enough. Accepted
    rows get their ordinal as trace id within the run. ``decision`` and
    ``cluster_id`` of the valid rows feed ``dedup.decided_clusters`` and ``dedup.decided_events``.
    """
    classified = durable(
        classify_lines(lines, privacy_mode).withColumn("run_id", F.lit(run_id).cast("long"))
    )
    valid = classified.filter("status = 'valid'").withColumn("trace_id", F.col("ordinal"))
    if near_threshold is None:
        firsts = dedup.first_by_hash(valid)
        owners = firsts.select("content_hash", F.col("trace_id").alias("cluster_id"))
        if stored is not None:
            earlier = stored if known is None else known
            firsts = dedup.drop_known(firsts, earlier)
            kept = earlier.groupBy("content_hash").agg(F.min("trace_id").alias("cluster_id"))
            owners = kept.unionByName(owners.join(kept, "content_hash", "left_anti"))
        decided = (
            valid.select("ordinal", "content_hash")
            .join(firsts.select("ordinal", F.lit("accepted").alias("decision")), "ordinal", "left")
            .join(owners, "content_hash")
            .select(
                "ordinal",
                F.coalesce("decision", F.lit("exact_duplicate")).alias("decision"),
                F.lit(None).cast("long").alias("match_id"),
                F.lit(None).cast("double").alias("match_score"),
                "cluster_id",
            )
        )
    else:
        dense = with_row_index(valid.withColumn("__line", F.col("ordinal")).drop("ordinal"),
                               "__line", name="ordinal")
        decided = dedup.accept_in_order(
            dense, stored, known=known, threshold=near_threshold, chunk_rows=chunk_rows
        ).select(F.col("trace_id").alias("ordinal"), "decision", "match_id", "match_score", "cluster_id")
    status = F.when(F.col("decision") == "accepted", "accepted").when(
        F.col("decision").isNotNull(), "duplicate"
    ).otherwise(F.col("status"))
    mark = F.when(
        F.col("decision") == "near_duplicate",
        F.concat(F.lit("near:"), F.col("match_id").cast("string"), F.lit(":"),
                 F.format_string("%.4f", "match_score")),
    ).when(F.col("decision") == "exact_duplicate", F.col("content_hash"))
    return classified.join(decided, "ordinal", "left").withColumns(
        {"status": status, "duplicate_mark": mark}
    )


def ingest_report(rows: DataFrame) -> DataFrame:
    """Counts per run. Errors and duplicate marks stay rows of :func:`ingest_messages`."""
    def count(name):
        return F.count_if(F.col("status") == name)

    return rows.groupBy("run_id").agg(
        count("accepted").alias("accepted"),
        count("rejected").alias("rejected"),
        count("malformed").alias("malformed"),
        count("duplicate").alias("duplicates"),
    )


def ingest_messages(rows: DataFrame) -> DataFrame:
    """(run_id, ordinal, kind, text) of errors and duplicates, one row each."""
    at = F.col("line_number") if "line_number" in rows.columns else F.col("ordinal") + 1
    error = F.concat(F.lit("line "), at.cast("string"), F.lit(": "), "error")
    return rows.filter(F.col("status").isin("malformed", "rejected", "duplicate")).select(
        "run_id",
        "ordinal",
        F.when(F.col("status") == "duplicate", "duplicate").otherwise("error").alias("kind"),
        F.coalesce("duplicate_mark", error).alias("text"),
    )


class SourceError(ValueError):
    """An input file breaks its contract."""


def read_unique(spark: SparkSession, path: str, key: str) -> DataFrame:
    """JSON lines whose ids must be present and unique, as variants; fails on a bad file."""
    lines = drop_blank(read_lines(spark, path))
    rows = lines.withColumn("v", jx.parse("value")).withColumn("id", jx.get(F.col("v"), f"$.{key}"))
    rows = durable(rows.select("file", "line_number", "ordinal", "value", "id"))
    if rows.isEmpty():
        raise SourceError(f"required JSONL file is empty: {path}")
    bad = rows.filter(~F.coalesce(jx.is_object(jx.parse("value")), F.lit(False))).limit(5).collect()
    if bad:
        raise SourceError(f"lines must be objects: {[r['line_number'] for r in bad]}")
    wrong = dedup.unique_id_violations(rows, "id").limit(5).collect()
    if wrong:
        raise SourceError(f"missing or repeated {key}: {[(r['id'], r['rows']) for r in wrong]}")
    return rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path, hashed where the file is read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )


def verified_dataset(spark: SparkSession, path: str, expected_sha256: str) -> DataFrame:
    """Rows of a pinned dataset file; wrong hash, non-object lines and emptiness fail."""
    found = [row["sha256"] for row in file_digests(spark, path).limit(2).collect()]
    if found != [expected_sha256]:
        raise SourceError("dataset SHA-256 mismatch")
    lines = drop_blank(read_lines(spark, path)).withColumn("v", jx.parse("value"))
    facts = lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(jx.is_object(F.col("v")), F.lit(False))).alias("bad"),
    ).first()
    if facts["n"] == 0 or facts["bad"]:
        raise SourceError(f"dataset has {facts['n']} rows, {facts['bad']} of them not objects")
    return lines


def benchmark_case_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a benchmark: JSON lines, a JSON list, or a document with items or cases."""
    whole = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), jx.parse("value").alias("v")
    )
    listed = F.coalesce(
        jx.get(F.col("v"), "$", "array<variant>"),
        jx.items(F.col("v"), "$.items"),
        jx.items(F.col("v"), "$.cases"),
    )
    documents = whole.filter(listed.isNotNull())
    from_documents = documents.select("file", F.explode(listed).alias("case"))
    lines = drop_blank(
        spark.read.text(path).select("value", F.input_file_name().alias("file"))
    ).join(documents.select("file"), "file", "left_anti")
    from_lines = lines.select("file", jx.parse("value").alias("case"))
    return from_documents.unionByName(from_lines).filter(jx.is_object(F.col("case")))
