"""SHA-256 commitments over findings, evidence and submissions, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe import catalog, schemas
from vigilframe.functions.text import number_text

MESSAGES = {
    "VERIFIED": "Local SHA-256 matches the registered commitment",
    "MISMATCH": "Integrity mismatch: local record differs from the registered commitment",
    "UNAVAILABLE": "Commitment table is unavailable; cannot verify commitment",
}


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, 2, F.length(listed) - 2)


def canonical_json(fields: dict[str, Column], numeric: tuple[str, ...] = ()) -> Column:
    """Compact JSON object with sorted keys; numbers as Python prints them, nulls kept."""
    parts: list[Column] = []
    for place, name in enumerate(sorted(fields)):
        value = F.coalesce(number_text(fields[name]), F.lit("null")) if name in numeric else _quoted(fields[name])
        parts += [F.lit(("{" if place == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def text_digest(value: Column) -> Column:
    return F.sha2(value, 256)


def finding_digest() -> Column:
    """Digest over the eight identity fields of a finding."""
    numeric = ("expected_value", "observed_value")
    fields = {
        name: F.col(name) if name in numeric else _text("id" if name == "finding_id" else name)
        for name in catalog.FINDING_DIGEST_FIELDS
    }
    return F.sha2(canonical_json(fields, numeric), 256)


def evidence_digest() -> Column:
    """Digest over the seven identity fields of an evidence row, all as text."""
    return F.sha2(canonical_json({name: _text(name) for name in catalog.EVIDENCE_DIGEST_FIELDS}), 256)


def finding_records(findings: DataFrame) -> DataFrame:
    """Commitment candidates of findings."""
    return findings.select(
        F.col("id").alias("record_id"), F.lit("FINDING").alias("record_type"), "entity_id",
        finding_digest().alias("content_hash"), "source_phase", F.col("rule_id").alias("detector_id"),
    )


def evidence_records(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        F.col("id").alias("record_id"), F.lit("EVIDENCE").alias("record_type"), "entity_id",
        evidence_digest().alias("content_hash"), "finding_id",
    )


def table_digests(files: DataFrame) -> DataFrame:
    """One digest per ``file`` from ``file, part, sha256`` rows.

    A table stored as one file keeps that file's digest. One stored as many part files is digested in two steps,
    over 4096 buckets of parts by name and then over the buckets, so no task needs the digests of all parts.
    """
    parts = F.struct(F.col("part").alias("key"), F.col("sha256").alias("digest"))
    buckets = F.struct(F.col("_bucket").alias("key"), F.col("_digest").alias("digest"))

    def joined(rows: Column) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(rows)), lambda item: item["digest"])
        return F.sha2(F.concat_ws("", ordered), 256)

    return (
        files.withColumn("_bucket", F.substring(F.sha2("part", 256), 1, 3))
        .groupBy("file", "_bucket")
        .agg(F.count(F.lit(1)).alias("_parts"), F.max("sha256").alias("_one"), joined(parts).alias("_digest"))
        .groupBy("file")
        .agg(F.sum("_parts").alias("_parts"), F.max("_one").alias("_one"), joined(buckets).alias("_digest"))
        .select("file", F.when(F.col("_parts") == 1, F.col("_one")).otherwise(F.col("_digest")).alias("sha256"))
    )


def submission_digest(files: DataFrame, order: tuple[str, ...] = catalog.SUBMISSION_FILES) -> DataFrame:
    """Content and manifest digest of one submission: the canonical JSON list of its file digests in fixed order."""
    position = F.array_position(F.array(*[F.lit(name) for name in order]), F.col("file"))
    per_file = table_digests(files.filter(position > 0)).withColumn("_position", position)
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("_position", "file", "sha256"))),
        lambda item: F.concat(F.lit('{"file":"'), item["file"], F.lit('","sha256":"'), item["sha256"], F.lit('"}')),
    )
    listed = F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))
    return per_file.agg(
        F.sha2(listed, 256).alias("content_hash"),
        F.coalesce(F.max(F.when(F.col("file") == "manifest.json", F.col("sha256"))), F.lit("")).alias("manifest_hash"),
        F.count(F.lit(1)).alias("files"),
    )


def submission_records(digest: DataFrame, record_id: str, entity_id: str, period: str) -> DataFrame:
    return digest.select(
        F.lit(record_id).alias("record_id"), F.lit("SUBMISSION").alias("record_type"),
        F.lit(entity_id).alias("entity_id"), "content_hash", "manifest_hash", F.lit(period).alias("period"),
    )


def latest(commitments: DataFrame) -> DataFrame:
    """Current state of every record: the row with the highest version."""
    rest = [name for name in schemas.COMMITMENTS.names if name != "record_id"]
    return commitments.groupBy("record_id").agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(
        "record_id", "_row.*"
    )


def register(
    records: DataFrame, commitments: DataFrame, created_at: str, registered_by: str = "SUPERVISOR",
    only_new: bool = False,
) -> DataFrame:
    """Rows to append: each record with the version after its last one; optionally only unregistered records."""
    versions = commitments.groupBy("record_id").agg(F.max("version").alias("_last"))
    if only_new:
        numbered = records.join(versions, "record_id", "left_anti").withColumn("_last", F.lit(0))
    else:
        numbered = records.join(versions, "record_id", "left")
    complete = numbered.withColumns(
        {
            "version": F.coalesce("_last", F.lit(0)).cast("long") + 1,
            "created_at": F.lit(created_at).cast("timestamp_ntz"),
            "registered_by": F.lit(registered_by),
        }
    )
    return complete.select(
        *[
            (F.col(field.name) if field.name in complete.columns else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schemas.COMMITMENTS
        ]
    )


def history(commitments: DataFrame, record_id: str | None = None) -> DataFrame:
    """All versions, newest first; for one record or for all."""
    rows = commitments if record_id is None else commitments.filter(F.col("record_id") == record_id)
    return rows.orderBy(F.col("created_at").desc(), "record_id", F.col("version").desc())


def verify(records: DataFrame, commitments: DataFrame | None) -> DataFrame:
    """Compare freshly computed digests (``record_id, content_hash``) with the latest commitments."""
    local = records.select("record_id", F.col("content_hash").alias("local_hash"))
    if commitments is None:
        return local.select(
            "record_id", F.lit("UNAVAILABLE").alias("status"), "local_hash",
            F.lit(None).cast("string").alias("registered_hash"), F.lit(None).cast("long").alias("version"),
            F.lit(MESSAGES["UNAVAILABLE"]).alias("message"),
        )
    known = latest(commitments).select("record_id", F.col("content_hash").alias("registered_hash"), "version")
    status = (
        F.when(F.col("version").isNull(), "NOT_REGISTERED")
        .when(F.equal_null("local_hash", "registered_hash"), "VERIFIED")
        .otherwise("MISMATCH")
    )
    message = (
        F.when(
            F.col("status") == "NOT_REGISTERED",
            F.concat(F.lit("Record "), "record_id", F.lit(" has no registered commitment")),
        )
        .when(F.col("status") == "VERIFIED", MESSAGES["VERIFIED"])
        .otherwise(MESSAGES["MISMATCH"])
    )
    return (
        local.join(known, "record_id", "left")
        .withColumn("status", status)
        .select("record_id", "status", "local_hash", "registered_hash", "version", message.alias("message"))
    )
