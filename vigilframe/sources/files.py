"""File-system access, format dispatch, atomic publishing and the layout of phase outputs.

Everything goes through Hadoop's file-system API, so local paths, HDFS and object stores behave alike.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from vigilframe import catalog, schemas, session
from vigilframe.sources import parts

FORMATS = (".csv", ".json", ".parquet")

# --- fixed values: directory names under which phase outputs are looked for, in this order ---------------------

PHASE_DIRECTORIES = {
    "phase4": ("phase4-final", "phase4-features", "phase4-check"),
    "phase5": ("phase5-final", "phase5-findings", "phase5-final-a"),
    "phase6": ("execution_gap-final", "execution_gap"),
    "phase7": ("negative_space-final", "negative_space"),
    "phase8": ("peer_anomaly-final", "peer_anomaly"),
    "phase9": ("supervisory_risk-final", "supervisory_risk"),
}
PHASE_MARKERS = {
    "phase4": "entity_features.parquet", "phase5": "findings.parquet", "phase6": "findings.parquet",
    "phase7": "findings.parquet", "phase8": "findings.parquet", "phase9": "entity_risk.parquet",
}

CANONICAL_MANIFEST, FEATURE_MANIFEST = "manifest.json", "feature_manifest.json"


class ReadError(ValueError):
    """A supported input cannot be read."""


# --- file system ----------------------------------------------------------------------------------------------


def _handle(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _handle(spark, path)
    return fs.exists(target)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, target = _handle(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def list_names(spark: SparkSession, directory: str) -> list[str]:
    fs, target = _handle(spark, directory)
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a directory to a name that is free or an empty directory."""
    fs, origin = _handle(spark, source)
    if exists(spark, target):
        fs.delete(_handle(spark, target)[1], False)
    if not fs.rename(origin, _handle(spark, target)[1]):
        raise OSError(f"Cannot publish {source} as {target}")


def create_exclusively(spark: SparkSession, path: str) -> bool:
    """Make an empty file if there is none of that name; of several callers at once one gets True.

    File systems of clusters create without overwriting in one step. The local one of Hadoop looks first and writes
    then, so files of this machine are made through the operating system.
    """
    fs, target = _handle(spark, path)
    if fs.getScheme() == "file":
        local = os.path.realpath(target.toUri().getPath())
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(target, False).close()
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _handle(spark, path)
    fs.delete(target, True)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """Write one small JSON document as a single file."""
    fs, target = _handle(spark, path)
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(json.dumps(document, indent=2).encode("utf-8")))
    finally:
        stream.close()


def read_document(spark: SparkSession, path: str) -> dict:
    """Read one small JSON document."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# --- reading --------------------------------------------------------------------------------------------------


def detect_format(path: str) -> str:
    extension = posixpath.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ReadError(f"Unsupported file format: {extension or '<none>'}")
    return extension


CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text; quoted fields may span lines.

    Files of any size are cut into records by many tasks, see ``parts``. A row with fewer fields than the header has
    nulls at its end; one with more makes whatever job reads the table fail, so no field is ever lost unseen. Files
    of a directory must have the same header.
    """
    names = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns
    records = parts.file_records(spark, path, parts.CsvCutter())
    if records.where("is_first").select("value").distinct().count() > 1:
        raise ReadError(f"Files of {posixpath.basename(path.rstrip('/'))} have different headers")
    text = F.col("value").cast("string")
    message = F.concat(F.lit("A row has more fields than the header: "), F.substring(text, 1, 200))
    intact = F.when(F.col("fields") > len(names), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return records.where(~F.col("is_first")).where(intact).select(F.from_csv(text, schema, {"escape": '"'}).alias("row")).select("row.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, each an array of records or a row of them; types inferred over all records.

    Files of any size are cut into records by many tasks and staged one to a line, which Spark then reads in parallel.
    """
    start = spark.read.option("lineSep", "}").text(path).first()
    level = 1 if start is not None and start[0].lstrip("\ufeff \t\r\n").startswith("[") else 0
    lines = f"{session.checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    parts.file_records(spark, path, parts.JsonCutter(level)).select(F.col("value").cast("string")).write.text(lines)
    frame = spark.read.json(lines)
    if CORRUPT in frame.columns:
        raise ReadError(f"{posixpath.basename(path.rstrip('/'))} holds records that are no JSON objects")
    return frame


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read one raw table by suffix. CSV columns stay text and are coerced when normalised."""
    extension = detect_format(path)
    if not exists(spark, path):
        raise ReadError(f"Input file not found: {posixpath.basename(path)}")
    try:
        if extension == ".csv":
            return read_csv(spark, path)
        if extension == ".json":
            return read_json(spark, path)
        return spark.read.parquet(path)
    except ReadError:
        raise
    except Exception as error:
        raise ReadError(f"Unable to read {posixpath.basename(path)}: {error_reason(error)}") from error


#: What the errors of a job that cuts or parses records say.
REASONS = ("more fields than the header", "something else than an array", "after the last record", "is closed")


def error_reason(error: Exception) -> str:
    """The line of an error that names what is wrong with the data, or its first one."""
    lines = str(error).splitlines() or [type(error).__name__]
    return next((line.strip().removeprefix("ValueError: ") for line in lines if any(reason in line for reason in REASONS)), lines[0])


def staged_table(spark: SparkSession, path: str) -> DataFrame:
    """A raw table, parsed once and written to the checkpoint folder; raises ReadError for rows that can't be read."""
    frame = read_table(spark, path)
    if not frame.columns:
        return frame
    try:
        return session.stage(frame)
    except Exception as error:
        raise ReadError(f"Unable to read {posixpath.basename(path)}: {error_reason(error)}") from error


def dataset_name(path: str, explicit: str | None = None) -> str:
    """Table a file holds: stated, or from its stem (``alerts``, ``alert`` or ``alerts_data``)."""
    if explicit:
        if explicit not in catalog.DATASETS:
            raise ValueError(f"Unsupported dataset type: {explicit}")
        return explicit
    name = posixpath.basename(path.rstrip("/"))
    stem = posixpath.splitext(name)[0].lower()
    for dataset in catalog.DATASETS:
        if stem in (dataset, dataset.rstrip("s"), f"{dataset}_data"):
            return dataset
    raise ValueError(f"Cannot infer dataset type from filename: {name}; use --type")


def discover(spark: SparkSession, path: str, explicit: str | None = None) -> tuple[dict[str, str], list[tuple]]:
    """Source path per table of a file or five-table package, and issue rows for what is missing or repeated."""

    def problem(dataset: str, error_type: str, message: str) -> tuple:
        return (dataset, None, error_type, message, "error")

    if not exists(spark, path):
        return {}, [problem("input", "UNREADABLE_FILE", f"Input path not found: {path}")]
    if not is_directory(spark, path) or posixpath.splitext(path.rstrip("/"))[1].lower() in FORMATS:
        try:
            return {dataset_name(path, explicit): path}, []
        except ValueError as error:
            return {}, [problem("input", "STRUCTURE", str(error))]
    names, sources, issues = list_names(spark, path), {}, []
    for dataset in catalog.DATASETS:
        matches = [
            name for name in names
            if posixpath.splitext(name)[0].lower() == dataset and posixpath.splitext(name)[1].lower() in FORMATS
        ]
        if not matches:
            message = f"Dataset package is missing {dataset}.csv, {dataset}.json, or {dataset}.parquet"
            issues.append(problem(dataset, "MISSING_REQUIRED_TABLE", message))
            continue
        sources[dataset] = posixpath.join(path, matches[0])
        if len(matches) > 1:
            issues.append(
                problem(dataset, "DUPLICATE_INPUT_FILE", f"Multiple source files found; using {matches[0]}")
            )
    return sources, issues


def _load(
    spark: SparkSession, directory: str, names: tuple[str, ...], label: str, declared: dict, manifest_name: str
) -> dict[str, DataFrame]:
    if not is_directory(spark, directory):
        raise ValueError(f"{label} input directory not found: {directory}")
    missing = [name for name in names if not exists(spark, f"{directory}/{name}.parquet")]
    if missing:
        raise ValueError(f"{label} dataset is missing: {', '.join(missing)}")
    check_committed(spark, directory, manifest_name, names)
    return {
        name: (spark.read.schema(declared[name]) if name in declared else spark.read).parquet(f"{directory}/{name}.parquet")
        for name in names
    }


class NotCommitted(ValueError):
    """An output directory lacks its manifest, or doesn't hold what the manifest lists."""


def check_committed(spark: SparkSession, directory: str, manifest_name: str, names: tuple[str, ...]) -> dict:
    """The manifest of an output, if every named table has just the files that the manifest lists.

    The manifest is written last and holds a digest over names and sizes of each table's files. A directory that
    was renamed in part, or changed later, is not read.
    """
    if not exists(spark, f"{directory}/{manifest_name}"):
        raise NotCommitted(f"{directory} has no {manifest_name}: its output is not complete")
    document = read_document(spark, f"{directory}/{manifest_name}")
    listed = document.get("files", {})
    for name in names:
        if name not in listed:
            raise NotCommitted(f"{manifest_name} of {directory} does not list {name}")
        found = table_files(spark, f"{directory}/{name}.parquet") if exists(spark, f"{directory}/{name}.parquet") else None
        if found != listed[name]:
            raise NotCommitted(f"{name} of {directory} does not hold the files that {manifest_name} lists: {listed[name]} listed, {found} found")
    return document


def table_files(spark: SparkSession, path: str) -> dict:
    """Number and bytes of a table's files, and a digest over their names and sizes."""
    sizes = listed_sizes(spark, [path])
    lines = "".join(f"{name.rsplit('/', 1)[-1]} {size}\n" for name, size in sorted((name, size) for name, size in sizes.items()))
    return {"number": len(sizes), "bytes": sum(sizes.values()), "listing_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def load_canonical(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The five canonical tables of a published data set."""
    return _load(spark, directory, catalog.DATASETS, "Canonical", schemas.CANONICAL, CANONICAL_MANIFEST)


def load_features(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The five feature tables of a published feature run."""
    return _load(spark, directory, catalog.FEATURE_TABLES, "Feature", {}, FEATURE_MANIFEST)


def resolve_phase(spark: SparkSession, root: str, phase: str, preferred: str | None = None) -> str | None:
    """Directory with a phase's output: the preferred one, the first known name under root, or root itself."""
    if phase not in PHASE_DIRECTORIES:
        raise ValueError(f"Unknown phase dataset: {phase!r}. Known: {sorted(PHASE_DIRECTORIES)}")
    if preferred is not None:
        return preferred if is_directory(spark, preferred) else None
    for candidate in (*(f"{root}/{name}" for name in PHASE_DIRECTORIES[phase]), root):
        if exists(spark, f"{candidate}/{PHASE_MARKERS[phase]}"):
            return candidate
    return None


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of one phase; an empty typed frame when the phase has not run."""
    path = f"{directory}/findings.parquet"
    return spark.read.schema(schemas.FINDINGS).parquet(path) if exists(spark, path) else empty(spark, schemas.FINDINGS)


def read_evidence(spark: SparkSession, directory: str) -> DataFrame:
    path = f"{directory}/evidence.parquet"
    return spark.read.schema(schemas.EVIDENCE).parquet(path) if exists(spark, path) else empty(spark, schemas.EVIDENCE)


# --- publishing -----------------------------------------------------------------------------------------------


def utc_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Written(NamedTuple):
    """What was seen of a table while it was written: rows, nulls per column and the columns' types."""

    rows: int
    nulls: dict[str, int]
    kinds: dict[str, str]


#: Columns that published tables are looked up by: their files carry Bloom filters, so a lookup reads few row groups.
LOOKED_UP = {
    "findings": ("id", "entity_id"), "evidence": ("finding_id", "id"), "entity_risk": ("entity_id",), "risk_contributions": ("entity_id", "id"),
    "contribution_findings": ("entity_id", "finding_id"), "review_queue": ("record_id", "entity_id"),
}


def write_observed(frame: DataFrame, path: str, looked_up: tuple[str, ...] = ()) -> Written:
    """Write a table; its rows and nulls are counted on the way, no file is read for them."""
    names, seen = frame.columns, Observation()
    counters = [F.count_if(F.col(f"`{name}`").isNull()).alias(f"nulls_{place}") for place, name in enumerate(names)]
    frame.observe(seen, F.count(F.lit(1)).alias("rows"), *counters).write.mode("errorifexists").options(
        **{f"parquet.bloom.filter.enabled#{name}": "true" for name in looked_up if name in names}
    ).parquet(path)
    counts = seen.get
    return Written(
        counts["rows"], {name: counts[f"nulls_{place}"] for place, name in enumerate(names)},
        {field.name: field.dataType.simpleString() for field in frame.schema},
    )


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], directory: str, manifest_name: str,
    manifest: Callable[[dict[str, Written]], dict],
) -> dict:
    """Write tables and then the manifest under a staging name, and rename the whole once everything is there.

    ``manifest`` is a function of what was seen while writing. A directory that holds anything is never replaced. The
    manifest lists each table's files, and readers go by it, so where rename is not atomic no half of an output is read.
    """
    if exists(spark, directory) and list_names(spark, directory):
        raise FileExistsError(f"Output directory is not empty: {directory}")
    parent, name = posixpath.split(directory.rstrip("/"))
    staging = f"{parent}/.staging-{name}-{uuid.uuid4().hex[:12]}"
    written = {table: write_observed(frame, f"{staging}/{table}.parquet", LOOKED_UP.get(table, ())) for table, frame in tables.items()}
    document = manifest(written) | {"files": {table: table_files(spark, f"{staging}/{table}.parquet") for table in tables}}
    write_document(spark, f"{staging}/{manifest_name}", document)
    rename(spark, staging, directory)
    return document


def row_counts(written: dict[str, Written]) -> dict[str, int]:
    return {name: table.rows for name, table in written.items()}


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 and size of files of any size, one row per file; directories are read file by file, but for hidden ones.

    A file is one task's, since its digest depends on all bytes in order, but never one value: its bytes stream through
    as the text between line feeds, and only the digest is carried along. Files are not split, small ones share tasks.
    """
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    pieces = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")
    )
    sizes = listed_sizes(spark, paths)
    with unsplit(spark, max(sizes.values(), default=0)):
        hashed = session.stage(pieces.mapInArrow(streamed_digests, DIGESTS))
    digest = hashlib.sha256(b"").hexdigest()
    without = spark.createDataFrame([(path, 0, digest) for path, size in sizes.items() if not size], DIGESTS)
    return hashed.unionByName(without).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "size", "sha256")


DIGESTS = "path string, size long, sha256 string"


def listed_sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Path and bytes of all files at or below the paths that Spark would read."""
    found: dict[str, int] = {}

    def visit(status) -> None:
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            return
        if status.isDirectory():
            for below in fs.listStatus(status.getPath()):
                visit(below)
        else:
            found[status.getPath().toString()] = status.getLen()

    for path in paths:
        fs, target = _handle(spark, path)
        visit(fs.getFileStatus(target))
    return found


@contextmanager
def unsplit(spark: SparkSession, largest: int) -> Iterator[None]:
    """While a job runs, no file of at most ``largest`` bytes is dealt to several tasks."""
    settings = {"spark.sql.files.maxPartitionBytes": str(largest + 1), "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "4096"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class FileDigest:
    """SHA-256 of a file from its text between line feeds, in order.

    The text source reads over a byte order mark and doesn't say whether a line feed ends the file; the file's size tells
    both, so the digest is carried along with and without the mark.
    """

    MARK = b"\xef\xbb\xbf"

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.read, self.is_new = path, size, 0, True
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(self.MARK)

    def add(self, pieces: list[bytes]) -> None:
        data = b"\n".join(pieces if self.is_new else [b"", *pieces])
        self._update(data)
        self.is_new = False

    def _update(self, data: bytes) -> None:
        self.plain.update(data)
        self.marked.update(data)
        self.read += len(data)

    def row(self) -> pa.RecordBatch:
        if self.size - self.read in (1, 1 + len(self.MARK)):
            self._update(b"\n")
        if self.size - self.read not in (0, len(self.MARK)):
            raise ValueError(f"{self.path} changed while it was read")
        digest = self.plain if self.size == self.read else self.marked
        return pa.record_batch([pa.array([self.path]), pa.array([self.size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "size", "sha256"])


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file; a task holds a batch of its text at a time."""
    held: FileDigest | None = None
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        names = batch.column(0).dictionary_encode()
        codes = names.indices.to_numpy()
        borders = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
        for low, high in zip(borders, [*borders[1:], batch.num_rows], strict=True):
            path = names.dictionary[int(codes[low])].as_py()
            if held is None or held.path != path:
                if held is not None:
                    yield held.row()
                held = FileDigest(path, int(sizes[low]))
            held.add(batch.column(2).slice(low, high - low).to_pylist())
    if held is not None:
        yield held.row()
