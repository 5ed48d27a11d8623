import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from vigilframe import schemas
from vigilframe.plans import pipeline
from vigilframe.sources import files


def test_digests_of_any_bytes(spark, tmp_path):
    draw = random.Random(1)
    contents = {
        "noise.parquet": draw.randbytes(300_000), "zeros.parquet": bytes(100_000), "lines.csv": b"a,b\n" * 9000, "open.csv": b"a,b\n1,2",
        "mark.csv": b"\xef\xbb\xbfa,b\n1,2\n", "mark_open.csv": b"\xef\xbb\xbfa,b", "feed.csv": b"\n", "feeds.csv": b"\r\n\n\n", "none.csv": b"",
        "with space.json": "[é]".encode(), "inner/deep.csv": b"x",
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"hidden")
    found = {row["filename"]: (row["size"], row["sha256"]) for row in files.file_digests(spark, [str(tmp_path)]).collect()}
    assert {name.replace("%20", " "): value for name, value in found.items()} == {
        name.rsplit("/", 1)[-1]: (len(content), hashlib.sha256(content).hexdigest()) for name, content in contents.items()
    }


def test_a_large_file_is_hashed_by_one_task_in_pieces(spark, tmp_path):
    content = random.Random(2).randbytes(1 << 20) * 48
    (tmp_path / "large.parquet").write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        row = files.file_digests(spark, [str(tmp_path / "large.parquet")]).first()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row["size"], row["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())


@pytest.fixture
def canonical(spark, tmp_path):
    tables = {name: spark.createDataFrame([], schema) for name, schema in schemas.CANONICAL.items()}
    files.publish(spark, tables, str(tmp_path / "canonical"), files.CANONICAL_MANIFEST, lambda written: {"row_counts": files.row_counts(written)})
    return tmp_path / "canonical"


def test_outputs_are_read_by_their_manifest(spark, canonical):
    assert set(files.load_canonical(spark, str(canonical))) == set(schemas.CANONICAL)
    os.rename(canonical / "manifest.json", canonical / "later.json")
    with pytest.raises(files.NotCommitted, match="no manifest.json"):
        files.load_canonical(spark, str(canonical))


@pytest.mark.parametrize("change", ["less", "more", "other"])
def test_half_an_output_is_not_read(spark, canonical, change):
    folder = canonical / "alerts.parquet"
    [part] = [name for name in os.listdir(folder) if name.endswith(".parquet")]
    if change == "less":
        os.rename(folder / part, canonical / "moved")
    elif change == "more":
        (folder / "part-extra.parquet").write_bytes((folder / part).read_bytes())
    else:
        os.rename(folder / part, folder / "part-other.parquet")
    with pytest.raises(files.NotCommitted, match="alerts"):
        files.load_canonical(spark, str(canonical))




def test_of_two_runs_at_once_one_commits(spark, tmp_path, monkeypatch):
    path, gate, outcome = str(tmp_path / "commitments"), threading.Barrier(2), []
    exclusively = files.create_exclusively

    def together(*arguments):
        gate.wait(60)
        return exclusively(*arguments)

    monkeypatch.setattr(files, "create_exclusively", together)
    digest = spark.createDataFrame([("one", "m", 2)], "content_hash string, manifest_hash string, files long")

    def run(number):
        try:
            outcome.append(pipeline.commit_records(spark, pipeline.integrity.submission_records(digest, "S-1", "E1", "2024-01"), path, "2024-07-01 00:00:00"))
        except FileExistsError:
            outcome.append("lost")

    threads = [threading.Thread(target=run, args=(number,)) for number in range(2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(240)
    assert sorted(map(str, outcome)) == ["1", "lost"]
    assert [row["version"] for row in pipeline.read_commitments(spark, path).collect()] == [1]


def test_a_batch_that_was_not_written_whole_does_not_count(spark, tmp_path):
    path = str(tmp_path / "commitments")
    digest = spark.createDataFrame([("one", "m", 2)], "content_hash string, manifest_hash string, files long")
    failing = pipeline.integrity.submission_records(digest, "S-1", "E1", "2024-01").withColumn("content_hash", F.raise_error(F.lit("lost executor")).cast("string"))
    with pytest.raises(Exception, match="lost executor"):
        pipeline.commit_records(spark, failing, path, "2024-07-01 00:00:00")
    os.makedirs(f"{path}/batch-000000000/_temporary")
    assert pipeline.read_commitments(spark, path).count() == 0
    assert pipeline.commit_records(spark, pipeline.integrity.submission_records(digest, "S-1", "E1", "2024-01"), path, "2024-07-01 00:00:00") == 1
    assert pipeline.read_commitments(spark, path).count() == 1


def test_a_lookup_reads_one_of_many_row_groups(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 40).select(
        F.concat(F.lit("F-"), F.sha2(F.col("id").cast("string"), 256)).alias("id"), F.col("id").cast("string").alias("title"),
        F.lit("E1").alias("entity_id"),
    )
    files.publish(spark, {"findings": rows}, str(tmp_path / "out"), "m.json", lambda written: {"rows": files.row_counts(written)})
    wanted = rows.where("title = '777'").first()["id"]
    found = spark.read.parquet(str(tmp_path / "out" / "findings.parquet")).where(F.col("id") == wanted)
    assert [row["title"] for row in found.collect()] == ["777"]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 500
