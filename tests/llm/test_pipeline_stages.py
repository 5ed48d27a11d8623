import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import brute_components, brute_fingerprint, water_level
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from vigilframe.llm import queries
from vigilframe.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FUNCTIONS = dict(corpus_pipeline.STAGES)


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None and driver.queries()["pipeline"] is corpus_pipeline.run


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_mix(rows):
    """Copies of each row: targets by handing excess on, draws from the digest of seed, id and text."""
    sizes = Counter()
    for row in rows:
        sizes[row.source] += len(words(row.text))
    order = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    target = water_level(sizes, {name: (5, 2, 1)[place % 3] for place, name in enumerate(order)}, 1.5, 2.0)
    out = Counter()
    for row in rows:
        rate = target[row.source] / sizes[row.source] if sizes[row.source] else 0
        digest = hashlib.md5((row.text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix|{'' if row.doc_id is None else row.doc_id}|{digest}".encode()).hexdigest()[:13], 16) / 16**13
        out[row.doc_id, row.text] += int(rate) + (draw < rate - int(rate))
    return +out


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = stage(FUNCTIONS["quality"](spark, docs, sf_dir))
    assert good.columns == COLUMNS
    kept = {row.doc_id for row in good.collect()}
    assert all(doc_id in kept for doc_id, quality in labels.items() if quality == 1)
    bad = [doc_id for doc_id, quality in labels.items() if quality == 0]
    assert sum(doc_id not in kept for doc_id in bad) >= 0.9 * len(bad)

    rows = sorted(good.collect(), key=lambda row: row.doc_id)
    groups = brute_components([brute_fingerprint(row.text, 3) for row in rows], corpus_pipeline.NEAR_BITS)
    single = stage(FUNCTIONS["near_duplicates"](spark, good, sf_dir))
    assert single.columns == COLUMNS
    assert sorted(row.doc_id for row in single.collect()) == [row.doc_id for place, row in enumerate(rows) if groups[place] == place]

    def norm(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    passages = [norm(row.text) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {row.doc_id for row in single.collect() if any(passage in norm(row.text) for passage in passages)}
    clean = stage(FUNCTIONS["decontamination"](spark, single, sf_dir))
    assert clean.columns == COLUMNS
    assert {row.doc_id for row in clean.collect()} == {row.doc_id for row in single.collect()} - leaked

    mixed = stage(FUNCTIONS["mixing"](spark, clean, sf_dir))
    assert mixed.columns == COLUMNS
    assert Counter((row.doc_id, row.text) for row in mixed.collect()) == brute_mix(clean.collect())

    library, start = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), 0
    out = FUNCTIONS["token_output"](spark, mixed, sf_dir).orderBy("start").collect()
    for row, source in zip(out, sorted(mixed.collect(), key=lambda row: row.doc_id), strict=True):
        ids = library.encode(source.text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (source.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, out))


@pytest.fixture
def awkward(spark, documents):
    return documents(
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, "the same words are here twice", "en", None), (3, "the same words are here twice", "en", None),
        (4, "the same words are here twice", "en", "b"), (5, "long text " * 30_000, "en", "b"), (6, "*** ||| *** |||", "en", "b"),
    ).withColumnRenamed("n_chars", "score")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, sf_dir, awkward, name):
    out = FUNCTIONS[name](spark, awkward, sf_dir)
    if name != "token_output":
        assert out.columns == awkward.columns
    found = out.collect()
    ids = Counter(row.doc_id for row in found)
    if name == "near_duplicates":
        assert ids == Counter([1, 3, 5, 6])
    elif name == "decontamination":
        assert len(found) == 8
    elif name == "token_output":
        assert ids == Counter([None, 1, 2, 3, 3, 4, 5, 6])
    assert FUNCTIONS[name](spark, awkward.where("false"), sf_dir).count() == 0


CLASHING = ["quality_score", "kept_id", "KEPT_NULL", "kept_hash", "leaked", "mix_source", "mix_rate", "mix_rate_", "mix_copies", "mix_copy", "root", "score", "size", "rate"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_columns_that_a_stage_might_use_itself(spark, sf_dir, documents, name):
    docs = documents(*((number, f"some words of text number {number} that differ {number * 7}", "en", "a") for number in range(8)))
    for place, column in enumerate(CLASHING):
        docs = docs.withColumn(column, F.concat(F.lit(f"{place} of "), F.col("doc_id").cast("string")))
    out = FUNCTIONS[name](spark, docs, sf_dir)
    if name == "token_output":
        assert out.count() == 8
        return
    assert out.columns == docs.columns
    for row in out.collect():
        assert [row[column] for column in CLASHING] == [f"{place} of {row.doc_id}" for place in range(len(CLASHING))]


def test_empty_tables_beside(spark, sf_copy, documents):
    folder = sf_copy(
        documents=documents((1, "one text", "en", "a")), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, folder).count() == 1
