import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import common, language, quality, queries
from vigilframe.llm.common import id_fold, table

SF = "/root/testdata/sf0.01"


def test_folds(spark):
    frame = spark.createDataFrame([(value,) for value in (0, 1, 77, -5, None)], "doc_id long").select("doc_id", id_fold(F.col("doc_id"), 5).alias("fold"))
    assert {row.doc_id: row.fold for row in frame.collect()} == {value: None if value is None else zlib.crc32(str(value).encode()) % 5 for value in (0, 1, 77, -5, None)}


def test_long_texts_count_as_whole(monkeypatch):
    text = "Some Words, here!! 12|34 *** ÄÖ the the end.\n" * 40
    whole, letters = quality.term_counts(text), language.letter_counts(text)
    monkeypatch.setattr(quality, "SLICE", 7)
    monkeypatch.setattr(language, "SLICE", 7)
    assert (quality.term_counts(text) == whole).all() and (language.letter_counts(text) == letters).all()


def test_counts_are_packed():
    counts = np.zeros((3, 5000), dtype=np.int64)
    counts[0, [0, 4999]], counts[1, 7] = (3, 1 << 20), 1
    assert (common.unpack_counts([common.pack_counts(row) for row in counts], 5000) == counts).all()


def test_terms():
    counts = quality.term_counts("aB  c\n")
    assert counts[quality.TRIPLES + (1 << 4 | 2)] == 1 and counts[quality.WORDS] == 2
    assert counts[: quality.TRIPLES].sum() == 3
    assert quality.term_counts("").sum() == 0
    repeated = quality.term_counts("the the the cat the")
    assert (repeated[quality.REPEATED], repeated[quality.SEEN]) == (2, 3)


def test_language_held_out_accuracy(spark):
    found = queries.QUERIES["op4_language"](spark, SF)
    truth = table(spark, SF, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) and 0 <= row.score <= 1 for row in rows)
    held = [row for row in rows if row.held_out]
    assert sum(row.lang_pred == row.lang for row in held) / len(held) > 0.98


def test_language_of_awkward_rows(spark, documents):
    train = [(number, text, lang, "s") for number, (text, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de"), ("le chat et le chien de la maison", "fr"), ("el gato y el perro de la casa", "es"), (None, "en"), ("nullo", None)] * 6)]
    frame = documents(*train, (None, "the dog", "en", "s"))
    model = language.train(frame, F.col("doc_id") >= 0)
    odd = documents((1, None), (2, ""), (3, "12 !! 34"), (4, "the cat of the dog"), (4, "the cat of the dog"), (None, "und die katze"), (6, "et le chien de la " * 3000), (7, "x")).withColumnRenamed("lang", "score")
    found = language.languages(odd, model).collect()
    assert len(found) == 8
    by_id = {row.doc_id: row for row in found}
    assert [by_id[number].lang_pred for number in (1, 2, 3, 4, 6, None)] == ["und", "und", "und", "en", "fr", "de"]
    assert by_id[1].score == 0 and all(0 <= row.score <= 1 for row in found)
    assert language.languages(odd.where("false"), model).count() == 0
    untaught = language.train(frame, F.lit(False))
    assert {row.lang_pred for row in language.languages(odd, untaught).collect()} == {"und"}
    alone = language.train(frame.where("lang = 'en'"), F.lit(True))
    assert {row.lang_pred for row in language.languages(odd.where("doc_id = 4"), alone).collect()} == {"en"}


def test_machine_separates():
    generator = np.random.default_rng(0)
    rows = generator.standard_normal((300, 20)).astype(np.float32)
    signs = np.where(rows[:, 3] > rows[:, 5], 1.0, -1.0)
    weights = language.support_vector_machine(rows, signs, epochs=40)
    assert (np.sign(rows @ weights) == signs).mean() > 0.97


def test_families():
    assert language.family_of("de-AT") == "germanic" and language.family_of("xx") == "only xx"


def test_quality_held_out(spark):
    found = queries.QUERIES["op6_quality"](spark, SF)
    rows = found.join(table(spark, SF, "labels"), "doc_id").collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and row.predicted == (row.score >= 0.3) for row in rows)
    held = [row for row in rows if row.held_out]
    good, bad = ([row for row in held if row.quality == side] for side in (1, 0))
    assert sum(row.predicted for row in good) / len(good) > 0.97
    assert sum(1 - row.predicted for row in bad) / len(bad) > 0.9
    assert found.count() == table(spark, SF, "documents").count()


def test_votes_equal_brute_force(spark, documents):
    frame = documents(*((number, ("Some fine words stand here. " if number % 3 else "bad bad bad *** ") * (1 + number % 5) + f"{number}") for number in range(60)))
    labels = spark.createDataFrame([(number, int(number % 3 > 0)) for number in range(45)] + [(3, None), (None, 1), (5, 1)], "doc_id long, label int")
    model = quality.train(frame, labels)
    found = {row.doc_id: row.score for row in quality.quality_scores(frame, model).collect()}
    for row in frame.collect():
        placed = quality.weighted(quality.term_counts(row.text)[None], model.idf) @ model.space
        near = (placed @ model.vectors.T / np.linalg.norm(placed))[0]
        best = np.sort(near)[::-1][: quality.NEIGHBOURS]
        chosen = np.flatnonzero(near >= best[-1] - 1e-6)
        low_high = [sum(max(near[one], 0) ** quality.SHARPNESS * model.votes[one] * (model.positive[one] == side) for one in chosen) for side in (0, 1)]
        if len(chosen) == quality.NEIGHBOURS:
            assert found[row.doc_id] == pytest.approx(low_high[1] / sum(low_high), abs=1e-4)
    documents_, frequency = quality.document_frequencies(frame)
    stacked = np.stack([quality.term_counts(row.text) for row in frame.collect()])
    assert documents_ == 60 and (frequency == (stacked > 0).sum(axis=0)).all()


def test_quality_of_awkward_rows(spark, documents):
    frame = documents((1, None), (2, ""), (3, "Fine text. " * 20_000), (3, "dup"), (None, "no id")).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    labels = spark.createDataFrame([(3, 1), (2, 0), (99, 0)], "doc_id long, label int")
    model = quality.train(frame, labels)
    found = quality.quality_scores(frame, model, name="_q").collect()
    assert len(found) == 5 and all(0 <= row._q <= 1 for row in found)
    assert {row._q for row in found if not row.text} == {model.prior}
    assert quality.quality_scores(frame.where("false"), model, name="_q").count() == 0
    untaught = quality.train(frame, labels.where("false"))
    assert {row._q for row in quality.quality_scores(frame, untaught, name="_q").collect()} == {0.5}


def test_terms_are_counted_in_small_batches(spark, documents, monkeypatch):
    key, frame, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", type(spark.range(1)), []
    before, collect = spark.conf.get(key), frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (rows.append(int(spark.conf.get(key))), collect(self))[1])
    docs = documents(*((number, f"text {number}") for number in range(3 * quality.BLOCK)))
    assert quality.document_frequencies(docs)[0] == 3 * quality.BLOCK
    assert rows == [quality.BLOCK]
    labels = spark.createDataFrame([(number, number % 2) for number in range(20)], "doc_id long, label int")
    assert len(quality.labelled_sample(docs, labels, 100)[0]) == 20
    assert rows[-1] == quality.BLOCK and spark.conf.get(key) == before
