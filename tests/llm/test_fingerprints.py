import hashlib
import re
from collections import Counter

import pytest

from vigilframe.llm import fingerprints, queries


def jaccard(one, other):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", text)) for text in (one, other))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(texts):
    """The contract, row by row: the last quarter is replaced by the beginning of the next."""
    out = []
    for place, text in enumerate(texts):
        cut, after = len(text) // 4, texts[(place + 1) % len(texts)]
        out.append(text[: len(text) - cut] + after[:cut])
    return out


def prints(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    return [row.fp for row in fingerprints.fingerprints(frame, ["key"], {"fp": "text"}).orderBy("key").collect()]


def like(one, other):
    step = fingerprints.DIGITS
    return sum(one[place : place + step] == other[place : place + step] for place in range(0, len(one), step)) / fingerprints.SAMPLES


def test_collisions_estimate_weighted_similarity(spark):
    base = [f"w{number}" for number in range(60)]
    pairs = []
    for shared in (0, 15, 30, 45, 60):
        for turn in range(25):
            one = " ".join(f"{word}t{turn} " * (1 + number % 4) for number, word in enumerate(base))
            other = " ".join(f"{word if number < shared else 'z' + word}t{turn} " * (1 + (number + shared) % 3) for number, word in enumerate(base))
            pairs.append((shared, one, other))
    found = prints(spark, *(text for _, one, other in pairs for text in (one, other)))
    for shared in (0, 15, 30, 45, 60):
        some = [(like(found[2 * place], found[2 * place + 1]), jaccard(one, other)) for place, (group, one, other) in enumerate(pairs) if group == shared]
        mean, want = (sum(value[side] for value in some) / len(some) for side in (0, 1))
        assert abs(mean - want) < 0.06, shared


def test_equal_words_in_any_order_are_equal(spark):
    one, two, three, four = prints(spark, "a b b c", "b c a b", "a b c", "a\tb\nb  c ")
    assert one == two == four != three
    assert prints(spark, None, "", " ") == ["0" * fingerprints.SAMPLES * fingerprints.DIGITS] * 3


def test_awkward_rows(spark, documents):
    rows = [(None, "no id is first"), (1, None), (2, ""), (3, "same words twice"), (3, "same words twice"), (3, "same words twice"), (7, "é🙂" * 50), (9, "last " * 9000), (4, "abc")]
    frame = documents(*rows).withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "tie")
    found = fingerprints.edited_fingerprints(frame).collect()
    ordered = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    texts = [text or "" for _, text in ordered]
    want = sorted((str(row[0]), len(text), hashlib.sha256(after.encode()).hexdigest()) for row, text, after in zip(ordered, texts, edited(texts), strict=True))
    assert sorted((str(row.doc_id), row.n_chars, row.edited_sha256) for row in found) == want
    same = [row for row in found if row.doc_id == 3]
    assert sorted(row.near_next for row in same)[1:] == [1.0, 1.0] and len({row.fingerprint for row in same}) == 1
    assert fingerprints.edited_fingerprints(frame.where("false")).count() == 0


def test_one_row(documents):
    row = fingerprints.edited_fingerprints(documents((5, "abcdefgh"))).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_query(spark, sf_dir):
    frame = queries.QUERIES["op10_fingerprints"](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = {row.doc_id: row for row in frame.collect()}
    rows = sorted((row.doc_id, row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    texts = [text for _, text in rows]
    changed, by_text = edited(texts), {}
    errors = []
    for place, (doc_id, text) in enumerate(rows):
        row = found[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed[place].encode()).hexdigest())
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert row.near_next == pytest.approx(like(row.fingerprint, found[rows[(place + 1) % len(rows)][0]].fingerprint))
        assert row.near_edited == pytest.approx(like(row.fingerprint, row.edited_fingerprint))
        errors.append(row.near_edited - jaccard(text, changed[place]))
    assert abs(sum(errors) / len(errors)) < 0.03
