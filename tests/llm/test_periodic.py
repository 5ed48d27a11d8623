import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from vigilframe.llm import periodic, queries


def brute_runs(words):
    """All lags over all words, whatever occurs how often."""
    found = []
    for period in range(1, len(words) // 4 + 1):
        place = 0
        while place + period < len(words):
            if words[place] != words[place + period]:
                place += 1
                continue
            start = place
            while place + period < len(words) and words[place] == words[place + period]:
                place += 1
            length = place + period - start
            stretch = words[start : start + length]
            least = next(q for q in range(1, period + 1) if stretch[q:] == stretch[: length - q])
            if least == period and length >= max(6, 4 * period):
                found.append((start, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=(None, None, None))
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def planted_words(draw, letters):
    words = []
    for _ in range(draw.randint(1, 5)):
        kind = draw.random()
        if kind < 0.6:
            cycle = [draw.choice(letters) for _ in range(draw.randint(1, 12))]
            words += (cycle * draw.randint(1, 9))[: draw.randint(1, 90)]
        else:
            words += [draw.choice(letters) for _ in range(draw.randint(0, 25))]
    return words


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", [f"w{i}" for i in range(200)]])
def test_runs_of_a_batch_are_those_of_all_lags(letters):
    draw = random.Random(len(letters))
    rows = [[word.encode() for word in planted_words(draw, letters)] for _ in range(120)]
    rows += [[], [b"a"] * 5, [b"a"] * 6, [b"a"] * 500, [b"a", b"b"] * 3, [b"a", b"b"] * 4, [b"a", b"a", b"b"] * 40]
    for words, (runs, _, _) in zip(rows, periodic.document_runs(rows), strict=True):
        assert runs == brute_runs(words), words


def test_nested_runs():
    """Runs inside the period of a longer run are runs too; each counts by its own smallest period."""
    inner = [b"x"] * 7 + [b"y", b"z"]
    rows = [inner * 5 + [b"end"], ([b"p", b"q"] * 5 + [b"r"]) * 4]
    for words, (runs, _, _) in zip(rows, periodic.document_runs(rows), strict=True):
        assert runs == brute_runs(words)
        assert len({period for _, _, period in runs}) == 2


def test_splitting_keeps_documents_and_segments_apart():
    rows = [[b"a"] * 4, [b"a"] * 4, [b"a", b"a", b"a", b"k", b"a", b"a", b"a"]]
    assert [runs for runs, _, _ in periodic.document_runs(rows)] == [[], [], []]


def test_long_texts_take_few_lags():
    draw = random.Random(3)
    words = [b"%d" % draw.randint(0, 40) for _ in range(200_000)]
    words[50_000:58_000] = words[50_000:52_000] * 4
    [(runs, _, _)] = list(periodic.document_runs([words]))
    assert any(period == 2000 and length >= 8000 for _, length, period in runs)
    [(runs, _, _)] = list(periodic.document_runs([[b"a"] * 300_000]))
    assert runs == [(0, 300_000, 1)]


def test_query_is_brute_force(spark, documents, sf_copy, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 50)
    draw = random.Random(5)
    rows = [(doc_id, " \t\n"[doc_id % 3].join(planted_words(draw, "abé"))) for doc_id in range(150)]
    rows += [(None, "a b " * 9), (None, None), (7, None), (8, ""), (8, ""), (9, " \n"), (10, "one\xa0two one\xa0two"), (-11, "u v " * 20)]
    folder = sf_copy(documents=documents(*rows).withColumnRenamed("lang", "n_runs").withColumnRenamed("source", "period"))
    found = queries.QUERIES["op13_periodic_runs"](spark, folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((brute_row(*row) for row in rows), key=repr)
    assert any(row.n_runs for row in found)


def test_no_rows(spark, documents):
    assert periodic.periodic_runs(documents()).collect() == []
