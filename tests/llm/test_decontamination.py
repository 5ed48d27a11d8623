import re

import numpy as np
import pytest

from vigilframe.llm import decontaminate, queries

ITEM = "A train leaves Paris at 9 and travels 300 km to the city of Lyon. How long does the train travel if Maria Lopez drives it at 100 km per hour without a stop?"


def found(docs, bench, **options):
    return {(row.doc_id, row.item_id): row for row in decontaminate.matches(docs, bench, **options).collect()}


@pytest.fixture
def bench(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "item_id long, text string")

    return make


FILLER = "Nothing that stands here belongs to any question at all, it only fills the page with words. "


def test_templates():
    _, tokens = next(decontaminate.Canonicaliser().forms("Then Maria Lopez ran 5 km, or 5km (in 20 minutes) in $3.50! IT WAS | Good.\nNew line"))
    literals = [tokens.literal(place) for place in range(len(tokens.kinds))]
    signs = [decontaminate.PLACEHOLDER.get(kind, value) for kind, value in zip(tokens.kinds.tolist(), literals, strict=True)]
    assert signs == ["then", "<name>", "ran", "<qty>", "or", "<qty>", "in", "<qty>", "in", "<qty>", "it", "was", "<name>", "new", "line"]
    assert literals[1] == "maria lopez" and literals[3] == "5 km"


def test_copies_and_new_parameters(documents, bench):
    other = ITEM.replace("Paris", "Rome").replace("9", "7").replace("300", "450").replace("Lyon", "Bari").replace("Maria Lopez", "Jan").replace("100", "90")
    docs = documents(
        (1, FILLER + ITEM + " " + FILLER), (2, FILLER + other + " " + FILLER), (3, ITEM.upper()), (4, FILLER * 5), (5, ITEM.lower()), (6, "### " + " | ".join(ITEM.split())),
        (7, ITEM.replace("the city of Lyon", "a town").replace("without a stop", "on")), (8, None), (9, ""), (None, ITEM), (1, FILLER),
    )
    got = found(docs.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "coverage"), bench((10, ITEM), (11, None), (12, ""), (13, "one two"), (14, FILLER.replace("page", "wall") * 2)))
    assert {pair[0] for pair in got if pair[1] == 10} >= {1, 2, 3, 5, 6, None}
    assert got[1, 10].changed_slots == 0 and got[2, 10].changed_slots >= 5
    assert not {4, 7, 8, 9} & {pair[0] for pair in got if pair[1] == 10} and not {pair[1] for pair in got} & {11, 12, 13}


def test_slots_must_agree_throughout(documents, bench):
    item = "If x costs 5 and y costs 5 then both of them cost twice as much as 5 in this little shop, so what does x cost there"
    same, mixed = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    got = found(documents((1, same), (2, mixed)), bench((1, item)))
    assert (1, 1) in got and (2, 1) not in got


def test_equal_numbers_need_not_stay_equal(documents, bench):
    item = "Tom buys 3 apples and 4 pears for his friends, then he sells 5 plums and 5 nuts to them at the market, so how many pieces are left of 40"
    other = item.replace("3", "5").replace("4 pears", "5 pears")
    apart = item.replace("5 plums", "6 plums").replace("5 nuts", "7 nuts").replace("3", "8")
    typo = "If x costs 7 coins then we know that two of them together with all of the other things that stand in the shop cost 7 more than that"
    docs = documents((1, other), (2, apart), (3, typo.replace("7 more", "9 more").rsplit(" ", 2)[0]))
    assert {(1, 1), (2, 1), (3, 2)} <= set(found(docs, bench((1, item), (2, typo))))


def test_copies_of_items_with_few_words(documents, bench):
    items = ["What is 12 * 7 - 3 ?", "Compute 48 + 24 - 6", "Who wrote Hamlet?", "1 2 3 4 5 6 7 8 9 km", "Why?"]
    docs = documents(*((number, f"{FILLER}{item} {FILLER}") for number, item in enumerate(items)), (10, FILLER + "What is 13 * 8 - 4 ? Compute 49 + 25 - 7. Who wrote Macbeth? " + FILLER))
    assert set(found(docs, bench(*enumerate(items), (9, "?!"), (8, "")))) == {(number, number) for number in range(len(items))}


def test_windows_with_few_words_cost_no_match(documents, bench):
    item = "What is the sum of 1 2 3 4 5 6 7 8 9 10 11 12 and of the number 13"
    other = "What is the sum of 21 22 23 24 25 26 27 28 29 30 31 32 and of the number 33"
    assert (1, 1) in found(documents((1, other)), bench((1, item)))


def test_inserted_and_deleted_words(documents, bench):
    words = [f"w{number}" for number in range(37)]
    item, (first, second, third) = " ".join(words), (words[:12], words[12:25], words[25:])
    docs = documents(
        (1, " ".join([*words[:18], "so", *words[18:]])), (2, " ".join([*first, "so", *second, "then", *third])), (3, " ".join(words[:18] + words[19:])),
        (4, " ".join([*second, *first, *third[:4]])), (5, " ".join([*first, *FILLER.split() * 3, *third])), (6, FILLER + ITEM.replace("Maria Lopez drives", "Jan drives").replace("km to the", "km all the way to the")),
        (7, " ".join(["x", *words[:19], "so", "x", *words[19:]] * 20)), (8, " ".join([*first, *FILLER.split()[:10], *second, *third])), (9, "Jan " + ITEM.replace("How long does", "How very long does").replace("300", "80")),
    )
    got = found(docs, bench((1, item), (2, ITEM)))
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (6, 2), (9, 2)}
    assert got[1, 1].matched_windows == 29 and got[2, 1].matched_windows == 25 and got[3, 1].matched_windows == 28


def test_parts_are_put_together_in_order():
    def at(*places):
        return {place: {"item_slots": [], "slots": []} for place in places}

    assert sorted(decontaminate.put_together({0: at(0, 1, 2), 1: at(7, 8), -2: at(3, 4)})) == [0, 1, 2, 7, 8]
    assert sorted(decontaminate.put_together({0: at(0, 1, 2), -2: at(5, 6)})) == [0, 1, 2, 5, 6]
    assert sorted(decontaminate.put_together({5: at(0, 1, 2), 0: at(3, 4, 5, 6)})) == [3, 4, 5, 6]


def test_short_items_with_a_word_changed(documents, bench):
    item = "one day the small red engine went over the far hills to bring all the toys home"
    got = found(documents((1, item.replace("hills", "mountains")), (2, item.replace("red", "").replace("toys", "boys").replace("far", "low"))), bench((1, item)))
    assert (1, 1) in got and (2, 1) not in got


def test_windows_of_other_places_do_not_add_up(documents, bench):
    words = [f"w{number}" for number in range(40)]
    item = " ".join(words)
    turned = " ".join(words[:10] + ["other"] * 3 + words[20:30] + ["more"] * 5 + words[10:20])
    assert found(documents((1, turned)), bench((1, item))) == {}
    assert (2, 1) in found(documents((2, "before " + " ".join(words[5:35]) + " after")), bench((1, item)))


def test_short_items_and_copies(documents, bench):
    docs = documents(*((number, "so the quick brown fox jumps " * (1 + number % 3)) for number in range(50)), (99, "the quick brown cat"))
    got = found(docs, bench((1, "The quick brown fox jumps"), (2, "The quick brown fox jumps"), (3, "too short")))
    assert set(got) == {(number, item) for number in range(50) for item in (1, 2)}


def test_empty_tables(documents, bench):
    docs = documents((1, ITEM))
    assert found(docs.where("false"), bench((1, ITEM))) == {} and found(docs, bench((1, ITEM)).where("false")) == {}


def test_filter_never_hides_a_window(spark, bench):
    items = decontaminate.benchmark_windows(bench(*((number, f"word{number} " + ITEM + f" tail{number}") for number in range(300)))).cache()
    bits, sizes = decontaminate.window_filter(items.withColumnRenamed("id", "item_id"))
    assert sizes == [5]
    for _, tokens in decontaminate.Canonicaliser().forms("word7 " + ITEM + " tail7"):
        assert decontaminate.in_filter(bits, decontaminate.window_hashes(tokens.hashes, 5))[np.convolve(tokens.kinds == 0, [1] * 5, "valid") >= 3].all()


def test_query_finds_planted_passages(spark, sf_dir):
    def norm(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    docs = {row.doc_id: norm(row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {row.item_id: norm(row.text) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(row.doc_id, row.item_id) for row in queries.QUERIES["op8_decontamination"](spark, sf_dir).collect()}
    planted = {(doc, item) for doc, text in docs.items() for item, passage in items.items() if passage in text}
    assert planted and planted <= got
    for doc, item in got - planted:  # near copies only
        words = items[item].split()
        assert sum(f" {' '.join(words[place : place + 8])} " in docs[doc] for place in range(len(words) - 7)) >= 0.4 * (len(words) - 7)


def test_a_frame_of_many_items_is_no_match(documents, bench, spark, monkeypatch):
    frame, end = "which of the following statements is true about", "and its close neighbours"
    items = [(number, f"{frame} subject{number} {end}") for number in range(200)]
    docs = [(number, f"{frame} matter{number} with quite another end than that, since nothing here is asked") for number in range(200)]
    staged = []
    kept = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda frame: staged.append(kept(frame)) or staged[-1])
    got = found(documents(*docs, (900, items[7][1]), (901, FILLER + items[8][1].replace("close", "nearest"))), bench(*items))
    assert set(got) == {(900, 7), (901, 8)}
    assert max(frame.count() for frame in staged if "shift" in frame.columns) < 100
    assert set(found(documents((1, items[3][1])), bench(*[(number, items[3][1]) for number in range(30)]))) == {(1, number) for number in range(30)}


def test_matches_are_brute_force(documents, bench):
    """Items of plain words: a match is an alignment that covers half of an item's windows and a quarter of their weight."""
    import random
    from collections import Counter

    draw = random.Random(4)
    words = [f"v{chr(97 + number // 26)}{chr(97 + number % 26)}" for number in range(60)]
    base = [[draw.choice(words) for _ in range(draw.randint(8, 16))] for _ in range(12)]
    items = [part[: len(part) // 2] + [draw.choice(words) for _ in range(len(part) - len(part) // 2)] if number % 3 else part for number in range(30) for part in [base[number % 12]]]
    docs = []
    for _ in range(60):
        text = [draw.choice(words) for _ in range(draw.randint(0, 10))]
        part = draw.choice(items)
        start = draw.randint(0, len(part) // 2)
        docs.append(text + part[start : start + draw.randint(4, 16)] + [draw.choice(words) for _ in range(draw.randint(0, 10))])

    def cut(part):
        return [tuple(part[place : place + 5]) for place in range(len(part) - 4)]

    held = Counter(window for item in items for window in set(cut(item)))
    want = set()
    for doc_id, doc in enumerate(docs):
        places = {}
        for place, window in enumerate(cut(doc)):
            places.setdefault(window, []).append(place)
        for item_id, item in enumerate(items):
            whole, by_shift = cut(item), {}
            for at, window in enumerate(whole):
                for place in places.get(window, []):
                    by_shift.setdefault(place - at, set()).add(at)
            total = sum(1 / held[window] for window in whole)
            if any(len(one) >= 0.5 * len(whole) and sum(1 / held[whole[at]] for at in one) >= 0.25 * total for one in by_shift.values()):
                want.add((doc_id, item_id))
    got = found(documents(*((number, " ".join(doc)) for number, doc in enumerate(docs))), bench(*((number, " ".join(item)) for number, item in enumerate(items))))
    assert len(want) > 30 and want <= set(got)
    for pair in set(got) - want:  # put together from parts
        assert got[pair].coverage >= 0.5
