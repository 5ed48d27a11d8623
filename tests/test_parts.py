import csv
import io
import json
import random

import pytest
from support import values

from vigilframe.sources import files, parts


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few records; long ones reach over some."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def random_fields(draw, number):
    signs = ["a", "b", "é", " ", ",", '"', "\n", "\r\n", "{", "\U0001f600"]
    return [["".join(draw.choice(signs) for _ in range(draw.randint(0, 9) * (30 if draw.random() < 0.02 else 1))) for _ in range(3)] for _ in range(number)]


def written(rows, **options):
    out = io.StringIO()
    csv.writer(out, **options).writerows(rows)
    return out.getvalue().encode()


@pytest.mark.parametrize("seed", range(4))
def test_csv_cut_anywhere_is_the_whole_files_parse(spark, tmp_path, small_ranges, seed):
    draw = random.Random(seed)
    rows = random_fields(draw, 120)
    ends = ["\n", "\r\n"][seed % 2]
    data = written([["id", "x", "y"], *rows], lineterminator=ends, quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL][seed // 2])
    (tmp_path / "t.csv").write_bytes(data if seed else data.rstrip())
    found = files.read_table(spark, str(tmp_path / "t.csv"))
    assert values(found.na.fill(""), "id", "x", "y") == sorted(map(tuple, rows), key=repr)
    if ends == "\n":
        whole = spark.read.csv(str(tmp_path / "t.csv"), header=True, multiLine=True, escape='"')
        assert values(found, "id", "x", "y") == values(whole, "id", "x", "y")


def test_csv_ranges_are_cut_by_several_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_bytes(written([["id", "x"], *[[str(one), "long text\nof two lines " * 4] for one in range(80)]]))
    read = parts.pieces(spark, str(tmp_path / "t.csv"), "\n")
    assert read.rdd.getNumPartitions() > 20
    states = parts.first_states(read.mapInArrow(parts.sums(parts.CsvCutter()), parts.SUMS), "\n")
    assert len(states.keys) > 20
    assert 0 < states.inside.sum() < len(states.inside)
    assert files.read_table(spark, str(tmp_path / "t.csv")).count() == 80


def test_csv_quotes_inside_fields_and_blank_lines(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfid,x\n5" pipe,a\n\n"q" tail,b\n x "y,c\n"",\n')
    found = files.read_table(spark, str(tmp_path / "t.csv"))
    assert found.columns == ["id", "x"]
    assert set(values(found.na.fill(""), "id", "x")) == {("", ""), (' x "y', "c"), ('"q" tail', "b"), ('5" pipe', "a")}


def test_csv_that_ends_inside_a_field_fails(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_bytes(b'id,x\n1,a\n2,"open' + b"\nmore,text" * 20)
    with pytest.raises(files.ReadError, match="closed"):
        files.read_table(spark, str(tmp_path / "t.csv"))


def test_csv_directory_with_different_headers_fails(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"id,x\n1,a\n")
    (folder / "b.csv").write_bytes(b"id,x\n2,b")
    assert values(files.read_table(spark, str(folder)), "id", "x") == [("1", "a"), ("2", "b")]
    (folder / "c.csv").write_bytes(b"x,id\nc,3\n")
    with pytest.raises(files.ReadError, match="different headers"):
        files.read_table(spark, str(folder))


def random_record(draw, place):
    text = "".join(draw.choice(["a", "é", '"', "\\", "{", "}", "[", "]", ",", "\n", "\U0001f600"]) for _ in range(draw.randint(0, 12)))
    return {"id": place, "text": text, "inner": {"list": [{"a": text}, {}], "n": place}}


@pytest.mark.parametrize("seed", range(4))
def test_json_cut_anywhere_is_the_whole_files_parse(spark, tmp_path, small_ranges, seed):
    draw = random.Random(seed)
    rows = [random_record(draw, place) for place in range(40)]
    options = [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}, {}][seed]
    text = "\n".join(json.dumps(row) for row in rows) if seed == 3 else json.dumps(rows, **options)
    (tmp_path / "t.json").write_bytes(text.encode() + b"\n" * (seed % 2))
    found = files.read_table(spark, str(tmp_path / "t.json"))
    kept = sorted((row.id, row.text, row.inner.n, [one.a for one in row.inner["list"]]) for row in found.collect())
    assert kept == [(row["id"], row["text"], row["id"], [row["text"], None]) for row in rows]


@pytest.mark.parametrize("text", [
    '[{"a": 1}, {"a": 2', '[{"a": 1}, {"a": "}', '[{"a": 1}', '[{"a": 1}, 7, {"a": 2}]', '[{"a": 1}] trailing', '[1, 2]', '{"a": 1', '[{"a": 1 2}]',
])
def test_json_that_is_no_array_of_records_fails(spark, tmp_path, small_ranges, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(files.ReadError):
        files.read_table(spark, str(tmp_path / "t.json"))


def test_json_without_records(spark, tmp_path):
    for text in ("[]", " [ ]\n", ""):
        (tmp_path / "t.json").write_text(text)
        assert files.read_table(spark, str(tmp_path / "t.json")).columns == []
    (tmp_path / "t.json").write_text('{"a": {"b": 1}}')
    assert files.read_table(spark, str(tmp_path / "t.json")).first().a.b == 1
