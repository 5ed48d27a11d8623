import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vigilframe.llm import encoding, queries, simple8b, token_output
from vigilframe.llm.token_counts import token_counts

PATH = public_tokenizers.path(queries.TOKENIZER)
AWKWARD = [
    None, "", " \n\t ", "plain words, and it's a test. don't!", "<|endoftext|> inside<|startoftext|>text <|ENDOFTEXT|>", "éa ́b J̌", "no break em\x85nel\x1cfs",
    "日本語 テキスト", "🙂🙃 emoji", "x" * 5000, "word " * 20_000, "ΑΣ ΣΑΣ İstanbul ß", "a\x0bb\x0cc\rd",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_lanes_fill_sixty_bits_at_most():
    assert all(count * bits <= 60 for count, bits in simple8b.LANES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 12))
def test_any_ids_come_back(ids, times):
    values = np.array(ids * times, dtype=np.uint64)
    words, offsets, escapes = simple8b.pack(values)
    assert (simple8b.unpack(words, offsets, escapes, len(values)) == values).all()
    assert len(escapes) == sum(value >= 2**60 for value in values.tolist())


def test_a_block_is_decoded_alone():
    values = np.arange(5000, dtype=np.uint64) * np.uint64(977) % np.uint64(49_408)
    words, offsets, escapes = simple8b.pack(values)
    third = simple8b.unpack(words[offsets[2] : offsets[3]], offsets[2:4] - offsets[2], escapes, simple8b.BLOCK)
    assert (third == values[2 * simple8b.BLOCK : 3 * simple8b.BLOCK]).all()


def test_words_pack_many_small_ids():
    assert len(simple8b.pack(np.zeros(600, np.uint64))[0]) == 10
    assert len(simple8b.pack(np.full(8, 32_767, np.uint64))[0]) == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'ſtés \n\t ́<|endoftext>.,1İß日\x1c"), max_size=40))
def test_pieces_give_the_library_ids(text):
    encoder = _encoder()
    [*found] = encoding.runs([text.encode()], encoder)
    known = encoder.values(pieces for _, pieces in found[0])
    coded = b"".join(known[piece] for piece in found[0][0][1])
    assert np.frombuffer(coded, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def _encoder(kept=[]):
    if not kept:
        kept.append(encoding.PieceEncoder(PATH, encoding.id_bytes))
    return kept[0]


def test_only_tokenizers_without_white_space_are_cut():
    assert encoding.drops_white_space(PATH)
    assert not encoding.drops_white_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = ("ab " * 50 + "c" * 200 + " d\n").encode() * 5
    parts = list(encoding.cut_at_space(text, 64))
    assert b"".join(parts) == text and len(parts) > 10
    assert all(part[:1].isspace() for part in parts[1:])


def test_token_counts_equal_the_library(spark, documents, library):
    frame = documents(*enumerate(AWKWARD), (3, AWKWARD[3]), (None, "no id")).withColumnRenamed("lang", "n_tokens")
    found = token_counts(frame, PATH, limit=100).collect()
    want = sorted(
        (str(number), len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids))
        for number, text in [*enumerate(AWKWARD), (3, AWKWARD[3]), (None, "no id")]
    )
    assert sorted((str(row.doc_id), row.n_bytes, row.n_tokens) for row in found) == want
    assert all(row.over_limit == (row.n_tokens > 100) for row in found)


def test_other_tokenizers_get_whole_texts(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    found = {row.doc_id: row.n_tokens for row in token_counts(documents(*enumerate(AWKWARD)), path).collect()}
    assert found == {number: len(whole.encode(text or "", add_special_tokens=False).ids) for number, text in enumerate(AWKWARD)}


def test_token_files_hold_every_text(spark, documents, library, tmp_path):
    rows = [*((5 * number, text) for number, text in enumerate(AWKWARD)), (None, "no id"), (10, "again"), (10, "again")]
    token_output.write_token_files(documents(*rows), str(tmp_path / "t"), PATH, 2)
    read = token_output.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("part", "piece", "place").collect()
    ids = [row.doc_id for row in read]
    assert ids == sorted(ids, key=lambda one: (one is not None, one or 0))
    expected = sorted((str(number), library.encode(text or "", add_special_tokens=False).ids + [2]) for number, text in rows)
    assert sorted((str(row.doc_id), row.ids) for row in read) == expected
    assert all(row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes()) and row.n_tokens == len(row.ids) for row in read)
    index = token_output.token_index(spark, str(tmp_path / "t")).collect()
    assert sorted((row.start, row.n_tokens) for row in index) == [
        (sum(row.n_tokens for row in read[:place]), row.n_tokens) for place, row in enumerate(read)]


def _table(kept=[]):
    if not kept:
        kept.append(token_output.IdTable(PATH))
    return kept[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBz'ſtés \n\t ́<|endoftext>.,#&1İßʼnǅµ日Ω\x1c"), max_size=30), min_size=1, max_size=4))
def test_runs_give_the_library_ids(texts):
    table = _table()
    found = token_output.run_ids(table, [text.encode() for text in texts])
    assert [ids.tolist() for ids in found] == [table.encoder.library.encode(text, add_special_tokens=False).ids for text in texts]


def test_a_word_is_learned_once_whatever_signs_follow():
    table = token_output.IdTable(PATH)
    texts = ["Word word. WORD### word!", "été, été; <|endoftext|>word <|ENDOFTEXT|> don't 12#"]
    found = token_output.run_ids(table, [text.encode() for text in texts])
    assert [ids.tolist() for ids in found] == [table.encoder.library.encode(text, add_special_tokens=False).ids for text in texts]
    assert set(table.number) == {b"word", b".", b"###", b"!", "été".encode(), b",", b";", b"<|endoftext|>word", b"<|ENDOFTEXT|>", b"don't", b"12#"}
    assert not table.encoder.young and not table.encoder.old  # ids are kept once


def test_units_met_least_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_output, "KEPT_NUMBERS", 40)
    table = token_output.IdTable(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for number in range(60):
        text = " ".join(["often", "often,", *(letters[number % 26 : number % 26 + 3] + letters[place] + letters[number % 7] for place in range(20))])
        [ids] = token_output.run_ids(table, [text.encode()])
        assert ids.tolist() == table.encoder.library.encode(text, add_special_tokens=False).ids
        assert len(table.number) <= 40 + 22 and len(table.pool) < 1000
        assert table.number[b"often"] < 2


@pytest.mark.parametrize("texts", [[b""], [b" \n"], [b"", b"a", b""], [b"bad \xff\xfe bytes\xc3 here."], [b"\xff"]])
def test_no_words_and_bytes_that_are_no_text(texts):
    table = _table()
    want = [table.encoder.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in token_output.run_ids(table, texts)] == want


def test_whole_texts_are_not_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    table, whole = token_output.IdTable(path), Tokenizer.from_file(path)
    assert not table.parts
    for texts in (["one text", " two  texts\n"], ["", "three"]):
        assert [ids.tolist() for ids in token_output.run_ids(table, [text.encode() for text in texts])] == [whole.encode(text, add_special_tokens=False).ids for text in texts]
        assert len(table.number) == 2


def test_damage_is_seen(documents):
    whole = token_output.frame([7], [3], np.array([1, 2, 3])) + token_output.END.encode("latin-1")
    assert list(token_output.parse_frames(whole))[0][0] == [7]
    damaged = bytearray(whole)
    damaged[70] ^= 1
    with pytest.raises(ValueError):
        list(token_output.parse_frames(bytes(damaged)))


def test_many_frames_and_files(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "FRAME_IDS", 50)
    monkeypatch.setattr(token_output, "FILE_FRAMES", 2)
    rows = [(number, f"some words of document {number} " * (number % 7)) for number in range(120)]
    found = token_output.token_output(documents(*rows), PATH, 2, str(tmp_path / "f")).orderBy("doc_id").collect()
    held = 0
    for row in found:
        assert row.start == held
        held += row.n_tokens


def test_pieces_are_read_from_the_end_of_a_name(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "FRAME_IDS", 50)
    monkeypatch.setattr(token_output, "FILE_FRAMES", 1)
    token_output.write_token_files(documents(*((number, f"some words of document {number} " * (number % 7)) for number in range(120))), str(tmp_path / "f"), PATH, 2)
    (tmp_path / "g").mkdir()
    for file in (tmp_path / "f").glob("part-*.txt"):
        part, piece = file.name[:10], file.name[file.name.rindex("-c") :]
        shutil.copy(file, tmp_path / "g" / f"{part}-6b5a3c2e-c2d1-4e5f-8a9b-c0ffee123456{piece}")
    assert token_output.read_token_files(spark, str(tmp_path / "g")).agg({"piece": "max"}).first()[0] > 0
    held = 0
    for row in token_output.token_index(spark, str(tmp_path / "g")).orderBy("doc_id").collect():
        assert row.start == held
        held += row.n_tokens
    assert held > 0


def test_empty_table(documents):
    empty = documents((1, "x")).where("false")
    assert token_counts(empty, PATH).count() == 0
    assert token_output.token_output(empty, PATH, 2).count() == 0


def test_queries(spark, sf_dir, library):
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counted = {row.doc_id: (row.n_bytes, row.n_tokens) for row in queries.QUERIES["op7_token_counts"](spark, sf_dir).collect()}
    written = {row.doc_id: row for row in queries.QUERIES["op1_token_output"](spark, sf_dir).collect()}
    start = 0
    assert set(counted) == set(written) == set(texts)
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids
        assert counted[doc_id] == (len(texts[doc_id].encode()), len(ids))
        row = written[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += row.n_tokens
