import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import rans
from tessel.llm.catalogue import vocabulary_path
from tessel.llm.common import clean_utf8, utf8
from tessel.llm.slices import SliceEncoder

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoders():
    return SliceEncoder(PATH), SliceEncoder(PATH, True)


def coded(encoder, texts):
    for _ in range(2):  # the second time every cut is known
        ids, ends = encoder.encode(*utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


PIECES = [" ", "  ", "\n", "\t", "\r", "　", " ", " ", "\x1c", "\x0b", "\x85", "a", "word", "'s", "'", "!", "!!", "|", "<|endoftext|>", "<|", "é", "漢字", "12", "…", "”", "😀", "x" * 60]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_cut_ids_equal_the_library(library, plain, encoders, texts):
    assert coded(encoders[0], texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coded(encoders[1], texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_do_not_decide(library, encoders):
    encoder = encoders[0]
    encoder.clear()
    data, offsets = utf8(pa.array(["one two"]))
    encoder.encode(data, offsets)
    encoder.blob[:encoder.n_blob] = ord("z")  # as if other cuts had these hashes
    ids, _ = encoder.encode(data, offsets)
    assert ids.tolist() == library.encode("one two", add_special_tokens=False).ids
    encoder.clear()


def test_full_store_starts_anew(library, encoders, monkeypatch):
    monkeypatch.setattr("tessel.llm.slices.MOST", 3)
    encoder = encoders[0]
    for text in ("a b c d e f", "g h i j", "a b c"):
        ids, _ = encoder.encode(*utf8(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=300).filter(any))
def test_quantised_frequencies(counts):
    freq = rans.quantise(np.array(counts))
    assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (np.array(counts) > 0)).all()


def test_rare_ids_beside_a_common_one():
    freq = rans.quantise(np.append(10**15, np.ones(50_000, np.int64)))
    assert freq.sum() == 1 << rans.BITS and freq.min() == 1


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 8191, 8192, 8193, 16383, 16384, 16385, 50000])
@pytest.mark.parametrize("symbols", [1, 5, 50000])
def test_round_trip(n, symbols):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, symbols - 1)
    table = rans.Table(rans.quantise(np.bincount(np.append(ids, 0))))
    payload = rans.encode_segment(ids, table)
    assert np.array_equal(rans.decode_segment(payload, table), ids)


def test_near_the_entropy():
    ids = np.minimum(np.random.default_rng(3).zipf(1.3, 200_000) - 1, 50_000)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    best = -(share * np.log2(share)).sum() * len(ids) / 8
    assert len(rans.encode_segment(ids, rans.Table(rans.quantise(counts)))) < 1.1 * best


def test_a_stretch_decodes_alone():
    ids = np.random.default_rng(4).integers(0, 700, 40_000)
    table = rans.Table(rans.quantise(np.bincount(ids)))
    payload = rans.encode_segment(ids, table)
    import struct

    head = struct.calcsize(rans._HEAD)
    place = np.frombuffer(payload, np.dtype([("word", "<u4"), ("crc", "<u4"), ("state", "<u8", (rans.LANES,))]), 5, head)
    words = np.frombuffer(payload, "<u4", -1, head + place.nbytes)
    for i in range(5):
        size = np.array([min(rans.CHECKPOINT, 40_000 - i * rans.CHECKPOINT)])
        got = rans.decode_stretches(place["state"][i:i + 1], place["word"][i:i + 1], words, size, rans.CHECKPOINT, table)
        assert np.array_equal(got, ids[i * rans.CHECKPOINT:(i + 1) * rans.CHECKPOINT])


def test_damage_is_noticed():
    ids = np.random.default_rng(5).integers(0, 300, 20_000)
    table = rans.Table(rans.quantise(np.bincount(ids)))
    payload = rans.encode_segment(ids, table)
    for at in range(0, len(payload), 199):
        broken = bytearray(payload)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            rans.decode_segment(bytes(broken), table)
    for cut in (0, 10, 100, len(payload) - 1):
        with pytest.raises(ValueError):
            rans.decode_segment(payload[:cut], table)
    with pytest.raises(ValueError):
        rans.decode_segment(payload, rans.Table(rans.quantise(np.bincount(ids) + 1)))


def test_files_against_plain_loops(spark, library):
    rows = [(7, "it's  fine\n"), (None, None), (2, ""), (7, "it's  fine\n"), (7, "else"), (3, "long " * 30000), (None, "x"), (-4, "<|endoftext|> a")]
    rows += [(i, f"number {i} of many") for i in range(100, 140)]
    table = docs(spark, rows).selectExpr("*", "1 as ids", "2 as n_tokens", "3 as `a.b`").repartition(5)
    path = rans.encode_documents(table, PATH, segment_ids=50)
    got = sorted(rans.read(spark, path).collect(), key=lambda r: r["start"])
    want = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == sorted(
        (i is not None, i or 0, np.array(w, "<u4").tobytes()) for (i, _), w in zip(rows, want))
    at = 0
    for r in got:
        assert r["start"] == at and 4 * r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark):
    path = rans.encode_documents(docs(spark, []), PATH)
    assert rans.read(spark, path).count() == 0


def test_invalid_utf8_is_replaced(spark, library):
    table = spark.sql("select 1L doc_id, cast(X'61FF8062' as string) text")
    got = rans.read(spark, rans.encode_documents(table, PATH)).first()
    assert got["n_tokens"] == len(library.encode("a��b", add_special_tokens=False).ids) + 1
    assert clean_utf8(pa.array(["é", None, ""])).to_pylist() == ["é", None, ""]


def test_more_new_cuts_than_can_be_kept(library, encoders, monkeypatch):
    monkeypatch.setattr("tessel.llm.slices._BITS", 6)
    monkeypatch.setattr("tessel.llm.slices._SLOTS", 64)
    encoder = encoders[0]
    encoder.clear()
    text = " ".join(f"w{i}x" for i in range(500))
    for _ in range(3):
        ids, _ = encoder.encode(*utf8(pa.array([text, "and more"])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + library.encode("and more", add_special_tokens=False).ids
        assert encoder.n <= 32
    monkeypatch.undo()
    encoder.clear()
