import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe
from tessel.llm.catalogue import vocabulary_path

tiktoken = pytest.importorskip("tiktoken")
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.load_ranks(PATH)), special_tokens={})


PIECES = ["'", "'s", "'re", "'ve", "'ll", "'l", "'r", " ", "  ", "\n", "\t", " ", "a", "e", "s", "l", "é", "1", "٣", "!", "$", "😀", "漢", "　", "T", "'S", "\x00", "Ᲊ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=6))
def test_ids_equal_the_library(enc, texts):
    got = bpe.encode_arrow(pa.array(texts, pa.string()), PATH)
    assert got.field("ids").to_pylist() == [enc.encode_ordinary(t) for t in texts]
    assert bpe.decode_arrow(got, PATH).to_pylist() == [t.encode() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text(enc, text):
    assert bpe.encode_arrow(pa.array([text], pa.string()), PATH).field("ids").to_pylist() == [enc.encode_ordinary(text)]


def test_scan_equals_stepping():
    gens, _, apply, _ = bpe._automaton()
    classes = np.random.default_rng(1).integers(0, 11, 5000)
    scanned = apply[bpe._scan(gens[classes]).astype(np.uint16) * 16 + bpe.FRESH]
    state, stepped = bpe.FRESH, []
    for c in classes:
        state = bpe._step(state, int(c))[0]
        stepped.append(state)
    assert scanned.tolist() == stepped


def test_long_runs(enc):
    texts = ["a" * 4000, "'" * 3000, " " * 3000 + "x", "ab" * 2000, "漢" * 1000, "x" * 300]
    assert bpe.encode_arrow(pa.array(texts), PATH).field("ids").to_pylist() == [enc.encode_ordinary(t) for t in texts]


def test_offsets_disagreeing_raise():
    got = bpe.encode_arrow(pa.array(["hello world"]), PATH)
    wrong = pa.StructArray.from_arrays([got.field("ids"), pa.array([[1, 2]], pa.list_(pa.int32())), got.field("slice_ids")], ["ids", "slice_bytes", "slice_ids"])
    with pytest.raises(ValueError):
        bpe.decode_arrow(wrong, PATH)


def test_digests_of_nulls_repeats_and_clashing_columns(spark, enc):
    rows = [(1, "it's  fine\n"), (None, None), (2, ""), (1, "it's  fine\n"), (3, "long " * 30000)]
    table = docs(spark, rows).selectExpr("*", "1 as ids", "2 as encoded", "3 as `a.b`")
    got = bpe.digests(bpe.encode_documents(table, PATH), PATH).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "it's  fine\n", None: "", 2: "", 3: "long " * 30000}[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(bpe.encode_documents(docs(spark, []), PATH), PATH).count() == 0
    once = bpe.document_digests(table, PATH)
    assert sorted(map(str, once.collect())) == sorted(map(str, got)) and once.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.document_digests(docs(spark, []), PATH).count() == 0


def test_invalid_utf8_is_replaced(spark, enc):
    table = spark.sql("select 1L doc_id, cast(X'8061FF62C3' as string) text")
    got = bpe.digests(bpe.encode_documents(table, PATH), PATH).first()
    text = "�a�b�"
    assert got["n_tokens"] == len(enc.encode_ordinary(text)) and got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
