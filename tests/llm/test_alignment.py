import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import alignment
from tessel.llm.catalogue import vocabulary_path
from tessel.llm.common import utf8

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: x for c, x in alignment.encoder(A).library.get_vocab().items()}
    from tessel.llm.slices import byte_alphabet

    known = byte_alphabet()
    bytes_a = {i: t.encode() if t == "<|endoftext|>" else bytes(known[c] for c in t) for t, i in letters.items()}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, bytes_a, bytes_b


def brute(rows, libraries):
    """Spans, groups, links and counts by plain loops."""
    a, b, bytes_a, bytes_b = libraries
    per, count = [], collections.Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(bytes_a[t] for t in ids_a) != want or b"".join(bytes_b[t] for t in ids_b) != want:
            ids_a = ids_b = []
        spans = []
        for ids, size in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, out = 0, []
            for t in ids:
                out.append((at, at + len(size[t]), t))
                at = out[-1][1]
            spans.append(out)
        links = [(ta, tb) for x, y, ta in spans[0] for u, v, tb in spans[1] if max(x, u) < min(y, v)]
        cut = sorted({y for _, y, _ in spans[0]} & {y for _, y, _ in spans[1]})
        groups, lo = [], 0
        for hi in cut:
            groups.append("|".join(",".join(str(t) for x, y, t in s if lo <= x and y <= hi) for s in spans))
            lo = hi
        count.update(set(links))
        per.append((i, len(ids_a), len(ids_b), len(cut), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, na, nb, ng, len(li), sum(count[p] == top[p[0]] for p in li), sum(count[p] for p in li), sha) for i, na, nb, ng, li, sha in per], count


PIECES = [" ", "  ", "\n", "\t", "　", "▁", "a", "word", "'s", "!", "<|endoftext|>", "<s>", "é", "漢字", "12", "😀", "x" * 60, "\x00", "the"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=20).map("".join), min_size=1, max_size=5))
def test_piece_cuts_equal_the_library(libraries, texts):
    code = alignment._pieces(B)
    ids, ends = code.encode(*utf8(pa.array([" " + t for t in texts])))
    whole = [libraries[1].encode(t) for t in texts]
    plain = ["▁" not in t for t in texts]  # others have no tokens anyway
    got = [ids[x:y].tolist() for x, y in zip(ends, ends[1:])]
    assert [g for g, p in zip(got, plain) if p] == [w for w, p in zip(whole, plain) if p]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 300)), min_size=1, max_size=400), st.integers(1, 40))
def test_postings_round_trip(links, dense):
    keys = np.array([(p << 16) | d for p, d in links], np.uint64)
    alignment.DENSE, kept = dense, alignment.DENSE
    try:
        pair, n, total, planes, raw = alignment.postings(keys)
        row, low, times = alignment.read_postings(n, planes, raw)
    finally:
        alignment.DENSE = kept
    got = {(int(pair[r]), int(d)): int(t) for r, d, t in zip(row, low, times)}
    assert got == collections.Counter(links)
    assert total.tolist() == [sum(p == q for p, _ in links) for q in pair.tolist()]


def test_documents_against_plain_loops(spark, libraries):
    rows = [(1, "it's  fine\n"), (None, None), (2, ""), (1, "it's  fine\n"), (3, "▁odd"), (None, "x"), (4, " "), (5, "a <|endoftext|> <s> b"), (6, "漢字 and 😀 ")]
    rows += [(10 + i, " ".join(words(i, 3 + i % 40, 30))) for i in range(60)] + [(99, "the word " * 3000)]
    table = docs(spark, rows).selectExpr("*", "1 as chunk", "2 as pair", "3 as `a.b`").repartition(3)
    want, count = brute(rows, libraries)
    for links in (alignment.LINKS, 200):
        got = alignment.align_documents(table, A, B, chunk_links=links)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    table = alignment.pair_table(alignment.index(table, A, B)).collect()
    assert {(r["a_id"], r["b_id"]): r["docs"] for r in table} == dict(count)
    assert sum(r["links"] for r in table) == sum(w[4] for w in want)


def test_invalid_utf8_and_empty_tables(spark):
    assert alignment.align_documents(docs(spark, []), A, B).count() == 0
    table = spark.sql("select 1L doc_id, cast(X'61FF62' as string) text union all select 2L, 'ab'")
    got = {r["doc_id"]: r for r in alignment.align_documents(table, A, B).collect()}
    assert got[1]["n_a"] == 0 and got[1]["groups_sha256"] == "" and got[2]["n_links"] > 0
