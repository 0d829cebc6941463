import random

import numpy as np

import corpus_pipeline
from helpers import docs, edited, words
from pyspark.sql import functions as F

from tessel.llm import minhash
from tessel.llm.components import components


def brute(rows, percent=85):
    """Components from every pair's true word shingles."""
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()
        sets.setdefault(i, set()).add(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    comp = {i: i for i in sets}
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return comp


def crowd():
    """Near copies of two texts with 0 to 4 edits, exact copies, shared passages and edge rows."""
    rows, base, other = [], words(1, 150), words(2, 130)
    for i in range(60):
        rows.append((i + 100, " ".join(edited(i, base if i % 3 else other, i % 5))))
    rows += [(i + 300, " ".join(base)) for i in range(12)]
    rows += [(i + 400, " ".join(words(i + 50, 40) + base[:60])) for i in range(10)]
    rows += [(500, ""), (501, None), (502, " \t"), (503, "A b c"), (504, "a B\nc"), (505, "a b"), (506, "a b c d e"), (507, "A  b c d\x0be")]
    rows += [(508, " ".join(words(9, 6000, 10**6))), (509, " ".join(words(9, 6000, 10**6)) + " end")]
    return rows


def test_components_equal_brute_force(spark):
    rows = crowd()
    got = minhash.near_duplicates(docs(spark, rows).withColumn("bands", F.lit(1))).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    n = {r["doc_id"]: r["n_shingles"] for r in got}
    assert (n[500], n[501], n[502], n[503], n[505], n[506]) == (0, 0, 0, 1, 1, 1)


def test_repeated_ids_null_ids_and_empty_table(spark):
    a, b, c = (" ".join(words(s, 30)) for s in (1, 2, 3))
    table = docs(spark, [(5, a), (5, a), (5, b), (9, b), (None, a), (None, a), (7, c), (8, None), (8, None)])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 3 + [(9, 5, False)] + [(None, None, True)] * 2 + [(7, 7, True)] + [(8, 8, True)] * 2, key=str)
    left = minhash.deduplicate(table)
    assert left.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(5, min(a, b)), (7, c), (8, None), (None, a), (None, a)], key=str)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_sketch_agreement_estimates_similarity():
    r = np.random.default_rng(5)
    for size, share in ((40, 0.5), (300, 0.8), (3, 1 / 3)):
        common = r.integers(0, 2**63, int(2 * size * share / (1 + share)), dtype=np.uint64)
        hits = []
        for _ in range(30):
            x, y = (np.concatenate([common, r.integers(0, 2**63, size - len(common), dtype=np.uint64)]) for _ in range(2))
            s = minhash.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert (s != np.iinfo(np.uint64).max).all()  # every coordinate fills
            hits.append((s[0] == s[1]).mean())
            common = r.integers(0, 2**63, len(common), dtype=np.uint64)
        want = len(common) / (2 * size - len(common))
        assert abs(np.mean(hits) - want) < 0.05


def test_prefix_filter_finds_every_linked_pair(spark):
    rows = [(i, w) for i, w in crowd() if w and i < 500]
    sets = {i: minhash.shingle_set(t.encode()).view(np.int64).tolist() for i, t in rows}
    table = spark.createDataFrame([(i, i, len(s), s) for i, s in sets.items()], "node long, component long, size long, tokens array<long>")
    got = {tuple(sorted((r["a"], r["b"]))) for r in minhash.verified(minhash.prefix_pairs(table), table.drop("component")).collect()}
    full = {i: set(s) for i, s in sets.items()}
    assert got == {(a, b) for a in full for b in full if a < b and 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b])}


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    chain = list(range(0, 200))
    r.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 200)}, **{1000 + k: 1000 for k in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_links_from_080(spark):
    """The pipeline's stage takes 0.80, op4 0.85: a pair between them, and the crowd."""
    a = words(3, 100)
    rows = crowd() + [(600, " ".join(a)), (601, " ".join([*a, *words(4, 20)]))]  # 96 of 116 shingles
    table = docs(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table, percent=80).collect()}
    assert got == brute(rows, 80) and got[601] == 600 and brute(rows)[601] == 601
    left = corpus_pipeline.minhash_dedup(spark, table, "").collect()
    assert {r["doc_id"] for r in left} == {i for i, c in got.items() if i == c}


def test_a_linked_crowd_beside_a_stray_meets_in_linear_rows(spark):
    """One component of m near copies and one document outside it that shares their tokens."""
    met = {}
    for m in (100, 200, 400):
        rows = [(i, 0, 204, t, 1 + t) for i in range(m) for t in range(30)] + [(9999, 9999, 204, t, 1 + t) for t in range(30)]
        held = spark.createDataFrame(rows, "node long, component long, size long, token long, at long")
        met[m] = minhash.token_meetings(held).count()
        assert met[m] == 30 * (m + 1)  # the stray meets each row of a token (and itself) once
