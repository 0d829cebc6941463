import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """The codes by plain loops over all entries."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, v):
        return min((sum((x - y) ** 2 for x, y in zip(e, v)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[nearest(books[p], c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(o) for x in zip(*o)] if o else e for e, o in zip(books[p], own)]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest(books[p], c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, err, sum(e for _, l2, _, e in out if l2 == lab), sha) for i, lab, code, err in out]


def key(r):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in r)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(0, 10**6), st.sampled_from([1, 3, 50, 5000, 1 << 25]))
def test_nearest_entry_is_exact(m, width, seed, spread):
    r = np.random.default_rng(seed)
    entries = r.integers(-spread, spread + 1, (m, width))
    queries = np.concatenate([r.integers(-spread, spread + 1, (200, width)), entries])
    index, error = orchard.Orchard(entries).nearest(queries)
    apart = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert index.tolist() == [min(range(m), key=lambda k: (row[k], k)) for row in apart]
    assert error.tolist() == [min(row) for row in apart]


def test_search_compares_few_entries_of_clustered_books():
    r = np.random.default_rng(1)
    entries = r.integers(0, 10**6, (256, 2))
    book = orchard.Orchard(entries)
    compared = []
    plain = book._apart
    book._apart = lambda q, e: compared.append(len(e)) or plain(q, e)
    book.nearest(r.integers(0, 10**6, (1000, 2)))
    assert sum(compared) < 0.35 * 256 * 1000


def test_components_too_large_raise():
    with pytest.raises(ValueError):
        orchard.Orchard(np.full((2, 200), 1 << 27))


@pytest.mark.parametrize("n", [3, 90])
def test_codes_against_plain_loops(spark, n):
    r = np.random.default_rng(n)
    rows = [(int(i), r.choice([-0.5, 0.0, 0.25, 0.3, 1.0], 8).tolist(), int(i) % 3) for i in r.permutation(n)]
    rows += [(-1, None, 1), (-2, [math.nan] * 8, 1), (-3, [math.inf] * 8, 1), (-4, [None] * 8, 1), (-5, [], 1)]
    rows += [(None, [0.1] * 8, None), (7000, [0.2] * 8, None), rows[0], rows[0], (int(rows[0][0]), [-3.0] * 8, 2), (9000, [0.5] * 4, 2)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as raw", "3 as `a.b`").repartition(3)
    got = orchard.compress(table, entries=20).collect()
    want = brute([x for x in rows if x[1] is None or len(x[1]) != 4], entries=20)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_empty_tables_and_odd_lengths(spark):
    assert orchard.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert orchard.compress(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        orchard.compress(spark.createDataFrame([(1, [1.0] * 6, 2)], SCHEMA))


def test_decoded_codes_are_the_entries(spark):
    rows = [(i, [i / 7, -i / 3, 0.5, i * 0.01], 0) for i in range(40)]
    ints = orchard.integer_table(spark.createDataFrame(rows, SCHEMA))
    books = orchard.fit(ints, entries=40, rounds=0)
    for r in orchard.encode(ints, books).collect():
        assert np.allclose(orchard.decode(r["code"], books), rows[r["vec_id"]][1], atol=1 / 1024) and r["error"] == 0
