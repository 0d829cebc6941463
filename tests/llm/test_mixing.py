import math

import pytest
from helpers import docs, words
from pyspark.sql import functions as F

from tessel.llm import mixing


def table(spark):
    rows = []
    for i in range(240):  # one source holds half of the rows
        source = "hot" if i % 2 else ("a", "b", "c")[i % 3] if i % 8 else None
        rows.append((i, " ".join(words(i, 5 + i % 40)), "en", source))
    return docs(spark, rows)


def entropy(w):
    return -sum(x * math.log(x) for x in w if x)


def test_exponent_weights_budget_and_epochs(spark):
    t = table(spark)
    n = {r["source"]: r["n"] for r in t.groupBy("source").agg(F.sum(F.size(F.split("text", " ")) + 1).alias("n")).collect()}
    got = mixing.mix(t, entropy_share=0.97, block_tokens=300)
    rows = got.select("doc_id", "source", "mix.*").collect()
    w = {r["source"]: r["weight"] for r in rows}
    assert abs(sum(w.values()) - 1) < 1e-9
    assert abs(entropy(w.values()) - 0.97 * math.log(len(n))) < 1e-6
    logs = {k: (math.log(n[k]), math.log(w[k])) for k in n}
    slopes = {round((logs[a][1] - logs[b][1]) / (logs[a][0] - logs[b][0]), 6) for a in n for b in n if n[a] != n[b]}
    assert len(slopes) == 1  # one exponent for all
    total = sum(n.values())
    for s in n:
        took = [r for r in rows if r["source"] == s]
        quota = round(total * w[s])
        assert quota <= sum(r["tokens"] for r in took) <= quota + max(r["tokens"] for r in took)
        copies = {}
        for r in took:
            copies.setdefault(r["doc_id"], []).append(r["epoch"])
        whole = quota // n[s]
        assert all(sorted(e)[:whole] == list(range(whole)) and len(e) <= whole + 1 for e in copies.values())
        assert all(0 <= r["position"] < 1 for r in took)


def test_repetition_limit(spark):
    t = docs(spark, [(i, " ".join(words(i, 20)), "en", "small" if i % 10 == 0 else "hot") for i in range(200)])
    free = mixing.mix(t, entropy_share=1.0, most_epochs=100.0)
    held = mixing.mix(t, entropy_share=1.0, most_epochs=1.5)
    most = lambda d: max(r["n"] for r in d.groupBy("doc_id").count().withColumnRenamed("count", "n").collect())
    assert most(free) > most(held) and most(held) <= 2


def test_bisection_against_a_fine_grid(spark):
    stats = spark.createDataFrame([("a", 1000), ("b", 50), ("c", 7)], "src string, n long")

    def h(a):
        p = [n ** a for n in (1000, 50, 7)]
        return entropy([x / sum(p) for x in p])

    goal = 0.9 * math.log(3)
    alpha = mixing.bisect_exponent(stats, lambda e, _: e >= goal, True)
    assert h(alpha) >= goal > h(alpha + 1e-6)


def test_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    one = docs(spark, [(1, None, "en", "s"), (1, None, "en", "s"), (None, "", "en", "s"), (3, "x " * 50000, "en", "s")]).withColumn("mix", F.lit("kept"))
    got = mixing.mix(one)
    assert got.columns == [*one.columns, "mix_"] and got.count() == 4
    assert {r["mix_"]["weight"] for r in got.collect()} == {1.0}


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("text,n", [("a b", 3), ("", 1), (None, 1), (" \t\x0b\n", 1), ("a\xa0b", 2)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.token_count(F.col("t")).alias("n")).first()["n"] == n
