import numpy as np
import pytest
from helpers import auc, docs, words
from pyspark.sql import functions as F


from tessel.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    """Clean texts, and texts with insults or with words of an unlisted stem."""
    rows, marks = [], []
    for i in range(320):
        w = words(i, 60)
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                w[7 * k + i % 5] = ("idiot", "Mor0n", f"zorgle{i % 7}")[(i // 4 + k) % 3 if i % 8 else 2]
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks, LABELS)


@pytest.fixture(scope="module")
def trained(spark):
    table, labels = corpus(spark)
    return table, labels, toxicity.train(table, labels)


def test_held_out_rows_are_told_apart(spark, trained):
    table, labels, model = trained
    got = toxicity.predict(table, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 40
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.97
    assert (got["predicted"] == got["toxic"]).mean() > 0.93
    assert got["score"].between(0, 1).all()


def test_held_out_labels_do_not_matter(spark, trained):
    table, labels, model = trained
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(table.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), turned)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.predict(table, m).collect()} for m in (model, other))
    assert a == b


def test_the_stem_is_learned(trained):
    assert any(s.startswith("zorg") for s in trained[2].lexicon)


def test_edges(spark, trained):
    model = trained[2]
    table = docs(spark, [(1, None), (1, ""), (None, "you idiot!!!"), (2, "fine " * 20000), (3, "you idiot!!!")]).withColumn("score", F.lit("x"))
    got = toxicity.predict(table, model).collect()
    assert len(got) == 5
    by = {(r["doc_id"], i): r for i, r in enumerate(got)}
    assert by[(1, 0)]["score"] == by[(1, 1)]["score"] and by[(None, 2)]["score"] == by[(3, 4)]["score"]
    assert by[(3, 4)]["score"] > by[(2, 3)]["score"] and by[(None, 2)]["held_out"] is False
    assert toxicity.predict(docs(spark, []), model).count() == 0


def test_nothing_to_learn(spark):
    table = docs(spark, [(i, "a b") for i in range(8)])
    empty = toxicity.train(table, spark.createDataFrame([], LABELS))
    one = toxicity.train(table, spark.createDataFrame([(i, 1, 1) for i in range(8)] + [(None, 1, 0), (1, 1, 7)], LABELS))
    assert empty.constant == 0.0 and one.constant == 1.0
    assert {r["score"] for r in toxicity.predict(table, one).collect()} == {1.0}


def test_words():
    assert toxicity.plain_word("(Idi0t!)") == ("idiot", True, False)
    assert toxicity.plain_word("s-t-u-p-i-d") == ("stupid", True, False)
    assert toxicity.plain_word("stuuupid,") == ("stupid", False, True)
    assert toxicity.plain_word("...")[0] == ""


def test_isotonic_is_the_least_squares_monotone_fit():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 12, 60).astype(float), r.integers(0, 2, 60).astype(float)
    knots, values = toxicity.isotonic(x, y)
    fit = np.interp(x, knots, values)
    assert (np.diff(values) >= -1e-12).all()
    want = np.array([min(max(y[(x >= a) & (x <= b)].mean() for a in np.unique(x) if a <= v) for b in np.unique(x) if b >= v) for v in x])
    assert np.allclose(fit, want)


def test_trees_learn_an_interaction():
    r = np.random.default_rng(4)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    fit = toxicity.Trees().fit(x[:600], y[:600])
    assert auc(fit.raw(x[600:]), y[600:]) > 0.95


def test_a_rare_class_is_sampled_whole(spark, monkeypatch):
    """Labels far beyond the sample's bound, of which a few in a thousand are toxic."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 400)
    rows, marks = [], []
    for i in range(8000):
        w, toxic = words(i, 12, 20), i % 150 == 0
        if toxic:
            w[i % 5], w[5 + i % 7] = "zorgle", "zorgle"
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    table, labels = docs(spark, rows), spark.createDataFrame(marks, LABELS)
    model = toxicity.train(table, labels)
    assert model.constant is None
    got = toxicity.predict(table, model).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).all()
    kept, share = toxicity.training_rows(table, labels, "doc_id", "text")
    sampled = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    true = got[[not h for h in got["held_out"]]]["toxic"]
    assert sampled[1] == true.sum() and 250 < sampled[0] < 450 and share[1] == 1.0
    assert abs(sampled[0] / share[0] - (true == 0).sum()) < 0.25 * len(true)
    assert abs(got["score"].mean() - got["toxic"].mean()) < 0.01


def plain_features(text, lexicon):
    """The 18 features of one text by loops."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    strength, fixed, second, capital, hidden, stretched = [], [], [], 0, 0, 0
    for w in words:
        core, obscured, long = toxicity.plain_word(w)
        options = [core] + [core[:k] + "*" for k in (4, 5, 6) if len(core) > k] if core else []
        strength.append(min(255, int(max([lexicon.get(o, 0.0) for o in options], default=0.0) * 30)) / 30)
        fixed.append(core in toxicity.INSULTS)
        second.append(core in toxicity.SECOND)
        letters = [c for c in w if c.isalpha()]
        capital += len(letters) > 1 and all(c.isupper() for c in letters)
        hidden, stretched = hidden + obscured, stretched + long
    hits = [i for i in range(len(words)) if strength[i] > 0 or fixed[i]]
    near = sum(max([1 / (1 + abs(i - j)) for j in range(len(words)) if second[j]], default=0.0) for i in hits)
    raw = text.encode()
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    size = max(len(raw), 1)
    other = sum(b in b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~" for b in raw)
    return [len(hits) / n, np.log1p(len(hits)), sum(strength) / n, sum(strength), max(strength, default=0.0), sum(s > 3 for s in strength),
            sum(fixed) / n, np.log1p(sum(fixed)), sum(second) / n, near / max(len(hits), 1), capital / n, upper / max(upper + lower, 1),
            raw.count(b"!") / size, raw.count(b"?") / size, other / size, hidden / n, stretched / n, np.log1p(len(words))]


def test_features_equal_plain_loops():
    import random

    r = random.Random(3)
    pool = ["you", "YOU", "are", "an", "idiot!", "id10t", "i.d.i.o.t", "stuuupid", "scum?", "Moron,", "fine", "day", "WOW", "a1", "1234", "...", "été", "您好", "x" * 70, "bastard*s", "tu", " ", "trash"]
    texts = [None, "", " ", "!?", *(" ".join(r.choices(pool, k=r.randrange(1, 60))) for _ in range(200))]
    lexicon = {"fine": 1.2, "scum": 7.9, "mor*": 0.4, "moro*": 2.5, "day": 0.01}
    import pyarrow as pa

    got = toxicity.features_of(pa.array(texts, pa.string()), toxicity._Known(lexicon))
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts], atol=1e-5)
