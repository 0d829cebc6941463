"""Schemas and edge rows shared by the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a table like ``documents``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(seed, n, vocabulary=400):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(seed, text_words, edits):
    import random

    r = random.Random(seed)
    out = list(text_words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return sum((p > neg).mean() + 0.5 * (p == neg).mean() for p in pos) / len(pos)
