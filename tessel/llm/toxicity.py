"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of a lexicon (a fixed list of insults and a lexicon of words
and word beginnings learned from the labels), nearness of its hits to second-person words,
capitals, punctuation, obfuscation and lengths.  The learned lexicon keeps words and beginnings
far more frequent in toxic than in other training texts, so it follows the corpus's languages.

Training uses a bounded hash sample of the labelled rows that are not held out (SAMPLE_ROWS,
expected number), drawn per class: a class of up to half of the bound is taken whole, and
calibration weighs the rows back to the classes' true shares.  Two folds keep it honest: a training row's lexicon features come from the
other fold's lexicon, and calibration uses trees fitted on the other fold.  Everything else
(scoring) runs over all rows.

Defined cases: null and empty texts have zero features and get the model's score for them;
without labels, or with fewer than two rows of a class in a fold, every score is the training
share of label 1 (0 with no labels); repeated rows get equal scores; labels other than 0 and 1 are ignored; a doc_id
labelled more than once takes its largest label; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, prepare, runs, utf8

SAMPLE_ROWS = 12_000
#: An entry of the lexicon occurs in so large a share of the sample's toxic texts, and in three of
#: them at least.  A text has so many stems on average, hence at most 100 times as many entries.
SUPPORT = 0.01
STEMS = (4, 5, 6)

# Insults.
INSULTS = frozenset("""idiot idiots idiotic stupid moron moronic loser losers scum trash garbage pathetic worthless disgusting clown dumb
dumbass fool imbecile jerk creep pig bastard bitch asshole retard vermin filth parasite coward hate kill
imbécile connard connasse salope crétin abruti débile ordure merde
dummkopf arschloch trottel blödmann abschaum hurensohn schwein miststück
estúpido estúpida imbécil cabrón pendejo basura asqueroso gilipollas puta mierda""".split())
# Second-person words.
SECOND = frozenset("""you your yours yourself yourselves u ur ya thou thee thy tu te toi ton ta tes vous votre vos
du dich dir dein deine deinen deiner ihr euch euer eure tú ti usted ustedes vosotros tus""".split())
# Look-alikes of letters.
PLAIN = str.maketrans("013457@$€!|", "oieastaseil")

FEATURES = 18
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_LONG = re.compile(r"(.)\1{2,}")
HELD_OUT_FOLD = 2


def plain_word(word: str) -> tuple[str, bool, bool]:
    """Lower-cased letters behind a word; whether it was obfuscated; whether it was stretched."""
    core = _EDGE.sub("", word).lower()
    hidden = False
    if core and not core.isalpha() and any(c.isalpha() for c in core):
        bare = _INNER.sub("", core.translate(PLAIN))
        hidden = bool(re.search(r"[^\W\d_][\W\d_]+[^\W\d_]", core))
        core = bare
    short = _LONG.sub(r"\1", core)
    return short, hidden, short != core


def stems(word: str) -> list[str]:
    """The word and its beginnings (marked with '*')."""
    return [word] + [word[:k] + "*" for k in STEMS if len(word) > k]


class _Known(dict):
    """Word -> packed flags and lexicon strength; emptied when full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 80_000:
            self.clear()
        core, hidden, stretched = plain_word(word)
        strength = max((self.lexicon.get(s, 0.0) for s in stems(core)), default=0.0) if core else 0.0
        letters = [c for c in word if c.isalpha()]
        code = (min(255, int(strength * 30)) | (core in SECOND) << 8 | (len(letters) > 1 and all(c.isupper() for c in letters)) << 9
                | hidden << 10 | stretched << 11 | (core in INSULTS) << 12)
        if len(word) <= 64:
            self[word] = code
        return code


def features(data: np.ndarray, offsets: np.ndarray, known: _Known) -> np.ndarray:
    """One row of ``FEATURES`` per text; texts lie end to end in ``data``."""
    n = len(offsets) - 1
    raw = data.tobytes()
    cut = offsets.tolist()
    words, count = [], np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        w = raw[a:b].decode("utf-8", "replace").split()
        count[i] = len(w)
        words += w
    code = np.fromiter([known[w] for w in words], np.int64, len(words))
    owner = np.repeat(np.arange(n), count)
    per = lambda x: np.bincount(owner, x, n)
    strength = (code & 255) / 30.0
    fixed, second = (code >> 12 & 1).astype(bool), np.flatnonzero(code >> 8 & 1)
    hit = np.flatnonzero((strength > 0) | fixed)
    near = np.zeros(len(hit))
    if len(second) and len(hit):
        i = np.searchsorted(second, hit)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(second) - 1)):
            same = owner[second[j]] == owner[hit]
            near = np.maximum(near, same / (1.0 + np.abs(second[j] - hit)))
    strongest = np.zeros(n)
    np.maximum.at(strongest, owner, strength)
    hits = np.bincount(owner[hit], minlength=n)
    w1 = np.maximum(count, 1)
    kinds = np.zeros(256, np.int64)  # 1 capital, 2 small, 3 digit, 4 '!', 5 '?', 6 other punctuation
    kinds[ord("A"):ord("Z") + 1], kinds[ord("a"):ord("z") + 1], kinds[ord("0"):ord("9") + 1] = 1, 2, 3
    for c in "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~":
        kinds[ord(c)] = 6
    kinds[ord("!")], kinds[ord("?")] = 4, 5
    who = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.bincount(who * 8 + kinds[data], minlength=n * 8).reshape(n, 8)
    size = np.maximum(np.diff(offsets), 1)
    x = np.stack([
        hits / w1, np.log1p(hits), per(strength) / w1, per(strength), strongest, per((strength > 3).astype(float)),
        per(fixed.astype(float)) / w1, np.log1p(per(fixed.astype(float))),
        np.bincount(owner[second], minlength=n) / w1, np.bincount(owner[hit], near, n) / np.maximum(hits, 1),
        per((code >> 9 & 1).astype(float)) / w1, chars[:, 1] / np.maximum(chars[:, 1] + chars[:, 2], 1),
        chars[:, 4] / size, chars[:, 5] / size, chars[:, 6] / size, per((code >> 10 & 1).astype(float)) / w1,
        per((code >> 11 & 1).astype(float)) / w1, np.log1p(count),
    ], axis=1)
    return x.astype(np.float32)


def features_of(texts: pa.Array, known: _Known) -> np.ndarray:
    claim("toxicity", int)  # its caches end with the task
    data, offsets = utf8(texts)
    parts = [features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], known) for a, b in runs(offsets, 500_000)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


class Trees:
    """Gradient-boosted complete trees of depth 3 for the logistic loss, on binned features."""

    def __init__(self, depth: int = 3, count: int = 60, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 1.0):
        self.depth, self.count, self.rate, self.bins, self.ridge, self.least = depth, count, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])) for v in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1)
        inner = 2 ** self.depth - 1
        self.feature, self.cut, self.leaf = (np.zeros((self.count, inner), np.int64), np.full((self.count, inner), np.inf), np.zeros((self.count, inner + 1)))
        score = np.full(len(y), self.base)
        for t in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                nodes = 2 ** level
                self._split(t, level, nodes, at, binned, g, h)
                node = nodes - 1 + at
                at = 2 * at + (x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            a, b = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[t] = self.rate * a / (b + self.ridge)
            score += self.leaf[t, at]
        return self

    def _split(self, t, level, nodes, at, binned, g, h):
        best = np.full(nodes, 1e-9)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            width = len(cuts) + 1
            key = at * width + binned[:, f]
            a = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
            b = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
            ga, gb, ha, hb = a[:, :-1], a[:, -1:] - a[:, :-1], b[:, :-1], b[:, -1:] - b[:, :-1]
            gain = ga ** 2 / (ha + self.ridge) + gb ** 2 / (hb + self.ridge) - a[:, -1:] ** 2 / (b[:, -1:] + self.ridge)
            gain[(ha < self.least) | (hb < self.least)] = 0
            c = gain.argmax(1)
            top = gain[np.arange(nodes), c]
            for k in np.flatnonzero(top > best):
                best[k] = top[k]
                self.feature[t, nodes - 1 + k], self.cut[t, nodes - 1 + k] = f, cuts[c[k]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.count):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 ** level - 1 + at
                at = 2 * at + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, at]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing (weighted) least-squares fit (pool adjacent violators); ties pooled."""
    weights = np.ones(len(y)) if weights is None else weights
    value, place = np.unique(raw, return_inverse=True)
    weight = np.bincount(place, weights)
    mean = np.bincount(place, y * weights) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for v, m, w in zip(value, mean, weight):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    """Lexicon, trees and calibration; ``constant`` where there was nothing to learn."""

    def __init__(self, constant: float | None, lexicon=None, trees=None, knots=None):
        self.constant, self.lexicon, self.trees, self.knots = constant, lexicon, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        smooth = 1 / (1 + np.exp(-raw))  # a thousandth of it orders rows of one calibrated step
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * smooth


def _doc_stems(text: str | None) -> set[str]:
    return {s for w in set((text or "").split()) if len(core := plain_word(w)[0]) > 2 for s in stems(core)}


def _stem_counts(kept: frozenset | None):
    def count(batches):
        sums: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))] + [pa.array(list(sums.values()), pa.int64())], ["stem", "fold", "toxic", "n"])
        for batch in batches:
            for fold, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = _doc_stems(text)
                sums.update((s, fold, y) for s in (found if kept is None else found & kept))
                if len(sums) > 200_000:
                    yield flush()
                    sums.clear()
        yield flush()

    return count


def _lexicon(counts, toxic_rows: int, other_rows: int) -> dict[str, float]:
    """Strength (log-odds, at most 8) of the entries far more frequent in toxic texts."""
    least = max(3.0, SUPPORT * toxic_rows)
    scored = []
    for stem, n1, n0 in counts:
        if n1 >= least:
            odds = np.log((n1 + 0.5) / (toxic_rows + 1)) - np.log((n0 + 0.5) / (other_rows + 1))
            if odds >= np.log(8):
                scored.append((n1 * odds, stem, float(min(odds, 8.0))))
    return {s: o for _, s, o in sorted(scored, key=lambda z: (-z[0], z[1]))}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """``label_id, fold, toxic, text``: a hash sample, drawn per class, of the labelled rows that are
    not held out; and the share of each class that was drawn."""
    own = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(held_out(F.col("doc_id")) == F.lit(False))
           .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("long").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = SAMPLE_ROWS // 2
    share = {y: min(1.0, max(half, SAMPLE_ROWS - n.get(1 - y, 0)) / max(n.get(y, 0), 1)) for y in (0, 1)}
    place = F.pmod(F.xxhash64(F.col("label_id")), F.lit(1 << 40))
    sample = own.where(place < F.when(F.col("toxic") == 1, int(share[1] * (1 << 40))).otherwise(int(share[0] * (1 << 40))))  # bounded: broadcast
    text = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.pmod(F.xxhash64(F.col("label_id"), F.lit(1)), F.lit(2)).cast("long")
    rows = text.join(F.broadcast(sample), "label_id").select("label_id", fold.alias("fold"), "toxic", "text").dropDuplicates()
    return materialize(rows, "toxic-sample"), share


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT_FOLD


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit lexicon, trees and calibration (see the module's notes for the bound)."""
    prepare(docs.sparkSession)
    rows, share = training_rows(docs, labels, id_col, text_col)
    size = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = (sum(v for (_, y), v in size.items() if y == k) / share[k] for k in (1, 0))
    # A rare class is sampled whole, so this tells of all labels.
    if min((size.get((f, y), 0) for f in (0, 1) for y in (0, 1))) < 2:
        return Model(n1 / (n1 + n0) if n1 + n0 else 0.0)
    schema = "stem string, fold long, toxic long, n long"
    least = max(3.0, SUPPORT * min(size[f, 1] for f in (0, 1)))  # what any lexicon asks for
    top = (rows.where("toxic = 1").select("fold", "toxic", "text").mapInArrow(_stem_counts(None), schema)
           .groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("stem"))
    kept = frozenset(r["stem"] for r in top.collect())
    counted = rows.select("fold", "toxic", "text").mapInArrow(_stem_counts(kept), schema).groupBy("stem", "fold", "toxic").agg(F.sum("n").alias("n")).toPandas()
    count = {(s, f, y): n for s, f, y, n in counted.itertuples(index=False)}  # four counts of each entry

    def lexicon(folds):
        return _lexicon(((s, *(sum(count.get((s, f, y), 0) for f in folds) for y in (1, 0))) for s in sorted(kept)),
                        *(sum(size.get((f, y), 0) for f in folds) for y in (1, 0)))

    other = {f: lexicon((1 - f,)) for f in (0, 1)}

    def featured(batches):
        known = {f: _Known(lex) for f, lex in other.items()}
        for batch in batches:
            fold = np.array(batch.column(1).to_pylist(), np.int64)
            x = np.zeros((batch.num_rows, FEATURES), np.float32)
            for f in (0, 1):
                pick = np.flatnonzero(fold == f)
                if len(pick):
                    x[pick] = features_of(batch.column(3).take(pa.array(pick)), known[f])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["label_id", "fold", "toxic", "x"])

    got = rows.mapInArrow(featured, "label_id long, fold long, toxic long, x array<float>").toPandas()  # the bounded sample
    x = np.array(got["x"].tolist(), np.float32)
    order = np.lexsort([*x.T, got["label_id"]])
    x, y, fold = x[order], got["toxic"].to_numpy(float)[order], got["fold"].to_numpy()[order]
    raw = np.zeros(len(y))
    for f in (0, 1):
        raw[fold == f] = Trees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(None, lexicon((0, 1)), Trees().fit(x, y), isotonic(raw, y, np.where(y == 1, 1 / share[1], 1 / share[0])))


def score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1."""
    if model.constant is not None:
        return F.lit(float(model.constant))

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features_of(texts, _known(model))), pa.float64())

    return toxicity_score(text.cast("string"))


def _known(model: Model) -> _Known:
    """The worker's word cache of a model."""
    if not hasattr(model, "known"):
        model.known = _Known(model.lexicon)
    return model.known


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    prepare(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
