"""Language identification by Bayesian evidence fusion.

posterior(l) ~ host prior(l) * P(text | l) * P(declared markup language | l) * P(address suffix | l)

* Text: hashed letter trigrams, multinomial, trained on a bounded sample of the labelled rows of
  each language, whose set comes from all rows (a language takes CELLS floats); the
  log-likelihood is divided by ``TEMPER`` (neighbouring trigrams are not independent).  An extra
  hypothesis, undetermined, is uniform over the trigram cells.
* Declared language and suffix: P(value | l) from counts of all rows, each row counted by its
  text posterior (grouped aggregation, smoothed).  A missing value is no evidence.
* Host prior: a host's counts smoothed towards its parent domain's, those towards the corpus's;
  all grouped aggregation, pre-aggregated before the shuffle, so a hot host is one row per task.

A row is accepted if the winner is a language and its posterior reaches ``least``.

Defined cases: null and empty texts (or texts without letters) have no text evidence and are
rejected as undetermined; invalid UTF-8 is read as U+FFFD; markup that is never closed is
removed up to the end of the page (scripts, styles, comments) or kept as text (tags); ties go to the alphabetically first language; repeated rows get equal
results; an empty table gives no rows; no labelled rows at all leaves every row undetermined.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, clean_utf8, col, free_name, materialize, prepare, runs, utf8

CELLS = 1 << 14
#: Distinct labelled rows of each language (expected number, by hash of id and text) that the text
#: model is fitted on.
LANGUAGE_ROWS = 400
#: A language of the model has at least so many labelled rows in the whole table.
LEAST_ROWS = 3
TEMPER = 4.0
#: Strength, in rows, of the parent's distribution in a host's or a domain's prior.
KAPPA = 20.0
UNDETERMINED_PRIOR = 1e-3
#: Removed from pages.  A script, style or comment without an end reaches to the end of the page; a
#: tag holds no further "<".  Every alternative passes a character once, so the scan is linear.
MARKUP = r"(?s)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&#?\w++;"
DECLARED = r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z]+)"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each trigram of letters and single blanks (centred on a letter), and its text."""
    claim("langid", int)  # holds no caches
    text = data.tobytes().decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets[1:])
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters
        low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    low = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    letter = (cps > 0xFFFF) | _letters()[np.minimum(cps, 0xFFFF)]
    owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    c = np.where(letter, low, 32).astype(np.int64)
    if len(c) < 3:
        c, owner, letter = np.append(c, [32, 32, 32]), np.append(owner, [-1, -1, -1]), np.append(letter, [False] * 3)
    before, after = np.append(32, c[:-1]), np.append(c[1:], 32)
    before[1:][owner[1:] != owner[:-1]] = 32
    after[:-1][owner[1:] != owner[:-1]] = 32
    at = np.flatnonzero(letter)
    h = before[at] * 0x9E3779B1 + c[at] * 0x85EBCA77 + after[at] * 0xC2B2AE3D
    return ((h ^ (h >> 17)) * 0x27D4EB2F >> 15) & (CELLS - 1), owner[at]


def _count_batches(languages):
    known = {x: i for i, x in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            data, offsets = utf8(clean_utf8(batch.column(1)))
            lang = np.array([known.get(x, -1) for x in batch.column(0).to_pylist()])
            for a, b in runs(offsets, 500_000):
                cells, owner = trigram_cells(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                use = lang[a:b][owner] >= 0
                np.add.at(sums, (lang[a:b][owner][use], cells[use]), 1)
        x, y = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(sums[x, y])], ["language", "cell", "n"])

    return count


class TextModel:
    """Languages and log P(cell | language); the last column is the undetermined hypothesis."""

    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp


def languages_of(rows: DataFrame) -> DataFrame:
    """Languages of ``rows (language, h)``, counted over all of them, and the largest hash of each
    one's sample: about ``LANGUAGE_ROWS`` distinct rows, and never less than one."""
    by = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("d"), F.min("h").alias("least"))
    share = F.least(F.lit(1.0), F.lit(float(LANGUAGE_ROWS)) / F.greatest(F.col("d"), F.lit(1)))
    return by.where(F.col("n") >= LEAST_ROWS).select("language", F.greatest("least", (share * float(1 << 62)).cast("long")).alias("most"))


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> TextModel:
    """A text model of every language with ``LEAST_ROWS`` labelled rows, each from a hash sample of
    about ``LANGUAGE_ROWS`` of its distinct rows (equal rows count once)."""
    spark = rows.sparkSession
    prepare(spark)
    rows = (rows.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != ""))
            .select(F.lower(lang_col).alias("language"), F.col(text_col).cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64(id_col, text_col), 2).alias("h")))
    parts = [(r["language"], r["most"]) for r in languages_of(rows.select("language", "h")).collect()]
    languages = sorted(x for x, _ in parts)
    sums = np.zeros((len(languages), CELLS))
    if languages:
        bounds = F.broadcast(spark.createDataFrame(parts, "language string, most long"))
        sample = rows.join(bounds, "language").where("h <= most").dropDuplicates(["language", "h"]).select("language", "text")
        counted = sample.mapInArrow(_count_batches(languages), "language long, cell long, n long").groupBy("language", "cell").agg(F.sum("n").alias("n"))
        got = counted.toPandas()  # at most CELLS rows of a language
        sums[got["language"], got["cell"]] = got["n"]
    smooth = sums + 0.1
    logp = np.log(smooth / smooth.sum(1, keepdims=True))
    return TextModel(languages, np.vstack([logp, np.full((1, CELLS), -np.log(CELLS))]).T.astype(np.float32))


def log_likelihood(text: Column, model: TextModel) -> Column:
    """log P(text | l) / TEMPER for each language and, last, undetermined; empty without letters."""
    logp = model.logp

    @F.arrow_udf("array<double>")
    def language_likelihood(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(clean_utf8(texts))
        n, k = len(offsets) - 1, logp.shape[1]
        out, count = np.zeros((n, k)), np.zeros(n, np.int64)
        for a, b in runs(offsets, 500_000):
            cells, owner = trigram_cells(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            count[a:b] = np.bincount(owner, minlength=b - a)
            some = np.flatnonzero(count[a:b])
            if len(some):
                first = np.append(0, np.cumsum(count[a:b][some]))[:-1]
                for j in range(k):
                    out[a + some, j] = np.add.reduceat(logp[:, j][cells], first, dtype=np.float64)
        size = np.where(count > 0, k, 0)
        values = out[count > 0].ravel() / TEMPER
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values))

    return language_likelihood(text)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _add(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def parent_domain(host: Column) -> Column:
    """The last two labels of a host with more than two; otherwise the host itself."""
    return F.substring_index(host, ".", -2)


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or their columns ``keep``) with one more struct column, the last, named ``language`` or a free name:
    code (null: undetermined), confidence, text_code (the text's own best), accepted."""
    spark = rows.sparkSession
    prepare(spark)
    k = len(model.languages)
    keep = rows.columns if keep is None else keep
    name = free_name(rows, "language")
    if not k:
        nothing = F.struct(F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_code"), F.lit(False).alias("accepted"))
        return rows.select(*[col(rows, c) for c in keep], nothing.alias(name))
    codes = F.array(*[F.lit(x) for x in model.languages], F.lit(None).cast("string"))
    clean = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    base = rows.select(F.struct(*[col(rows, c) for c in keep]).alias("row"), log_likelihood(text.cast("string"), model).alias("ll"),
                       clean(declared).alias("declared"), clean(suffix).alias("suffix"), clean(host).alias("host"))
    base = materialize(base, "language-evidence")
    prior = F.array(*[F.lit(float(np.log(1 / k))) for _ in range(k)], F.lit(float(np.log(UNDETERMINED_PRIOR))))
    seen = base.where(F.size("ll") > 0).select("declared", "suffix", "host", _softmax(_add(F.col("ll"), prior)).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)]
    counts = lambda key: seen.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)

    def given(key: str) -> DataFrame:
        """log P(value | l) of each value, smoothed by half a row of each value seen."""
        c = counts(key)
        total = c.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
        logs = [F.log((F.col(f"c{i}") + 0.5) / F.lit((total[f"c{i}"] or 0.0) + 0.5 * max(total["n"], 1))) for i in range(k)]
        return c.select(key, F.array(*logs, F.lit(float(-np.log(max(total["n"], 1))))).alias(f"{key}_log"))

    by_host = materialize(counts("host").withColumn("domain", parent_domain(F.col("host"))), "host-counts")
    total = by_host.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    flat = np.array([total[f"c{i}"] or 0.0 for i in range(k)]) + 1.0
    flat = flat / max(flat.sum(), 1e-300)
    mass = lambda p: F.aggregate(F.array(*[F.col(f"{p}{i}") for i in range(k)]), F.lit(0.0), lambda s, y: s + y)
    domain = by_host.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(k)])
    smooth = by_host.withColumn("c", mass("c")).join(domain.withColumn("d", mass("d")), "domain")
    up = [(F.col(f"d{i}") + KAPPA * float(flat[i])) / (F.col("d") + KAPPA) for i in range(k)]
    own = [F.log((F.col(f"c{i}") + KAPPA * up[i]) / (F.col("c") + KAPPA)) for i in range(k)]
    hosts = smooth.select("host", F.array(*own, F.lit(float(np.log(UNDETERMINED_PRIOR)))).alias("host_log"))
    flat_log = F.array(*[F.lit(float(np.log(x))) for x in flat], F.lit(float(np.log(UNDETERMINED_PRIOR))))
    fused = base
    for key, evidence in (("host", hosts), ("declared", given("declared")), ("suffix", given("suffix"))):
        fused = fused.join(materialize(evidence, f"evidence-{key}"), key, "left")
    score = _add(_add(_add(F.coalesce("host_log", flat_log), F.col("ll")), F.col("declared_log")), F.col("suffix_log"))
    fused = fused.select("row", "ll", F.when(F.size("ll") > 0, _softmax(score)).alias("p"))
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int") - 1
    own_best = F.array_position(F.col("ll"), F.array_max("ll")).cast("int") - 1
    out = F.struct(F.when(F.col("p").isNotNull(), F.get(codes, best)).alias("code"), F.coalesce(F.array_max("p"), F.lit(0.0)).alias("confidence"),
                   F.when(F.size("ll") > 0, F.get(codes, own_best)).alias("text_code"),
                   F.coalesce((best < k) & (F.array_max("p") >= least), F.lit(False)).alias("accepted"))
    return fused.select("row.*", out.alias(name))


def page_columns(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> dict[str, Column]:
    """Text, declared language, suffix and host of raw pages."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return {"text": F.regexp_replace(html, MARKUP, " "), "declared": F.regexp_extract(html, DECLARED, 1),
            "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1), "host": host}
