"""Temperature mixing of sources, realised as budgeted block permutations.

Weights are source token shares raised to an exponent and normalised.  The exponent is found by
bisection: the largest that reaches the target entropy, raised where the repetition limit needs
it.  Each source's documents hash into blocks of about ``block_tokens`` tokens; every epoch takes
the blocks in its own permutation; whole epochs come first, then blocks until the source's budget
is filled, the block at the cut up to a hash threshold.

DataFrame operations only.  Per-source and per-block sums are pre-aggregated; no source's rows
meet in one task (blocks are bounded in tokens, the block table is what a window orders).

Defined cases: a document's tokens are its words plus one, so empty and null texts count one;
a null source is a source of its own; rows with equal ids share a hash and stand or fall
together (rows without an id by their text); a single source gets weight 1; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import materialize

from .common import col, free_name

STEPS_AT_ONCE = 6  # bisection steps answered by one job
ROUNDS = 5  # so the exponent is exact to 2**-30


def token_count(text: Column) -> Column:
    """Words (runs of other than ASCII white space) plus one for the document's end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long") + 1


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts joined by ':' (null reads 'null')."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def slim_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Source key, document hash and tokens of every row."""
    return docs.select(source_key(F.col(source_col)).alias("src"), document_hash(F.col(id_col), F.col(text_col), seed).alias("h"),
                       token_count(F.col(text_col).cast("string")).alias("tokens"))


def document_hash(id_: Column, text: Column, seed: int) -> Column:
    """By the id; documents without one hash by their text, so they spread over the blocks."""
    own = F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return hash60(F.lit(seed), F.coalesce(id_.cast("string"), own))


def source_key(source: Column) -> Column:
    """Never null: '=' and the name, '~' for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _sums(stats: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy, and the most epochs any source needs, for each exponent."""
    top = stats.agg(F.max("n").alias("m"), F.min("n").alias("least"), F.sum("n").alias("total")).first()
    x = F.log(F.col("n") / F.lit(float(top["m"])))
    rows = (stats.select("n", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
            .groupBy("alpha").agg(F.sum(F.exp(F.col("alpha") * x)).alias("z"), F.sum(F.exp(F.col("alpha") * x) * x).alias("a")).collect())
    scale, least = top["total"] / top["m"], math.log(top["least"] / top["m"])
    return {r["alpha"]: (math.log(r["z"]) - r["alpha"] * r["a"] / r["z"], scale / r["z"] * math.exp((r["alpha"] - 1) * least)) for r in rows}


def bisect_exponent(stats: DataFrame, good, largest: bool) -> float:
    """The largest (smallest) exponent in [0, 1] with ``good(entropy, epochs)``, which holds up
    to (from) there; each job answers several bisection steps.  1 where none is good."""
    lo, hi = 0.0, 1.0
    ends = _sums(stats, [0.0, 1.0])
    if largest and good(*ends[1.0]) or not largest and not good(*ends[1.0]):
        return 1.0
    if not largest and good(*ends[0.0]) or largest and not good(*ends[0.0]):
        return 0.0
    parts = 2 ** STEPS_AT_ONCE
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        sums = _sums(stats, grid)
        points = [lo, *grid, hi]
        a, b = 0, parts
        while b - a > 1:
            mid = (a + b) // 2
            if good(*sums[points[mid]]) == largest:
                a = mid
            else:
                b = mid
        lo, hi = points[a], points[b]
    return lo if largest else hi


def weights(stats: DataFrame, entropy_share: float, most_epochs: float, budget_share: float, block_tokens: int) -> DataFrame:
    """Per source: tokens ``n``, weight, token budget ``quota``, whole epochs, rest, blocks.

    ``entropy_share`` is the wanted share of the largest possible entropy, log(sources);
    ``budget_share`` the mix's tokens as a share of the input's.
    """
    found = stats.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.max("n").alias("m")).first()
    if not found["k"]:
        alpha, total, top = 1.0, 0, 1
    else:
        total, top, goal = found["total"], found["m"], entropy_share * math.log(found["k"])
        alpha = bisect_exponent(stats, lambda entropy, _: entropy >= goal, True)
        alpha = max(alpha, bisect_exponent(stats, lambda _, epochs: epochs * budget_share <= most_epochs, False))
    mass = F.exp(F.lit(alpha) * F.log(F.col("n") / F.lit(float(top))))
    z = stats.agg(F.sum(mass).alias("z")).first()["z"] or 1.0
    quota = F.round(F.lit(budget_share * total) * mass / F.lit(z)).cast("long")
    return (stats.withColumn("weight", mass / F.lit(z)).withColumn("quota", quota).withColumn("alpha", F.lit(alpha))
            .withColumn("whole", F.floor(F.col("quota") / F.col("n")))
            .withColumn("rest", F.col("quota") - F.col("whole") * F.col("n"))
            .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_tokens))).cast("long")))


def plan(slim: DataFrame, w: DataFrame, seed: int) -> DataFrame:
    """Every (source, epoch, block) that the mix takes: tokens of the epoch before it, and for the
    block at a source's cut the largest epoch hash ``upto`` still taken (null: the whole block)."""
    blocks = slim.join(w.select("src", "blocks"), "src").groupBy("src", F.pmod("h", "blocks").alias("block")).agg(F.sum("tokens").alias("block_tokens"))
    epochs = (blocks.join(w.select("src", "whole", "rest"), "src")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
              .where((F.col("epoch") < F.col("whole")) | (F.col("rest") > 0)))
    turn = Window.partitionBy("src", "epoch").orderBy(hash60(F.lit(seed), F.col("epoch"), F.col("src"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    epochs = (epochs.withColumn("before", F.coalesce(F.sum("block_tokens").over(turn), F.lit(0)))
              .where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest"))))
    epochs = materialize(epochs, "mix-blocks")
    cut = epochs.where((F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("block_tokens") > F.col("rest")))
    rows = (slim.join(w.select("src", "blocks"), "src").withColumn("block", F.pmod("h", "blocks"))
            .join(cut.select("src", "block", "epoch", "before", "rest"), ["src", "block"])
            .withColumn("eh", hash60(F.lit(seed), F.col("epoch"), F.col("h"))))
    same = rows.groupBy("src", "block", "epoch", "before", "rest", "eh").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("src", "block", "epoch").orderBy("eh").rowsBetween(Window.unboundedPreceding, -1)
    taken = (same.withColumn("run", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
             .where(F.col("run") < F.col("rest")).groupBy("src", "block", "epoch").agg(F.max("eh").alias("upto")))
    return epochs.join(taken, ["src", "block", "epoch"], "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float = 0.95,
        most_epochs: float = 4.0, budget_share: float = 1.0, block_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """``docs`` with one more struct column, the last, named ``mix`` or a free name (epoch, block, position, weight, tokens); a row per
    taken copy.  Reading by ``position`` (0 to 1) gives every source at its weight throughout."""
    slim = materialize(slim_rows(docs, id_col, text_col, source_col, seed), "mix-rows")
    stats = materialize(slim.groupBy("src").agg(F.sum("tokens").alias("n")), "mix-sources")
    w = materialize(weights(stats, entropy_share, most_epochs, budget_share, block_tokens), "mix-weights")
    blocks = materialize(plan(slim, w, seed).join(w.select("src", "n", "weight", "quota"), "src"), "mix-plan")
    row = F.struct(*[col(docs, c) for c in docs.columns])
    keyed = docs.select(row.alias("row"), source_key(F.col(source_col)).alias("src"), document_hash(F.col(id_col), F.col(text_col), seed).alias("h"),
                        token_count(F.col(text_col).cast("string")).alias("tokens"))
    placed = (keyed.join(w.select("src", "blocks"), "src").withColumn("block", F.pmod("h", "blocks"))
              .join(blocks.select("src", "block", "epoch", "before", "upto", "n", "weight", "quota"), ["src", "block"]))
    kept = placed.where(F.col("upto").isNull() | (hash60(F.lit(seed), F.col("epoch"), F.col("h")) <= F.col("upto")))
    info = F.struct("epoch", "block", ((F.col("epoch") * F.col("n") + F.col("before")) / F.col("quota")).alias("position"), "weight", "tokens")
    return kept.select("row.*", info.alias(free_name(docs, "mix")))
