"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, collision, hnsw, langid, minhash, mixing, orchard, rans, sharding, toxicity, urlfilter
from .common import table
from .oracle import ORACLE

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair and render all ``conversations``."""
    return chat.repair(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``pages`` (markup language, address suffix and host from the page)
    and of ``documents`` (declared ``lang``, ``source`` as host)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.fit(docs, "doc_id", "text", "lang")
    parts = langid.page_columns(pages)
    rows = docs.select(F.lit("documents").alias("table"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.concat(F.lit("source/"), "source").alias("host"))
    rows = rows.union(pages.select(F.lit("pages"), F.lit(None).cast("long"), "page_id", *[parts[c].alias(c) for c in ("text", "declared", "suffix", "host")]))
    done = langid.identify(rows, model, *[F.col(c) for c in ("text", "declared", "suffix", "host")], keep=["table", "doc_id", "page_id"])
    return done.select("table", "doc_id", "page_id", "language.*")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return bpe.document_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of the sources of ``documents`` at 95 % of the largest entropy, at most four epochs
    of any source, as many tokens as the table has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "mix.tokens", "mix.epoch", "mix.block", F.round("mix.position", 9).alias("position"), F.round("mix.weight", 9).alias("weight"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in captures: the addresses of ``pages`` with a fetch day in 2024 from the page id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetch_day"))


def list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in list entries, dated by a hash of each host of ``pages``: hosts on and off a list,
    domains on another, an allowed address prefix on a third."""
    host = F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)).alias("host")
    h = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long")
    hosts = table(spark, sf_dir, "pages").select(host).distinct().where("host <> ''").withColumn("h", h)
    start = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 200 + n).cast("int"))
    event = lambda name, policy, kind, value, action, day: F.struct(F.lit(name).alias("list"), F.lit(policy).alias("policy"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), day.alias("day"))
    own, parent = F.col("host"), F.regexp_replace("host", "^[^.]*[.]", "")
    rows = [
        (F.col("h") % 3 == 0, event("spam", "block", "host", own, "add", start(0))),
        (F.col("h") % 6 == 0, event("spam", "block", "host", own, "remove", start(60))),
        (F.col("h") % 12 == 0, event("spam", "block", "host", own, "add", start(120))),
        (F.col("h") % 10 == 1, event("networks", "block", "domain", parent, "add", start(30))),
        (F.col("h") % 20 == 1, event("networks", "block", "domain", parent, "remove", start(90))),
        (F.col("h") % 7 == 0, event("partners", "allow", "prefix", F.concat(own, F.lit("/en")), "add", start(15))),
    ]
    return hosts.select(F.explode(F.filter(F.array(*[F.when(c, e) for c, e in rows]), lambda x: x.isNotNull())).alias("e")).select("e.*")


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture judged by the list entries active on its fetch day."""
    done = urlfilter.judge(captures(spark, sf_dir), list_events(spark, sf_dir))
    return done.select("page_id", "url", "fetch_day", "verdict.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents`` by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards by 4096 virtual slots and a rebalanced slot map."""
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``embeddings`` at cosine 0.9."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all ``embeddings``."""
    return collision.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as entropy-coded token files, and what is read back from them."""
    path = rans.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return rans.read(spark, path, with_ids=False)


def op12_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings`` by four codebooks of 256 entries moved four times."""
    return orchard.compress(table(spark, sf_dir, "embeddings"))


def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all ``documents``, links scored by an index of pair bitmaps."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_chat_repair": op1_chat_repair,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_temporal_url_filter": op5_temporal_url_filter,
    "op6_temperature_mix": op6_temperature_mix,
    "op7_toxicity": op7_toxicity,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_hnsw_dedup": op9_hnsw_dedup,
    "op10_collision_ann": op10_collision_ann,
    "op11_rans_tokens": op11_rans_tokens,
    "op12_orchard_codes": op12_orchard_codes,
    "op13_pair_bitmaps": op13_pair_bitmaps,
}
