import duckdb
import pytest

import corpus_pipeline
from conftest import SF001
from helpers import docs, words
from tessel.llm.catalogue import ORACLE, QUERIES
from tessel.llm.common import table


def test_stages_return_document_columns_and_decide(spark):
    source = table(spark, SF001, "documents")
    ids, now = {r["doc_id"] for r in source.select("doc_id").collect()}, source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF001)
        assert now.columns == source.columns, name
        left = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert left <= ids, name
        if name in ("toxicity", "minhash_dedup"):
            assert len(left) < len(ids), name
        ids = left
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF001)
    assert out.count() == now.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_stages_survive_edge_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "", ""), (2, "the " * 30000, "en", "a")] + [(10 + i, " ".join(words(i, 20)), "en", "a") for i in range(6)]
    for table_ in (docs(spark, rows), docs(spark, [])):
        now = table_.selectExpr("*", "1 as language", "2 as mix", "3 as gone", "4 as score")
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF001)
            now.count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF001).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted("|".join(map(str, r)) for r in d[cols].astype(str).replace({"None": "", "nan": "", "NaT": "", "<NA>": ""}).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_run_equals_plain_stages(spark, tmp_path):
    """Decisions of the trained models are taken as given; everything after them is done again by
    plain loops, SQL and the tokenizer library."""
    import collections
    import hashlib

    import numpy as np
    import pandas as pd
    import public_tokenizers
    import pyarrow as pa
    import tiktoken
    from pyspark.sql import functions as F
    from test_minhash import brute

    from tessel.llm import bpe, langid, toxicity
    from tessel.llm.catalogue import vocabulary_path

    folder = str(tmp_path)
    more = [(9000, None), (9001, "12 34 !!"), (9002, ""), (9003, "zq xj vk wq " * 9)]
    table(spark, SF001, "documents").union(docs(spark, more).selectExpr("doc_id", "text", "cast(null as string)", "source", "n_chars")).write.parquet(f"{folder}/documents.parquet")
    table(spark, SF001, "labels").write.parquet(f"{folder}/labels.parquet")
    source = table(spark, folder, "documents")
    model = langid.fit(source, "doc_id", "text", "lang")
    judged = langid.identify(source, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.concat(F.lit("source/"), "source")).collect()
    kept = [r for r in judged if r["language"]["accepted"]]
    assert 0 < len(kept) < len(judged)
    rest = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in kept], source.schema)
    scorer = toxicity.train(rest, table(spark, folder, "labels"))
    score = scorer.score(toxicity.features_of(pa.array([r["text"] for r in kept], pa.string()), toxicity._Known(scorer.lexicon)))
    kept = [r for r, s in zip(kept, score) if s < 0.3]
    component = brute([(r["doc_id"], r["text"]) for r in kept], 80)
    kept = [r for r in kept if component[r["doc_id"]] == r["doc_id"]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in kept]).drop(columns="language"))
    mixed = con.execute(ORACLE["op6_temperature_mix"]).df()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.load_ranks(vocabulary_path())), special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in kept}
    want = collections.Counter()
    for i in mixed["doc_id"]:
        ids = enc.encode_ordinary(text[i])
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want
