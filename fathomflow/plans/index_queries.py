"""Queries on stored indexes: versions and appends, approximate search, expanded queries, weighted retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expansion
from ..operators import encoding, navigable, retrieval
from ..sources import market, paged
from ..sources.index_store import IndexStore
from ..sources.shared import new_path
from .registry import on_panel, query, rounded, table
from .store_queries import _BM25, _RANK, _VECTORS, _index


def _in_two_steps(spark, sf_dir) -> IndexStore:
    """An index of the documents in other languages, to which all are appended; reopened."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text")
    root = new_path(spark, "index")
    store = IndexStore(spark, root)
    store.append(docs.where("lang <> 'en'"), stored=["lang"])
    store.append(docs, stored=["lang"])
    return IndexStore(spark, root)


@query("S22_reopened_index", f"WITH {_BM25}, {_RANK.format('bm')} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm_r")
def s22(spark, sf_dir):
    terms = retrieval.query_terms(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))
    return rounded(retrieval.top_k(retrieval.bm25(_in_two_steps(spark, sf_dir).index(), terms, 20), 20))


@query("R18_incremental_index", "SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version FROM documents")
def r18(spark, sf_dir):
    store = _in_two_steps(spark, sf_dir)
    return store.added(1).unionByName(store.added(2))


@query("R09_navigable_top_k", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, greatest(0, least(1, list_cosine_similarity(q, embedding::DOUBLE[]))) AS score FROM q, embeddings)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def r09(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    store = IndexStore(spark, new_path(spark, "index"))
    store.append(vectors.withColumn("text", F.lit(None).cast("string")), stored=[], vectors=False)
    asked = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return rounded(navigable.search(store.graphs(), asked, 10))


_QUESTIONS = "CASE doc_id % 6 WHEN 0 THEN '动量因子 ' || source WHEN 1 THEN '请用预训练模型预测' WHEN 2 THEN 'what of ' || lang WHEN 3 THEN '数据dataset，我们的方法?' WHEN 4 THEN '因子 factor 因子' ELSE '中' END"
#: Expectations are written by hand.
_PLAIN = "CASE doc_id % 6 WHEN 0 THEN 'src 动量 momentum trend 因子 factor alpha signal' WHEN 1 THEN '用 预 训练 training train 模型 model 预测 forecast prediction forecasting' WHEN 2 THEN 'what of ' || lang WHEN 3 THEN 'dataset 数据 data 们 方法 method approach' WHEN 4 THEN 'factor 因子 alpha signal 因子' ELSE '' END"
_LONGEST = "CASE doc_id % 6 WHEN 0 THEN 'src 动量 momentum trend 因子 factor alpha signal' WHEN 1 THEN '用 预训练 pretrained pre-training pretraining 模型 model 预测 forecast prediction forecasting' WHEN 2 THEN 'what of ' || lang WHEN 3 THEN 'dataset 数据 data 方法 method approach' WHEN 4 THEN 'factor 因子 alpha signal 因子' ELSE '' END"


def _expanded(spark, sf_dir, longest: bool) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", F.expr(_QUESTIONS).alias("question"))
    return asked.select("doc_id", expansion.expand(F.col("question"), longest).alias("expanded"))


query("R14_query_expansion", f"SELECT doc_id, {_PLAIN} AS expanded FROM documents")(lambda s, d: _expanded(s, d, False))
query("R14_longest_phrases", f"SELECT doc_id, {_LONGEST} AS expanded FROM documents")(lambda s, d: _expanded(s, d, True))
query(
    "R15_weighted",
    f"""WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')},
fused AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM (SELECT query_id, chunk_id, 0.7 * round(score, 9) AS part FROM cos__r UNION ALL SELECT query_id, chunk_id, round(score, 9) / max(round(score, 9)) OVER (PARTITION BY query_id) * 0.3 FROM bm_r) GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fused QUALIFY rank <= 5""",
)(lambda s, d: rounded(retrieval.retrieve(*_index(s, d), top=5, fusion="weighted")))


@query("S21_paper_search", "SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN ('src1', 'src2', 'src3') AND DATE '2020-01-01' + (doc_id % 1500)::INTEGER >= DATE '2022-01-01' AND contains(lower(text), 'the')")
def s21(spark, sf_dir) -> DataFrame:
    """Papers of some categories since a day that hold a word; the categories are fetched in pages, newest first."""
    papers = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.expr("timestamp'2020-01-01' + make_dt_interval(cast(doc_id % 1500 as int))").alias("at"), "doc_id", "lang", "n_chars", "text")
    location = new_path(spark, "service")
    paged.serve(papers, location)
    found = paged.read_paged(spark, location if "://" in location else f"file://{location}", "collection string, at timestamp, doc_id long, lang string, n_chars long, text string")
    recent = found.where(F.col("collection").isin("src1", "src2", "src3") & (F.col("at") >= F.lit("2022-01-01").cast("timestamp")))
    return recent.where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", F.col("collection").alias("source"), "lang", "n_chars")


@query("S09_fetched_prices", on_panel("SELECT code, count(*) AS n, round(max(close), 6) AS high FROM raw GROUP BY 1 HAVING count(*) > 100"))
def s09(spark, sf_dir) -> DataFrame:
    """Price series of codes, fetched in pages; series of a hundred rows or fewer are left out."""
    prices = market.derived_rows(spark, sf_dir).select(F.col("code").alias("collection"), F.col("date").cast("timestamp").alias("at"), "close")
    location = new_path(spark, "service")
    paged.serve(prices, location)
    found = paged.read_paged(spark, location if "://" in location else f"file://{location}", "collection string, at timestamp, close double")
    return rounded(found.groupBy(F.col("collection").alias("code")).agg(F.count("*").alias("n"), F.max("close").alias("high")).where("n > 100"))


@query("R07_encoded_texts", f"WITH {_BM25.split(',' + chr(10) + 'len_')[0]}, {_VECTORS.split(',' + chr(10) + 'qv')[0]} SELECT chunk_id, bucket::INTEGER AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)), 6) AS value FROM cv")
def r07(spark, sf_dir) -> DataFrame:
    """Documents encoded behind a cache that holds those in English already."""
    docs, cache = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text"), new_path(spark, "encodings")
    encoding.encode(docs.where("lang = 'en'"), "hash-256", encoding.HashEncoder, cache)
    vectors = encoding.encode(docs, "hash-256", encoding.HashEncoder, cache)
    return rounded(vectors.select("chunk_id", F.posexplode("vector").alias("bucket", "value")).where("value > 0"))
