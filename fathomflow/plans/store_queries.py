"""Queries on retrieval, record stores and rules. Documents stand for papers and chunks, benchmark items for queries,
events for usage records, orders for factor records, conversations for memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import catalog, records, retrieval, rules, similarity
from ..sources.index_store import IndexStore
from ..sources.shared import new_path, written
from .registry import query, rounded, table

_DUCK_TOKENS = r"regexp_extract_all({0}, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+')"
_TERMS = f"""ct AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({_DUCK_TOKENS.replace("{0}", "text")}) AS term FROM documents) GROUP BY 1, 2),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_DUCK_TOKENS.replace("{0}", "text")}) AS term FROM benchmark) GROUP BY 1, 2)"""
_BM25 = f"""{_TERMS},
len_ AS (SELECT chunk_id, sum(tf) AS dl FROM ct GROUP BY 1),
size_ AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len_) / (SELECT count(*) FROM documents) AS avgdl),
raw_ AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ct, size_ GROUP BY term, n),
idf_ AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_) ELSE idf END AS idf FROM raw_),
bm AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN ct USING (term) JOIN idf_ USING (term) JOIN len_ USING (chunk_id), size_ GROUP BY 1, 2 HAVING score > 0)"""
_VECTORS = """cv AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, sum(tf) AS c FROM ct GROUP BY 1, 2),
qv AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, sum(qtf) AS c FROM qt GROUP BY 1, 2),
cos_ AS (SELECT query_id, chunk_id, sum(q.c * v.c) / (sqrt(max(qn)) * sqrt(max(cn))) AS score FROM qv q JOIN cv v USING (bucket) JOIN (SELECT query_id, sum(c * c) AS qn FROM qv GROUP BY 1) USING (query_id) JOIN (SELECT chunk_id, sum(c * c) AS cn FROM cv GROUP BY 1) USING (chunk_id) GROUP BY 1, 2)"""
_RANK = "{0}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {0} QUALIFY rank <= 20)"
_RRF = "rrf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM bm_r UNION ALL SELECT query_id, chunk_id, rank FROM cos__r) GROUP BY 1, 2)"


def _terms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return retrieval.postings(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id"), retrieval.postings(items.withColumnRenamed("item_id", "query_id"), "query_id")


def _index(spark, sf_dir, vectors: bool = True) -> tuple[retrieval.Index, DataFrame]:
    """An index of the documents, of which texts are read once, and the terms of the queries."""
    store = IndexStore(spark, new_path(spark, "index"))
    store.rebuild(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), stored=[], vectors=vectors)
    return store.index(), written(retrieval.query_terms(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")), "query-terms")


def _bm25(spark, sf_dir) -> DataFrame:
    """Scores of the 20 best of each batch of chunks."""
    return retrieval.bm25(*_index(spark, sf_dir, vectors=False), 20)


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return retrieval.candidates(*_index(spark, sf_dir), 20)


query("R01_source_id", "SELECT page_id, CASE WHEN length(url) > 0 THEN substr(md5(url), 1, 16) ELSE substr(md5(substr(html, 1, 32)), 1, 16) END AS source_id FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", retrieval.source_id(F.lit(""), F.col("url"), F.col("html")).alias("source_id")))
query("R02_paragraphs", r"SELECT doc_id, len(p)::INTEGER AS n, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\n|\n[ \t]*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", retrieval.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))
)
_LAST = r"CASE WHEN regexp_matches(tail, '{0}') THEN length(regexp_extract(tail, '(?s)^(.*){0}', 1)) ELSE -1 END"
_WINDOWS = rf"""WITH RECURSIVE parts AS (SELECT doc_id::VARCHAR AS source_id, (generate_subscripts(p, 1) - 1)::INTEGER AS paragraph, unnest(p) AS part FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\n|\n[ \t]*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM documents)),
spans AS (
  SELECT source_id, paragraph, part, -1 AS a, 0 AS b, 0 AS next FROM parts WHERE length(part) > 800
  UNION ALL SELECT source_id, paragraph, part, a, stop, greatest(stop - 200, a + 1) FROM (
    SELECT source_id, paragraph, part, a, CASE WHEN found >= 0 AND e - 100 + found + 1 > a + 600 THEN e - 100 + found + 1 ELSE e END AS stop FROM (
      SELECT *, CASE WHEN e = length(part) THEN -1 WHEN sign_ >= 0 THEN sign_ ELSE {_LAST.format('[.!?。！？]')} END AS found FROM (
        SELECT *, {_LAST.format(r'[$\])+=-]')} AS sign_ FROM (SELECT source_id, paragraph, part, next AS a, least(next + 800, length(part)) AS e, substr(part, least(next + 800, length(part)) - 99, 100) AS tail FROM spans WHERE b < length(part))))))
SELECT source_id, paragraph, 0 AS start, length(part)::INTEGER AS "end", part AS text FROM parts WHERE length(part) <= 800
UNION ALL SELECT source_id, paragraph, a::INTEGER, b::INTEGER, substr(part, a + 1, b - a) FROM spans WHERE a >= 0"""
query("R03_window_chunks", _WINDOWS)(lambda s, d: retrieval.chunks(table(s, d, "documents").select(F.col("doc_id").alias("source_id"), "text")))
query("R04_title_prefix", "SELECT item_id, '标题: ' || item_id::VARCHAR || chr(10) || chr(10) || text AS text FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", retrieval.with_title(F.col("item_id").cast("string"), F.col("text")).alias("text")))
query("R05_tokens", f"SELECT doc_id, len({_DUCK_TOKENS.replace('{0}', 'text')})::INTEGER AS n FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.size(retrieval.tokens(F.col("text"))).alias("n")))
query("R06_hash_vectors", f"WITH {_TERMS}, {_VECTORS} SELECT chunk_id, bucket::INTEGER AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)), 6) AS value FROM cv")(lambda s, d: rounded(retrieval.hash_vectors(_terms(s, d)[0], "chunk_id")))


@query("R08_dense_top_k", """WITH items AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centroids AS (SELECT label, list(round(a, 9) ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM items GROUP BY 1, 2) GROUP BY 1)
SELECT label AS query_id, vec_id AS chunk_id, round(list_dot_product(c, embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(c, embedding::DOUBLE[]), 9) DESC, vec_id)::INTEGER AS rank FROM (SELECT c.label, c.c, e.vec_id, e.embedding FROM centroids c, embeddings e) QUALIFY rank <= 5""")
def r08(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    centroids = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("vector"))
    scored = retrieval.dense_top_k(centroids, vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 5)
    return rounded(scored)


query("R10_bm25", f"WITH {_BM25}, {_RANK.format('bm')} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm_r")(lambda s, d: rounded(retrieval.top_k(_bm25(s, d), 20)))
query("T03_vector_top_k", f"WITH {_TERMS}, {_VECTORS}, {_RANK.format('cos_')} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM cos__r")(lambda s, d: rounded(_both(s, d)[1]))
query("R11_rank_fusion", f"WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')}, {_RRF} SELECT query_id, chunk_id, round(score, 6) AS score FROM rrf")(lambda s, d: rounded(retrieval.reciprocal_rank_fusion(*[(x, 1.0) for x in _both(s, d)])))
query("R12_weighted_fusion", f"WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')} SELECT query_id, chunk_id, round(sum(part), 10) AS score FROM (SELECT query_id, chunk_id, 0.7 * round(score, 9) AS part FROM cos__r UNION ALL SELECT query_id, chunk_id, round(score, 9) / max(round(score, 9)) OVER (PARTITION BY query_id) * 0.3 FROM bm_r) GROUP BY 1, 2")(
    lambda s, d: rounded((lambda b, v: retrieval.weighted_fusion(v, b))(*_both(s, d)), 10)
)
query("A28_ranking_metrics", f"WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')}, hits AS (SELECT r.query_id, count(*) AS n, count(c.rank) AS h, min(c.rank) AS best, sum(1 / log2(c.rank + 1)) AS dcg FROM bm_r r LEFT JOIN (SELECT * FROM cos__r WHERE rank <= 10) c USING (query_id, chunk_id) WHERE r.rank <= 3 GROUP BY 1) SELECT query_id, round(h / n, 6) AS recall, round(coalesce(1.0 / best, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM hits")(
    lambda s, d: rounded((lambda b, v: retrieval.ranking_metrics(v, b.where("rank <= 3").select("query_id", "chunk_id"), 10))(*_both(s, d)))
)
query("R17_context_budget", f"WITH {_BM25}, {_RANK.format('bm')} SELECT query_id, chunk_id, rank::INTEGER AS rank, used::BIGINT AS used FROM (SELECT query_id, chunk_id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM bm_r JOIN documents ON doc_id = chunk_id) WHERE used <= 2000")(
    lambda s, d: retrieval.within_budget(retrieval.top_k(_bm25(s, d), 20), table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")).select("query_id", "chunk_id", "rank", "used")
)
query("R16_conversation_query", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations WHERE role = 'user') SELECT conv_id, string_agg(text, ' | ' ORDER BY t) AS query FROM (SELECT conv_id, -1 AS t, text FROM u WHERE f = 1 UNION ALL SELECT conv_id, turn, text FROM u WHERE b <= 3) GROUP BY 1")(lambda s, d: retrieval.conversation_query(table(s, d, "conversations")))
query("R18_not_indexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: retrieval.not_indexed(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"))
query("R20_manifest", "SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1, 2")(lambda s, d: table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))

# Filters, joins and sets.

query("P06_equality_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")(lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
query("P07_substring_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring')")(lambda s, d: table(s, d, "part").where(records.contains_any_case(["p_name", "p_brand", "p_type"], "RING")).select("p_partkey"))
query("P08_array_membership", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')")(lambda s, d: table(s, d, "part").where(F.array_contains(F.split("p_name", " "), "widget")).select("p_partkey"))
query("P09_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")(lambda s, d: records.page(table(s, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 40, 20))
query("P10_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50")(lambda s, d: table(s, d, "events").where("ts between timestamp'2024-01-05' and timestamp'2024-01-12' and event_type = 'click'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id"))
query("P11_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")(lambda s, d: table(s, d, "documents").where(F.col("lang").isin("en") & F.col("source").isin("src1", "src2")).select("doc_id"))
query("P12_thresholds", "SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 AND c_nationkey >= 10")(lambda s, d: table(s, d, "customer").where("c_acctbal >= 5000 and c_nationkey >= 10").select("c_custkey"))
query("P13_keyword_score", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')::INT + contains(lower(text), 'with')::INT + contains(lower(text), 'from')::INT >= 2 AND contains(lower(text), 'idiot')::INT + contains(lower(text), 'moron')::INT < 2")(
    lambda s, d: table(s, d, "documents").where((records.keyword_score(F.col("text"), ["the", "with", "from"]) >= 2) & (records.keyword_score(F.col("text"), ["idiot", "moron"]) < 2)).select("doc_id")
)
_RULES = [("l_quantity >= 40 and not (l_linenumber > 3)", "large"), ("l_quantity < 10 or l_linenumber == 1", "small"), ("l_discounted", "discounted")]
_RULE_SQL = "CASE WHEN l_quantity >= 40 AND NOT l_linenumber > 3 THEN 'large' WHEN l_quantity < 10 OR l_linenumber = 1 THEN 'small' WHEN l_discount > 0 THEN 'discounted' END"


@query("P14_first_matching_rule", f"SELECT l_orderkey, l_linenumber, l_partkey, {_RULE_SQL} AS action FROM lineitem")
def p14(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_discounted", F.col("l_discount") > 0)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", rules.first_match(_RULES, items.columns).alias("action"))


@query("P15_override", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NOT NULL AND l_returnflag <> 'N' THEN a ELSE l_returnflag END AS chosen FROM (SELECT *, {_RULE_SQL} AS a FROM lineitem)")
def p15(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_discounted", F.col("l_discount") > 0)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", rules.override(F.col("l_returnflag"), rules.first_match(_RULES, items.columns), "N").alias("chosen"))


query("P16_decision", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_discount) >= 0.03 AND abs(l_tax) >= 0.05 THEN 'approve' WHEN abs(l_discount) < 0.01 THEN 'reject' ELSE 'approve' END AS decision FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.decide(F.col("l_discount"), F.col("l_tax"), 0.03, 0.05).alias("decision")))
query("J05_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey"))
query("J06_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"))
query("J07_full_outer", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars, b.quality FROM (SELECT * FROM documents WHERE lang = 'en') a FULL JOIN labels b ON a.doc_id = b.doc_id")(lambda s, d: table(s, d, "documents").where("lang = 'en'").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "full"))
query("J08_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name"))
query("J09_left_by_name", "SELECT p_partkey, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")(lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "n"))
query("J10_token_overlap", r"WITH t AS (SELECT DISTINCT n AS id, unnest(regexp_extract_all(lower(n), '\w{3,}')) AS token FROM (SELECT DISTINCT p_name || ' ' || p_type AS n FROM part)), s AS (SELECT id, count(*) AS n FROM t GROUP BY 1) SELECT a.id AS left_id, b.id AS right_id, round(count(*) / max(n), 6) AS overlap FROM t a JOIN t b USING (token) JOIN s ON s.id = a.id GROUP BY 1, 2 HAVING count(*) / max(n) > 0.8")(
    lambda s, d: rounded((lambda t: similarity.token_overlaps(t, t))(table(s, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("id")).distinct().withColumn("text", F.col("id"))))
)
query("T01_sort_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")(lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey"))
query("T02_top_3", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3")(lambda s, d: table(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3).select("s_suppkey"))
query("T07_hard_negatives", f"WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM cos__r ANTI JOIN (SELECT * FROM bm_r WHERE rank <= 3) USING (query_id, chunk_id)")(lambda s, d: (lambda b, v: v.join(b.where("rank <= 3"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "rank"))(*_both(s, d)))
query("T08_id_sets", "SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: (lambda a, b: a.intersect(b).withColumn("labelled", F.lit(True)).unionByName(a.subtract(b).withColumn("labelled", F.lit(False))))(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")))
query("T09_first_wins", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")(lambda s, d: records.first_by(table(s, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id"))
query("T10_last_wins", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey DESC) = 1")(lambda s, d: records.first_by(table(s, d, "part").withColumn("k", F.lower("p_name")), ["k"], [F.desc("p_partkey")]).select("p_name", "p_partkey"))

# Aggregates.

query("A21_counts_by", "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT '*', NULL, count(*) FROM orders")(lambda s, d: records.counts_by(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]))
query("A22_grouping_sets", "SELECT lang, source, sum(n_chars)::BIGINT AS chars, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")(lambda s, d: table(s, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n")))
query("A23_group_lists", "SELECT coalesce(source, 'none') AS source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1")(lambda s, d: table(s, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids")))
_PRICES = [("click", 2.0, 8.0), ("pur", 1.0, 4.0), ("ew", 1.0, 3.0)]
_USAGE = "SELECT event_type AS model, (event_id % 1000)::BIGINT AS prompt, (event_id % 77)::BIGINT AS completion FROM events"
_PRICED = f"SELECT *, CASE WHEN model = 'click' THEN 2.0 WHEN starts_with(model, 'pur') THEN 1.0 WHEN contains(model, 'ew') THEN 1.0 ELSE 0 END AS i, CASE WHEN model = 'click' THEN 8.0 WHEN starts_with(model, 'pur') THEN 4.0 WHEN contains(model, 'ew') THEN 3.0 ELSE 0 END AS o FROM ({_USAGE})"


def _usage(spark, sf_dir) -> DataFrame:
    usage = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("prompt"), (F.col("event_id") % 77).alias("completion"))
    return records.price_of(usage, _PRICES).withColumn("cost", records.call_cost(F.col("prompt"), F.col("completion"), F.col("input_price"), F.col("output_price")))


query("A24_cost_by_model", f"SELECT model, round(sum(round(prompt / 1e6 * i + completion / 1e6 * o, 6)), 4) AS cost, sum(prompt + completion)::BIGINT AS tokens, count(*) AS calls FROM ({_PRICED}) GROUP BY ROLLUP (model)")(lambda s, d: rounded(_usage(s, d).rollup("model").agg(F.sum("cost").alias("cost"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.count("*").alias("calls")), 4))
query("A27_pass_rate", "SELECT round(avg(quality), 6) AS pass_rate, round(avg(1.0 - toxic), 6) AS mean_score, count(*) AS n FROM labels")(lambda s, d: rounded(table(s, d, "labels").agg(F.avg("quality").alias("pass_rate"), F.avg(1.0 - F.col("toxic")).alias("mean_score"), F.count("*").alias("n"))))
query("A29_nearest_rank", "SELECT event_type, p::INTEGER AS percent, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), (SELECT unnest([50, 95, 99]) AS p) WHERE i = least(floor(n * p / 100), n - 1)")(lambda s, d: records.nearest_rank(table(s, d, "events"), "value", [50, 95, 99], ["event_type"]))
query("A30_histogram", "SELECT b::DOUBLE AS bound, (SELECT count(*) FROM events WHERE value <= b) AS n FROM (SELECT unnest([1, 5, 10, 30, 100]) AS b) UNION ALL SELECT NULL, count(value) FROM events")(lambda s, d: records.histogram(table(s, d, "events"), "value", [1, 5, 10, 30, 100]))
query("A31_score_spread", "SELECT source, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS sd FROM documents GROUP BY 1")(lambda s, d: rounded(table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("sd")), 4))
query("A33_keywords", f"SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest({_DUCK_TOKENS.replace('{0}', 'text')}) AS term FROM conversations) WHERE length(term) >= 2 GROUP BY 1 HAVING count(*) >= 2) ORDER BY n DESC, term LIMIT 8")(lambda s, d: table(s, d, "conversations").select(F.explode(retrieval.tokens(F.col("text"))).alias("term")).where("length(term) >= 2").groupBy("term").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "term").limit(8))

# Versions of record tables.

query("U01_insert_new", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: records.insert_new(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").select("doc_id"), "doc_id"))
query("U02_update", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, lang) AS lang, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda s, d: records.update(table(s, d, "documents").select("doc_id", "lang", "source"), table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang")), "doc_id"))
query("U05_update_non_empty", "SELECT d.doc_id, coalesce(nullif(CASE WHEN l.quality = 1 THEN 'good' ELSE '' END, ''), source) AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda s, d: records.update(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("source")), "doc_id", skip_empty=True))
query("W12_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")(lambda s, d: records.calls_in_window(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "recent"))
query("Q12_archive_months", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM events WHERE NOT ts < TIMESTAMP '2024-01-20'")(lambda s, d: (lambda a, k: a.groupBy("month").agg(F.count("*").alias("n")).unionByName(k.agg(F.count("*").alias("n")).select(F.lit("kept").alias("month"), "n")))(*records.split_archive(table(s, d, "events"), "ts", "2024-01-20")))
query("Q03_backtest_issues", "SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_discount IS NULL THEN 'missing_ic' END, CASE WHEN abs(l_discount) > 1 THEN 'ic_out_of_range' END, CASE WHEN l_quantity < 20 THEN 'too_few_dates' END, CASE WHEN abs(l_tax * 200) > 10 THEN 'icir_out_of_range' END, CASE WHEN l_discount * (0.04 - l_tax) < 0 THEN 'sign_disagreement' END], lambda x: x IS NOT NULL) AS issues FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.backtest_issues(F.col("l_discount"), F.col("l_tax") * 200, 0.04 - F.col("l_tax"), F.col("l_quantity")).alias("issues"))
)


# Phrases as formulas, further aggregates, and record checks.


# By hand: for each kind of phrase what it must become; {0} is the number in front of it.
_EXPECTED = {
    "日动量": "CASE WHEN n <= 30 THEN 'pct_change(close, ' || n || ')' ELSE 'pct_change(close, ' || n * 21 || ')' END",
    " 天 收益": "'pct_change(close, ' || n || ')'",
    "周波动": "'rolling_std(returns, ' || n || ')'",
    "日均线": "'rolling_mean(close, ' || n || ')'",
    " LOG price": "'log(close)'",
    "活跃度": "'volume'",
    "超额收益": "'returns - rolling_mean(returns, 252)'",
    " nothing": "NULL",
    "月动量": "CASE WHEN n IN (1, 11, 21, 31, 41, 51, 61) THEN 'pct_change(close, 21)' WHEN n % 10 = 3 THEN 'pct_change(close, 63)' WHEN n % 10 = 6 THEN 'pct_change(close, 126)' WHEN n % 100 = 12 THEN 'pct_change(close, 252)' WHEN n <= 30 THEN 'pct_change(close, ' || n || ')' ELSE 'pct_change(close, ' || n * 21 || ')' END",
    " 下行风险": "NULL",
}
_KINDS = list(_EXPECTED)
_FORMULA = "cs_rank(returns) - cs_rank(volume)"


@query(
    "F20_phrase_to_formula",
    "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN {_EXPECTED[k]}" for i, k in enumerate(_KINDS)) + f" WHEN 10 THEN '{_FORMULA}' END AS formula FROM (SELECT event_id, event_id % 70 AS n FROM events)",
)
def f20(spark, sf_dir):
    kind = F.col("event_id") % 12
    phrase = F.when(kind == 10, _FORMULA)
    for i, k in enumerate(_KINDS):
        phrase = phrase.when(kind == i, F.concat((F.col("event_id") % 70).cast("string"), F.lit(k)))
    return table(spark, sf_dir, "events").select("event_id", normalize.normalized(phrase).alias("formula"))


query("A25_call_cost", f"SELECT model, prompt, completion, round(prompt / 1e6 * i + completion / 1e6 * o, 6) AS cost FROM ({_PRICED})")(lambda s, d: _usage(s, d).select("model", "prompt", "completion", "cost"))
query("A32_dashboard", "SELECT c_mktsegment, max(abs(c_acctbal)) AS best, count(*) AS n FROM customer GROUP BY 1")(lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.max(F.abs("c_acctbal")).alias("best"), F.count("*").alias("n")))
query("J04_date_intersection", "SELECT DISTINCT o_orderdate::DATE AS date FROM orders INTERSECT SELECT DISTINCT l_shipdate::DATE FROM lineitem")(lambda s, d: table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).intersect(table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))))
query("T06_newest_first", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")(lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id"))
query("U06_add_papers", "SELECT CASE WHEN length(url) > 0 THEN url ELSE 'manual:' || substr(md5(page_id::VARCHAR), 1, 16) END AS paper_id, substr(html, 1, 2000) AS summary FROM pages")(lambda s, d: table(s, d, "pages").select(F.when(F.length("url") > 0, F.col("url")).otherwise(F.concat(F.lit("manual:"), F.substring(F.md5(F.col("page_id").cast("string")), 1, 16))).alias("paper_id"), F.substring("html", 1, 2000).alias("summary")))
query("U08_append_defaults", "SELECT conv_id, turn, coalesce(role, 'user') AS role, length(text)::INTEGER AS tokens, '' AS topic FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.length("text").alias("tokens"), F.lit("").alias("topic")))
query("Q10_compaction", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")(
    lambda s, d: table(s, d, "conversations").withColumns({"b": F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))), "f": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))}).where("b <= 6 or f = 1").select("conv_id", "turn", "role")
)
query("Q11_token_estimate", f"SELECT conv_id, (sum(len({_DUCK_TOKENS.replace('{0}', 'text')}) + 4) + 3)::BIGINT AS tokens FROM conversations GROUP BY 1")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg((F.sum(F.size(retrieval.tokens(F.col("text"))) + 4) + 3).alias("tokens")))
query("Q09_abstract_cut", "SELECT doc_id, CASE WHEN instr(lower(text), 'the ') > 0 THEN substr(text, instr(lower(text), 'the '), 1500) ELSE substr(text, 1, 1500) END AS abstract FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.instr(F.lower("text"), "the ") > 0, F.substring(F.col("text"), F.instr(F.lower("text"), "the "), F.lit(1500))).otherwise(F.substring("text", 1, 1500)).alias("abstract")))


# Retrieval as a whole, and the catalog of factors.

query("R15_retrieve", f"WITH {_BM25}, {_VECTORS}, {_RANK.format('bm')}, {_RANK.format('cos_')}, {_RRF} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM rrf JOIN documents ON doc_id = chunk_id WHERE lang = 'en' AND round(score, 9) >= 0.014 QUALIFY rank <= 5")(
    lambda s, d: rounded(retrieval.retrieve(*_index(s, d), top=5, min_score=0.014, keep=table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))))
)
query(
    "R13_rerank",
    f"WITH {_BM25}, {_VECTORS}, wide_bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 50), wide_cos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cos_ QUALIFY rank <= 50), "
    "fused AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, chunk_id FROM wide_bm UNION ALL SELECT query_id, chunk_id FROM wide_cos)) SELECT query_id, chunk_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, chunk_id)::INTEGER AS rank FROM fused JOIN documents ON doc_id = chunk_id QUALIFY rank <= 5",
)(lambda s, d: rounded(retrieval.retrieve(*_index(s, d), top=5, rerank=lambda c: c.drop("score").join(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score")), "chunk_id").select("query_id", "chunk_id", "score"))))
query("R20_filter_keys", "SELECT 'lang' AS key, array_to_string(list_sort(list(DISTINCT lang)), ',') AS found FROM documents UNION ALL SELECT 'source', array_to_string(list_sort(list(DISTINCT source)), ',') FROM documents")(lambda s, d: retrieval.filter_values(table(s, d, "documents"), ["lang", "source"]).withColumn("found", F.array_join("found", ",")))
query("R08_l2", "SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(-list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 6) + 0.0 AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(-list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 9) DESC, e.vec_id)::INTEGER AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5")(
    lambda s, d: (lambda v: rounded(retrieval.dense_top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 5, metric="l2")))(table(s, d, "embeddings"))
)

_NAMED = "CASE id % 9 WHEN 0 THEN 'Return_3M adjusted' WHEN 1 THEN '1月动量强度' WHEN 2 THEN 'roe' WHEN 3 THEN 'my factor' WHEN 4 THEN '' WHEN 5 THEN '盈利' WHEN 6 THEN 'turnover' WHEN 7 THEN 'ReturnX' ELSE 'momentum of news' END"
_NEEDED = "CASE id % 5 WHEN 0 THEN '毛利率' WHEN 1 THEN '净利润增长, 新闻' WHEN 2 THEN 'LLM scores' ELSE '' END"


@query(
    "B08_feasibility",
    # By hand: names decide first, then aliases; those of three letters or fewer count in names only.
    f"""SELECT id, match IS NOT NULL AS feasible, match AS matching_factor, multimodal FROM (SELECT id, id % 5 IN (1, 2) AS multimodal,
  CASE id % 9 WHEN 0 THEN 'return_3m' WHEN 1 THEN 'return_1m' WHEN 2 THEN 'ROE' WHEN 6 THEN 'turnover_1m' WHEN 8 THEN 'return_1m' ELSE CASE WHEN id % 5 = 1 THEN 'profit_growth_yoy' END END AS match FROM (SELECT o_orderkey AS id FROM orders))""",
)
def b08(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select("id", F.expr(_NAMED).alias("factor_name"), F.expr(_NEEDED).alias("data_needed"), F.lit("").alias("definition"))
    return catalog.feasibility(wanted).select("id", "feasible", "matching_factor", "multimodal")


query("B06_catalog", "SELECT * FROM (VALUES ('momentum', 5), ('quality', 3), ('efficiency', 1), ('growth', 2)) t(category, n)")(lambda s, d: catalog.catalog(s).groupBy("category").agg(F.count("*").cast("int").alias("n")))
query("U06_new_papers", "SELECT CASE WHEN length(url) > 0 THEN url ELSE 'manual:' || substr(md5(page_id::VARCHAR), 1, 16) END AS paper_id, substr(html, 1, 2000) AS summary, CASE WHEN page_id % 3 = 0 THEN 'read' ELSE 'new' END AS status FROM pages QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY page_id % 3 <> 0, page_id) = 1")(
    lambda s, d: (lambda p: records.add_papers(records.first_by(p.where("page_id % 3 = 0").withColumn("status", F.lit("read")), ["paper_id"], [F.col("page_id")]).select("paper_id", "summary", "status"), p.where("page_id % 3 <> 0").withColumnRenamed("page_id", "place")))(
        table(s, d, "pages").select("page_id", F.when(F.length("url") > 0, F.col("url")).otherwise(F.concat(F.lit("manual:"), F.substring(F.md5(F.col("page_id").cast("string")), 1, 16))).alias("paper_id"), F.substring("html", 1, 2000).alias("summary"))
    )
)
