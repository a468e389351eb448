"""Queries of retrieval: full text, vectors, fusion, thresholds, routing, reranking, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import corpus, retrieval
from quillmere.session import table

QUERY = "memory leak in the cache server"
TERMS = "('memory'), ('leak'), ('in'), ('the'), ('cache'), ('server')"


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks with a usable vector, once each."""
    rows = table(spark, base, "indexing_chunks").filter(F.size("vector") == 64).select("vec_id", "vector", "text", "indexed_at", "source_path", "section", "chunk_kind")
    return corpus.latest(rows, "vec_id")


def _query_vector(spark: SparkSession, base: str) -> list[float]:
    return table(spark, base, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def fts_bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    hits = retrieval.bm25(docs, "doc_id", "text", QUERY, 20)
    return hits.select("doc_id", F.round("score", 6).alias("score"), "rank")


def _bm25_sql(source: str, key: str, text: str, limit: int) -> str:
    return f"""
    tok AS (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source} WHERE {text} IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    q AS (SELECT * FROM (VALUES {TERMS}) AS v(term)),
    tf AS (SELECT t.{key}, q.term, len(list_filter(t.w, lambda x: x = q.term)) AS tf, len(t.w) AS dl FROM tok t CROSS JOIN q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    sc AS (SELECT tf.{key}, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / st.avgdl))), 9) AS score
           FROM tf JOIN df USING (term) CROSS JOIN st WHERE tf.tf > 0 GROUP BY tf.{key}),
    fts AS (SELECT {key}, score, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM sc QUALIFY rank <= {limit})"""


def fts_bm25_batch(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "eval_items").select("item_id", F.element_at(F.split("text", "\n"), -1).alias("question"))
    hits = retrieval.bm25_batch(table(spark, base, "documents"), "doc_id", "text", items, "item_id", "question", 5)
    return hits.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vector_l2_topk(spark: SparkSession, base: str) -> DataFrame:
    hits = retrieval.nearest(_chunks(spark, base), "vec_id", "vector", _query_vector(spark, base), 20)
    return hits.select("vec_id", F.round("distance", 5).alias("distance"), "rank")


_CHUNKS_SQL = """
    ch AS (SELECT vec_id, vector, text FROM indexing_chunks WHERE len(vector) = 64
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY indexed_at DESC NULLS LAST) = 1),
    qv AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: (vector[i]::DOUBLE - e[i]::DOUBLE) ** 2)) AS distance FROM ch CROSS JOIN qv),
    near AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d
             WHERE distance IS NOT NULL AND NOT isnan(distance) QUALIFY rank <= 20)"""


def hybrid_rrf_topk(spark: SparkSession, base: str) -> DataFrame:
    rows = _chunks(spark, base)
    hits = retrieval.fuse([retrieval.nearest(rows, "vec_id", "vector", _query_vector(spark, base), 20), retrieval.bm25(rows, "vec_id", "text", QUERY, 20)], "vec_id", 20)
    return hits.select("vec_id", F.round("score", 6).alias("score"), "rank", "rank_0", "rank_1")


_RRF_SQL = f"""WITH {_CHUNKS_SQL}, {_bm25_sql("ch", "vec_id", "text", 20)},
    rrf AS (SELECT coalesce(n.vec_id, f.vec_id) AS vec_id, coalesce(1.0 / (59 + n.rank), 0) + coalesce(1.0 / (59 + f.rank), 0) AS s, n.rank AS rank_0, f.rank AS rank_1
            FROM near n FULL JOIN fts f ON n.vec_id = f.vec_id),
    top AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, rank_0, rank_1 FROM rrf QUALIFY rank <= 20)"""


def hybrid_thresholds(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.above(hybrid_rrf_topk(spark, base), min_score=0.015).filter("rank <= 10").select("vec_id", "score", "rank")


def batch_query_routing(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "eval_items").select(F.element_at(F.split("text", "\n"), -1).alias("query"))
    literal = spark.createDataFrame([("",), ("[[EN/Index]]",), ("notes about paths.md",), ("UA/Home",), ('"exact words"',), ("how does a relate to b",), ("GROBID setup",), ("compare a and b",), ("what is between x and y",), ("plain words here please",), ("SHORT",), ("the `code` here",)], "query string")
    return items.unionByName(literal).distinct().select("query", X.route(F.col("query")).alias("mode"))


def llm_rerank_parse(spark: SparkSession, base: str) -> DataFrame:
    replies = spark.createDataFrame([(1, "85"), (2, "Score: 40 of 100"), (3, "-5"), (4, "250"), (5, "none"), (6, None), (7, "7/10"), (8, "85")], "id int, reply string")
    return retrieval.rerank_by_replies(replies, "id", "reply", 6).select("id", "score", "rank")


def memory_recall(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").filter(F.lower(F.trim("source")) == "memory")
    memories = docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("s"), "doc_id").alias("session_id"), F.coalesce("title", F.lit("")).alias("query"), F.col("text").alias("summary"), F.lit("").alias("final_answer"))
    return corpus.recall(memories, QUERY, 10)


def search_routed(spark: SparkSession, base: str) -> DataFrame:
    hits, _, _ = retrieval.search(_chunks(spark, base), "vec_id", "text", "vector", QUERY, _query_vector(spark, base), mode="auto", reranker="rrf", k=5)
    return hits.select("vec_id", F.round("score", 6).alias("score"), "rank", "snippet")


def search_degraded(spark: SparkSession, base: str) -> DataFrame:
    """A hybrid search without a query vector runs as full text."""
    hits, _, _ = retrieval.search(_chunks(spark, base), "vec_id", "text", "vector", QUERY, None, mode="hybrid", k=5)
    return hits.select("vec_id", F.round("score", 6).alias("score"), "rank")


def embedded_texts(spark: SparkSession, base: str) -> DataFrame:
    rows = corpus.embed(table(spark, base, "chunking_blocks").select("block_id", "text"), "text", corpus.hashed_embedder(16))
    return rows.select("block_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


QUERIES = {f.__name__: f for f in (fts_bm25_topk, fts_bm25_batch, vector_l2_topk, hybrid_rrf_topk, hybrid_thresholds, batch_query_routing, llm_rerank_parse, memory_recall, search_routed, search_degraded, embedded_texts)}

SQL = {
    "fts_bm25_topk": f"WITH {_bm25_sql('documents', 'doc_id', 'text', 20)} SELECT doc_id, round(score, 6) AS score, rank FROM fts",
    "fts_bm25_batch": r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
 st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(string_split(text, chr(10))[-1]), '[\p{L}\p{N}_]+')) AS term FROM eval_items),
 post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 sc AS (SELECT q.item_id, p.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.avgdl))), 9) AS score
        FROM q JOIN post p USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5""",
    "vector_l2_topk": f"WITH {_CHUNKS_SQL} SELECT vec_id, round(distance, 5) AS distance, rank FROM near",
    "hybrid_rrf_topk": f"{_RRF_SQL} SELECT vec_id, round(s, 6) AS score, rank, rank_0, rank_1 FROM top",
    "hybrid_thresholds": f"{_RRF_SQL} SELECT vec_id, round(s, 6) AS score, rank FROM top WHERE round(s, 6) >= 0.015 AND rank <= 10",
    "batch_query_routing": r"""
WITH q AS (SELECT string_split(text, chr(10))[-1] AS query FROM eval_items
  UNION SELECT * FROM (VALUES (''), ('[[EN/Index]]'), ('notes about paths.md'), ('UA/Home'), ('"exact words"'), ('how does a relate to b'), ('GROBID setup'), ('compare a and b'), ('what is between x and y'), ('plain words here please'), ('SHORT'), ('the `code` here')) v(query))
SELECT query, CASE WHEN trim(query) = '' THEN 'hybrid'
  WHEN regexp_matches(query, '\[\[[^\]]+\]\]') OR regexp_matches(query, '\b[^\s/]+\.(md|pdf)\b') OR regexp_matches(query, '(^|[\s(])(UA|EN)/\S+')
    OR regexp_matches(query, '"[^"]+"') OR regexp_matches(query, '''[^'']+''') OR regexp_matches(query, '`[^`]+`') THEN 'fts'
  WHEN regexp_matches(query, '(?i)\b(related|relationship|connect|connected|connection|path|depend|depends|compare|versus|vs|shared|common|bridge|difference between)\b')
    OR regexp_matches(query, '(?i)\bbetween\b.+\band\b') OR regexp_matches(query, '(?i)\bhow .* relate') THEN 'hybrid-graph'
  WHEN len(regexp_split_to_array(trim(query), '\s+')) <= 3 AND regexp_matches(query, '\b[A-Z0-9_-]{4,}\b') THEN 'fts' ELSE 'hybrid' END AS mode FROM q""",
    "llm_rerank_parse": r"""
WITH r(id, reply) AS (VALUES (1, '85'), (2, 'Score: 40 of 100'), (3, '-5'), (4, '250'), (5, 'none'), (6, NULL), (7, '7/10'), (8, '85')),
 s AS (SELECT id, CASE WHEN regexp_matches(reply, '\d') THEN greatest(0.0, least(100.0, regexp_extract(reply, '(-?\d+)', 1)::DOUBLE)) / 100 ELSE 0.0 END AS score FROM r)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 6""",
    "memory_recall": r"""
WITH m AS (SELECT doc_id AS seq, 's' || doc_id AS session_id, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || text || '  s' || doc_id), '[a-z0-9_]{3,}')) AS t
           FROM documents WHERE lower(trim(source)) = 'memory'),
 o AS (SELECT seq, session_id, len(list_filter(t, lambda x: x IN ('memory', 'leak', 'the', 'cache', 'server'))) AS overlap FROM m)
SELECT session_id, overlap, row_number() OVER (ORDER BY overlap DESC, seq) AS rank FROM o WHERE overlap > 0 QUALIFY rank <= 10""",
    "search_routed": rf"""{_RRF_SQL}, fl AS (SELECT vec_id, regexp_replace(regexp_replace(text, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') AS f FROM ch)
SELECT vec_id, round(s, 6) AS score, rank, CASE WHEN length(f) > 320 THEN regexp_replace(f[1:317], ' +$', '') || '...' ELSE f END AS snippet FROM top JOIN fl USING (vec_id) WHERE rank <= 5""",
    "search_degraded": f"WITH {_CHUNKS_SQL}, {_bm25_sql('ch', 'vec_id', 'text', 5)} SELECT vec_id, round(score, 6) AS score, rank FROM fts",
}
