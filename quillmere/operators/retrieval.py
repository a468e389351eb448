"""Ranked retrieval: BM25 full-text search, exact nearest vectors, rank fusion, thresholds, reranking.

A single query never explodes the corpus: term counts come from higher-order functions in one pass, the corpus
statistics from an aggregate of one row, and the top rows from TakeOrderedAndProject. Batches of queries go through a
postings table, grouped by document and term before it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import graph as G

#: Named constants of the ranking functions.
K1, B = 1.2, 0.75
RRF_K = 60


def _squared_distance(a: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(a, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda t: t == term


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """Documents with a term of the query: id, score, rank (1..k; ties by id). Null texts match nothing. Scores are
    rounded to nine places, so that the order of sums does not part equal ones."""
    terms = _terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    tokens = X.words(F.col(text_col))
    counts = [F.size(F.filter("tokens", _equals(q))).alias(f"tf{i}") for i, q in enumerate(terms)]
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, tokens.alias("tokens")).select(id_col, F.size("tokens").alias("dl"), *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    scored = rows.filter(hit).join(F.broadcast(stats)).select(id_col, F.round(score, 9).alias("score"))  # stats is one row
    return ranked(scored, id_col, F.desc("score"), k)


def ranked(rows: DataFrame, id_col: str, order: Column, k: int | None) -> DataFrame:
    """The first k rows by `order` and id, with their rank."""
    if k is None:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(order, id_col)))
    return rows.orderBy(order, id_col).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(order, id_col)))


def postings(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The full-text index: postings (term, id, tf) and lengths (id, dl)."""
    tokens = docs.filter(F.col(text_col).isNotNull()).select(id_col, X.words(F.col(text_col)).alias("tokens"))
    return tokens.select(id_col, F.explode("tokens").alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf")), tokens.select(id_col, F.size("tokens").alias("dl"))


def bm25_stored(spark: SparkSession, index: str, query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The same as `bm25`, from a stored index (`corpus.write_chunks`): id, score, rank. Of the postings only the row groups
    of the query's terms are read, and no text."""
    terms = _terms(query)
    post = spark.read.parquet(f"{index}/postings").filter(F.col("term").isin(terms) if terms else F.lit(False))
    lengths = spark.read.parquet(f"{index}/lengths")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    hit = post.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(stats))  # a row a term of the query; one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return ranked(hit.groupBy("id").agg(F.round(F.sum(part), 9).alias("score")), "id", F.desc("score"), k)


def _terms(query: str) -> list[str]:
    """A query's different terms, as `text.words` takes them."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def bm25_batch(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int, k1: float = K1, b: float = B, most_broadcast: int = 1_000_000) -> DataFrame:
    """BM25 for many queries: query_id, id, score, rank. Only postings of the queries' terms are counted. Up to
    `most_broadcast` of those terms go to the documents; more are joined by shuffles."""
    asked = queries.select(query_id, F.explode(F.array_distinct(X.words(F.col(query_text)))).alias("term"))
    tokens = docs.filter(F.col(text_col).isNotNull()).select(id_col, X.words(F.col(text_col)).alias("tokens"))
    sized = tokens.select(id_col, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    post = sized.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", id_col, "dl").agg(F.count("*").alias("tf"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weighed = post.join(df, "term").join(F.broadcast(stats))  # stats is one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # whole documents lie together, so that sums and the first k of a partition come before any shuffle of query times document
    placed = weighed.select("term", id_col, part.alias("part")).repartition(id_col)
    sent = F.broadcast(asked) if asked.limit(most_broadcast + 1).count() <= most_broadcast else asked
    scored = placed.join(sent, "term").groupBy(query_id, id_col).agg(F.round(F.sum("part"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, id_col: str, vector_col: str, query: list[float], k: int | None) -> DataFrame:
    """The k nearest vectors by squared L2 distance: id, distance, rank. Null vectors and other lengths take no part."""
    usable = rows.filter(F.size(vector_col) == len(query)).select(id_col, _squared_distance(F.col(vector_col), query).alias("distance")).filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return ranked(usable, id_col, F.asc("distance"), k)


def fuse(lists: list[DataFrame], id_col: str, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with id and rank (from 1): id, score, rank, and each list's rank (null if absent)."""
    out = None
    for i, hits in enumerate(lists):
        part = hits.select(id_col, F.col("rank").alias(f"rank_{i}"))
        out = part if out is None else out.join(part, id_col, "full")
    score = sum((F.coalesce(1.0 / (F.col(f"rank_{i}") - 1 + constant), F.lit(0.0)) for i in range(len(lists))), F.lit(0.0))
    return ranked(out.withColumn("score", score), id_col, F.desc("score"), k)


def above(hits: DataFrame, min_score: float | None = None, max_distance: float | None = None, score: str = "score", distance: str = "distance") -> DataFrame:
    """Hits within the thresholds. A null score or distance passes. This is a filter after the limit, by intent."""
    keep = F.lit(True)
    if min_score is not None and score in hits.columns:
        keep = keep & (F.col(score).isNull() | (F.col(score) >= min_score))
    if max_distance is not None and distance in hits.columns:
        keep = keep & (F.col(distance).isNull() | (F.col(distance) <= max_distance))
    return hits.filter(keep)


def rerank(hits: DataFrame, id_col: str, text_col: str, scorer: Callable[[list[str]], list[float]], k: int) -> DataFrame:
    """Hits in the order of a scorer of texts (a cross-encoder, say), which runs on batches on the workers."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(x) for x in scorer(batch.fillna("").tolist())])

    score = F.pandas_udf(run, "double")
    return ranked(hits.drop("score", "rank").withColumn("score", score(F.col(text_col))), id_col, F.desc("score"), k)


def rerank_by_replies(hits: DataFrame, id_col: str, reply_col: str, k: int) -> DataFrame:
    """Hits in the order of the scores in a model's replies."""
    return ranked(hits.drop("score", "rank").withColumn("score", X.reply_score(F.col(reply_col))), id_col, F.desc("score"), k)


def check_search(mode: str, reranker: str, k: int, fetch_k: int, min_score: float | None, max_distance: float | None) -> None:
    """Raise ValueError on settings that contradict each other."""
    if k <= 0 or fetch_k < k:
        raise ValueError("k must be positive and fetch_k at least k")
    if mode not in ("vector", "fts", "hybrid", "hybrid-graph", "auto"):
        raise ValueError(f"unknown mode {mode}")
    if reranker not in ("none", "rrf", "cross-encoder", "llm"):
        raise ValueError(f"unknown reranker {reranker}")
    if reranker == "rrf" and mode not in ("hybrid", "hybrid-graph", "auto"):
        raise ValueError("rrf needs a hybrid mode")
    if min_score is not None and not 0 <= min_score <= 1:
        raise ValueError("min_score must lie in [0, 1]")
    if max_distance is not None and max_distance < 0:
        raise ValueError("max_distance must not be negative")


def search(rows: DataFrame, id_col: str, text_col: str, vector_col: str, query: str, query_vector: list[float] | None = None, mode: str = "auto", reranker: str = "none", k: int = 5, fetch_k: int = 20, min_score: float | None = None, max_distance: float | None = None, scorer: Callable[[list[str]], list[float]] | None = None, snippet_chars: int = 320, replier: Callable[[list[str]], list[str]] | None = None, graph: tuple[DataFrame, DataFrame] | None = None, path_col: str = "source_path", hops: int = 2, governed: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], str]:
    """A search as users run it: hits (id, score and/or distance, rank, snippet), warnings, and the mode that ran.

    `auto` routes by the query's form. Without a query vector a vector or hybrid search falls back to full text; without
    a scorer the cross-encoder falls back to rank fusion or none, without a replier (texts to a model's replies) the llm
    to none, and without a graph (its edges and domains) hybrid-graph to hybrid. Thresholds apply after ranking and before
    the graph and the cut to k. With the graph, the notes of `path_col` around the first three hits' notes add to the hits'
    scores and enter themselves, with a null id; hits then have source_path and origin, too.
    """
    check_search(mode, reranker, k, fetch_k, min_score, max_distance)
    warnings: list[str] = []
    if mode == "auto":
        mode = rows.sparkSession.range(1).select(X.route(F.lit(query)).alias("m")).first().m
    if mode == "hybrid-graph" and (graph is None or path_col not in rows.columns):
        warnings.append("no graph: hybrid search instead")
        mode = "hybrid"
    base = "hybrid" if mode == "hybrid-graph" else mode
    if base in ("vector", "hybrid") and query_vector is None:
        warnings.append("no query vector: full-text search instead")
        base = "fts"
    if reranker == "cross-encoder" and scorer is None:
        warnings.append("no scorer: reranking skipped")
        reranker = "none"
    if reranker == "llm" and replier is None:
        warnings.append("no replier: reranking skipped")
        reranker = "none"
    if reranker == "rrf" and base != "hybrid":
        reranker = "none"
    depth = fetch_k if base == "hybrid" or reranker != "none" or mode == "hybrid-graph" else k
    if base == "vector":
        hits = nearest(rows, id_col, vector_col, query_vector, depth)
    elif base == "fts":
        hits = bm25(rows, id_col, text_col, query, depth)
    else:
        hits = fuse([nearest(rows, id_col, vector_col, query_vector, depth), bm25(rows, id_col, text_col, query, depth)], id_col, depth)
    if reranker == "cross-encoder":
        hits = rerank(hits.join(rows.select(id_col, text_col), id_col), id_col, text_col, scorer, depth).drop(text_col)
    if reranker == "llm":
        hits = rerank_by_replies(hits.join(rows.select(id_col, text_col), id_col).withColumn("_reply", _replies(replier)(F.col(text_col))).drop(text_col), id_col, "_reply", depth).drop("_reply")
    kept = above(hits, min_score, max_distance)
    order = F.asc("rank")
    if mode == "hybrid-graph":
        merged = _with_graph(kept, rows, graph, id_col, path_col, k, max(fetch_k, k), hops, governed)
        return merged.join(rows.select(id_col, X.snippet(F.col(text_col), snippet_chars).alias("snippet")), id_col, "left").orderBy(order), warnings, mode
    top = ranked(kept.withColumnRenamed("rank", "_rank"), id_col, F.asc("_rank"), k).drop("_rank")
    return top.join(rows.select(id_col, X.snippet(F.col(text_col), snippet_chars).alias("snippet")), id_col).orderBy(order), warnings, mode


def _replies(replier: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(replier(batch.fillna("").tolist()), dtype="object")

    return F.pandas_udf(run, "string")


def base_score(hits: DataFrame, total: int) -> Column:
    """A hit's score, else 1 / (1 + distance), else its rank as a share of `total`, the first rank 1."""
    ladder = [F.col("score")] if "score" in hits.columns else []
    ladder += [1 / (1 + F.col("distance"))] if "distance" in hits.columns else []
    return F.coalesce(*ladder, F.greatest(F.lit(total) - F.col("rank") + 1, F.lit(1)) / F.lit(max(1, total)))


def _with_graph(hits: DataFrame, rows: DataFrame, graph: tuple[DataFrame, DataFrame], id_col: str, path_col: str, k: int, limit: int, hops: int, governed: tuple[str, ...] = ()) -> DataFrame:
    """Hits merged with the notes around the notes of the first of them: id, score, rank, source_path, origin. Files named
    `governed` seed nothing unless all of the first hits are such."""
    placed = hits.join(rows.select(id_col, F.col(path_col).alias("source_path")), id_col).select(id_col, "source_path", base_score(hits, limit).alias("score"), "rank")
    ruled = F.regexp_extract("source_path", r"([^/]*)$", 1).isin(*governed) if governed else F.lit(False)
    noted = placed.filter("source_path IS NOT NULL").groupBy("source_path").agg(F.min("rank").alias("rank")).withColumn("ruled", ruled)
    # the others come first, and only if there is none the governed ones count, two at most
    order = F.row_number().over(Window.orderBy("ruled", "rank"))
    seeds = noted.withColumn("n", order).withColumn("free", F.max(~F.col("ruled")).over(Window.partitionBy())).filter(F.when(F.col("free"), ~F.col("ruled") & (F.col("n") <= min(k, 3))).otherwise(F.col("n") <= min(k, 2)))
    boosts = G.expand(*graph, seeds.select(F.concat(F.lit("note::"), "source_path").alias("id")), hops, limit)
    return G.merge(placed, boosts, k).select(id_col, F.col("combined").alias("score"), "rank", "source_path", "origin")


def degrade(attempts: list[tuple[str, Callable[[], DataFrame]]], most: int = 10_000) -> tuple[list, list[str]]:
    """Up to `most` rows of the first attempt whose action succeeds, and a warning for each that failed. As plans are lazy, the
    action itself is inside the guard."""
    warnings = []
    for name, make in attempts:
        try:
            return make().limit(most).collect(), warnings
        except Exception as e:  # noqa: BLE001
            warnings.append(f"{name} failed: {type(e).__name__}")
    return [], warnings
