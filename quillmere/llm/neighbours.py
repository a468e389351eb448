"""Problem 2: for every vector the k most similar vectors by cosine, within a small loss.

Method: multi-index hashing. Rotations learned on a bounded sample (iterative quantisation) turn each vector
into a binary code of `tables` substrings; a substring grows with the logarithm of the row count, so buckets
keep their size. Each substring is an index of its own. Probing all substrings within `flips` bits retrieves,
by the pigeonhole principle, every code within a Hamming radius of `tables * (flips + 1) - 1`, and most codes
somewhat beyond it; what is retrieved, and differs in at most a share `radius` of its bits, is reranked by its floats,
which travel with the codes so that no pair has to fetch them.

A table of up to `part_rows` rows is one part. A larger one is parted by the pigeonhole principle again: of `flips` + 1
stretches of a substring two codes within `flips` bits share at least one, so a vector goes to the part of each of
its stretches' values, `flips` + 1 copies a table at any size. A pair is reranked in the first table and part that
retrieve it only.

Equal vectors of different ids are compared once, by the smallest id; each of them then has its copies, those with
the smallest ids, as neighbours, and shares what the one has found. Vectors for which fewer than k are found within the
radius are compared with all others, `block_rows` of them at a time; so each vector has k neighbours if there are k others.

Defined results: vectors that are null, of another length, all zero or with a value that is null or not finite
take no part; rows of the same id and vector count once, and an id with several vectors is as near as its
nearest; of equally near vectors those with the smaller ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmere.session import cut, table

CHUNK = 1_000_000


def rotations(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Projections for `bits` bits: as many learned rotations of the space as that takes, side by side."""
    dim, rng, out = sample.shape[1], np.random.default_rng(seed), []
    axes = np.linalg.svd(sample, full_matrices=False)[2].T if len(sample) >= dim else np.eye(dim)
    v = sample @ axes
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) else 0):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = left @ right
        out.append(axes @ r)
    return np.concatenate(out, 1)[:, :bits].astype(np.float32)


def substrings(x: np.ndarray, projections: np.ndarray, tables: int) -> np.ndarray:
    """The code of each vector as one unsigned integer for each table."""
    bits = (x @ projections >= 0).reshape(len(x), tables, -1)
    return (bits * (1 << np.arange(bits.shape[2], dtype=np.uint32))).sum(2, dtype=np.uint32)


def usable(values: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors of flattened lists of `dim` values."""
    x = values.reshape(-1, dim)
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _masks(bits: list[int], flips: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(bits, n)]


def stretches(width: int, n: int) -> list[tuple[int, int]]:
    """A substring's bits in n stretches: first bit and number of bits."""
    edges = [width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _pairs(buckets: np.ndarray, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (positions) whose buckets differ by one of the masks, each pair once."""
    order = np.argsort(buckets, kind="stable")
    named, first, count = np.unique(buckets[order], return_index=True, return_counts=True)
    for mask in masks:
        there = named ^ np.uint32(mask)
        to = np.searchsorted(named, there)
        hit = np.flatnonzero((to < len(named)) & (there >= named))
        hit = hit[named[to[hit]] == there[hit]]
        sizes = count[hit] * count[to[hit]]
        start = 0
        while start < len(hit):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK, side="right")))
            a, b, wide = first[hit[start:end]], first[to[hit[start:end]]], count[to[hit[start:end]]]
            total = int(sizes[start:end].sum())
            for at in range(0, total, CHUNK):  # one pair of very full buckets goes in blocks
                k = np.arange(at, min(total, at + CHUNK))
                ends = np.cumsum(sizes[start:end])
                of = np.searchsorted(ends, k, side="right")
                k -= (ends - sizes[start:end])[of]
                i, j = order[a[of] + k // wide[of]], order[b[of] + k % wide[of]]
                if mask == 0:
                    i, j = i[i < j], j[i < j]
                yield i, j
            start = end


def first_k(a: np.ndarray, b: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row a those of its candidates b, with similarities s, that hold the k different ids nearest to it; `once`:
    of each id the nearest only."""
    order = np.lexsort((ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    twice = np.lexsort((np.arange(len(a)), ids[b], a))  # an id's vectors one after another, the nearest first
    again = np.zeros(len(a), bool)
    again[twice[1:]] = (a[twice][1:] == a[twice][:-1]) & (ids[b[twice]][1:] == ids[b[twice]][:-1])
    seen = np.cumsum(~again)
    keep = seen - np.where(again, 0, 1) - np.concatenate([[0], seen])[np.searchsorted(a, a)] < k
    if once:
        keep &= ~again
    return a[keep], b[keep], s[keep]


def nearest_in_part(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, which: int, stretch: int, spans: list[tuple[int, int]], flips: int, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One part of one table: for each row its nearest among the pairs that this part is the first to retrieve, and their
    similarities less 1. `spans` are the stretches by which the table is parted, `stretch` this part's; none if the table is whole."""
    width = sum(n for _, n in spans)
    own = range(0) if len(spans) == 1 else range(spans[stretch][0], sum(spans[stretch]))
    before = [np.uint32(((1 << n) - 1) << at) for at, n in spans[:stretch]]
    best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
    fresh: list[tuple] = []
    held = 0
    for i, j in _pairs(codes[:, which], _masks([b for b in range(width) if b not in own], flips)):
        differ = codes[i] ^ codes[j]
        apart = np.bitwise_count(differ)
        ok = apart.sum(1) <= radius
        if which:
            ok &= (apart[:, :which] > flips).all(1)
        for mask in before:
            ok &= differ[:, which] & mask != 0
        i, j = i[ok], j[ok]
        if len(i):
            s = x[i] - x[j]  # from differences, as near vectors' products all round to 1
            s = np.einsum("nd,nd->n", s, s) * np.float32(-0.5)
            fresh.append((np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])))
            held += len(i)
            if held > 2 * CHUNK:
                best, fresh, held = list(first_k(*(np.concatenate([best[c], *[f[c] for f in fresh]]) for c in range(3)), ids, k)), [], 0
    return first_k(*(np.concatenate([best[c], *[f[c] for f in fresh]]) for c in range(3)), ids, k)


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, tables: int = 5, flips: int = 2, radius: float = 0.30, train_rows: int = 20_000, part_rows: int = 400_000, block_rows: int = 20_000, most_broadcast: int = 100_000) -> DataFrame:
    """The k nearest of every vector: id, other, similarity, rank (1..k). `radius` is the largest share of
    differing bits at which a retrieved pair is reranked; at most twice `train_rows` vectors learn the rotations."""
    array = df.schema[vector_col].dataType
    vector = F.col(vector_col) if isinstance(array, T.ArrayType) else F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & (F.size("vector") == dim))
    many = rows.select("id").count()
    rows = rows.filter(F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)).withColumn("h", F.xxhash64("vector"))
    width = min(29, max(4, math.ceil(math.log2(max(2, many))) - 1))
    spans = stretches(width, flips + 1 if many > part_rows else 1)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, many))) < train_rows).limit(2 * train_rows).select("vector").toArrow().column(0).combine_chunks()
    project = df.sparkSession.sparkContext.broadcast(rotations(usable(_values(sample), dim), tables * width))

    # equal vectors of several ids: the smallest id stands for them
    different = rows.select("h", "id").distinct()
    copies = cut(different.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1"))
    copied = copies.count()
    sent = F.broadcast(copies) if copied <= most_broadcast else copies
    single = rows.join(sent.select("h", "least"), "h", "left").filter("least IS NULL OR least = id").select("id", "h", "vector") if copied else rows.select("id", "h", "vector")
    record = np.dtype([("id", "<i8"), ("h", "<i8"), ("x", "<f4", (dim,))])

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            own = np.zeros(len(batch), record)
            own["id"], own["h"], own["x"] = np.asarray(batch.column(0)), np.asarray(batch.column(1)), usable(_values(batch.column(2)), dim)
            _, first = np.unique(own.view(f"V{record.itemsize}"), return_index=True)
            own = own[first]  # rows that are repeated
            codes = substrings(own["x"], project.value, tables)
            parts, bodies = [], []
            for j in range(tables):
                for g, (at, n) in enumerate(spans):
                    value = (codes[:, j] >> np.uint32(at)) & np.uint32((1 << n) - 1) if len(spans) > 1 else np.zeros(len(own), np.uint32)
                    order = np.argsort(value, kind="stable")
                    named, start = np.unique(value[order], return_index=True)
                    for v, rows_ in zip(named.tolist(), np.split(order, start[1:]), strict=True):
                        parts.append(part_number(j, g, v))
                        bodies.append(own[rows_].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], ["part", "body"])

    sizes = [1 << n if len(spans) > 1 else 1 for _, n in spans]

    def part_number(j: int, g: int, v: int) -> int:
        return j * sum(sizes) + sum(sizes[:g]) + v

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, body in zip(batch["part"].tolist(), batch["body"], strict=True):
                held.setdefault(part, []).append(body)
        for part in list(held):
            own = np.frombuffer(b"".join(held.pop(part)), record)
            _, first = np.unique(own.view(f"V{record.itemsize}"), return_index=True)
            own = own[first]
            which, at = divmod(part, sum(sizes))
            g = int(np.searchsorted(np.cumsum(sizes), at, side="right"))
            x = np.ascontiguousarray(own["x"])
            a, b, s = nearest_in_part(own["id"], x, substrings(x, project.value, tables), which, g, spans, flips, k, int(radius * tables * width))
            differ = own["id"][a] != own["id"][b]
            a, b, s = a[differ], b[differ], 1 + s[differ].astype(np.float64)
            yield pd.DataFrame({"h": own["h"][a], "id": own["id"][a], "other_h": own["h"][b], "other": pd.array(own["id"][b], "Int64"), "similarity": pd.array(s, "Float64")})
            if which == g == 0:  # each row is in one part of these: it is there, with or without neighbours
                yield pd.DataFrame({"h": own["h"], "id": own["id"], "other_h": np.int64(0), "other": pd.array([None] * len(own), "Int64"), "similarity": pd.array([None] * len(own), "Float64")})

    total = tables * sum(sizes)
    found = single.mapInArrow(place, "part int, body binary").repartitionById(total, F.col("part")).mapInPandas(probe, "h bigint, id bigint, other_h bigint, other bigint, similarity double")
    near = _with_copies(found, copies, different, k) if copied else found
    nearest = near.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    everyone = Window.partitionBy("id")
    rank = F.row_number().over(everyone.orderBy(F.desc_nulls_last("similarity"), "other"))
    ranked = cut(nearest.withColumn("n", F.count("other").over(everyone)).withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("other").isNotNull() | (F.col("n") == 0))))
    short = ranked.filter(F.col("n") < k).select("id").distinct()
    missing = short.count()
    enough = ranked.filter("other IS NOT NULL").select("id", "other", "similarity", "rank")
    if not missing:
        return enough
    return enough.join(short, "id", "left_anti").unionByName(_by_brute_force(rows, short, missing, k, dim, block_rows))


def _with_copies(found: DataFrame, copies: DataFrame, different: DataFrame, k: int) -> DataFrame:
    """What the representatives of equal vectors found, for all of them: id, other, similarity."""
    first = different.join(copies.select("h"), "h").withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("at") <= k + 1)
    firsts = first.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1
    some = copies.join(firsts, "h").select("h", "n", "ids")
    few = some.filter(F.col("n") <= k)  # others have k copies, so what else is near takes no rank
    left = found.join(few.select("h", F.col("ids").alias("own")), "h", "left").join(some.filter(F.col("n") > k).select("h"), "h", "left_anti")
    right = left.join(some.select(F.col("h").alias("other_h"), F.col("ids").alias("others")), "other_h", "left")
    wide = right.select(F.explode(F.coalesce("own", F.array("id"))).alias("id"), F.when(F.col("other").isNotNull(), F.coalesce("others", F.array("other"))).otherwise(F.array(F.lit(None).cast("bigint"))).alias("others"), "similarity")
    apart = wide.select("id", F.explode("others").alias("other"), "similarity").filter("other IS NULL OR id != other")
    among = different.join(some.select("h", F.explode("ids").alias("other")), "h").filter("id != other").select("id", "other", F.lit(1.0).alias("similarity"))
    return apart.unionByName(among)


def _by_brute_force(rows: DataFrame, short: DataFrame, missing: int, k: int, dim: int, block_rows: int) -> DataFrame:
    """The k nearest of the ids in `short` among all rows: id, other, similarity, rank."""
    sc, passes, out = rows.sparkSession.sparkContext, -(-missing // block_rows), None
    for n in range(passes):
        block = short if passes == 1 else short.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == n)
        asked = rows.join(block, "id").select("id", "vector").distinct().toArrow()
        known = sc.broadcast((np.asarray(asked.column(0)), usable(_values(asked.column(1).combine_chunks()), dim)))

        def compare(batches, known=known):
            import pyarrow as pa

            ids, x = known.value
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for batch in batches:
                other, y = np.asarray(batch.column(0)), usable(_values(batch.column(1)), dim)
                for at in range(0, len(y), 200):
                    s = (y[at : at + 200] @ x.T).T
                    full = np.bincount(best[0], minlength=len(x)) >= k
                    low = np.full(len(x), 2.0)
                    np.minimum.at(low, best[0], best[2])
                    a, b = np.nonzero((s >= np.where(full, low, -2.0)[:, None]) & (ids[:, None] != other[at : at + 200]))
                    both = np.concatenate([best[1], other[at : at + 200][b]])
                    best = list(first_k(np.concatenate([best[0], a]), np.arange(len(both)), np.concatenate([best[2], s[a, b]]), both, k, once=True))
                    best[1] = both[best[1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["id", "other", "similarity"])

        part = rows.select("id", "vector").mapInArrow(compare, "id bigint, other bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return out.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", rank).filter(F.col("rank") <= k)


def _values(column) -> np.ndarray:
    """The values of an Arrow list column without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return np.asarray(pc.cast(pc.list_flatten(column), pa.float64()))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    near = neighbours(table(spark, base, "indexing_chunks"), "vec_id", "vector")
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p2_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return neighbours(table(spark, base, "indexing_chunks"), "vec_id", "vector").select("id", "other", F.round(F.col("similarity").cast("double"), 4).alias("similarity"), "rank")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
