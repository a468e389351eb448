"""Problem 8: mixtures of documents in which each source has its share of the tokens.

Method: a multivariate-hypergeometric splitting tree. A source's documents are spread over blocks by a hash; blocks
in random order are drawn until the source has its tokens, whole passes over the source first, then a part of one
more. The numbers of blocks drawn from each source are split between the halves of the output shards, exactly and
as random draws without replacement would, and so on down to single shards. Each shard takes its own stretch of a
source's permuted blocks and shuffles its documents by itself.

Only the table of blocks comes to the driver: at most `most_blocks` for each source that a mixture names, of which
there may be `most_sources`. The last block of a source is drawn in part: it is parted into `most_blocks` small blocks, whose
running sums say which are taken whole, and one of these is drawn document by document. So no window holds a block of any size.

Tokens are those of a public tokenizer (a .tiktoken file; its path is a parameter).

Shares are taken in proportion where they don't sum to 1. A null, negative or zero share and a source that the
corpus lacks have no part; a null cap counts as 1; source names are compared without case, outer blanks and
trailing slash, and of one mixture's rows for the same source the shares add up and the largest cap holds. A source
held back by its cap is not made up for by others: its reached share says so.

Defined results: null and empty texts have 0 tokens and are never drawn; a repeated doc_id counts once; documents
without source belong to no mixture but count for the corpus' size; empty tables give an empty result.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm.tokens import source_name
from quillmere.session import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level tokenizers of this family part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SELECTION = "mix string, source string, block int, copy int, shard int, budget double"


def sized(docs: DataFrame, id_col: str, text_col: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source and n_tokens of each document."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encode = tiktoken.Encoding("quillmere", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    out = rows.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
    return out.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by shard and source: drawn without replacement, shards as equal in size as can be."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    half = rng.multivariate_hypergeometric(counts, round(total * left / shards), method="marginals") if total else counts
    return np.concatenate([split_tree(half, left, rng), split_tree(counts - half, shards - left, rng)])


def draw(blocks: dict[str, list[tuple[int, int]]], wants: dict[str, float], caps: dict[str, int], shards: int, rng: np.random.Generator) -> list[tuple]:
    """One mixture's draws: (source, block, copy, shard, budget). blocks: (block, tokens) by source; budget: the
    tokens to take of a block that is drawn in part, else None."""
    drawn: dict[str, list[tuple]] = {}
    for source in sorted(wants):
        own = [(b, t) for b, t in blocks[source] if t > 0]
        total = sum(t for _, t in own)
        take = min(wants[source], caps[source] * total)
        if not total or take <= 0:
            continue
        passes = min(caps[source], int(take // total))
        picked = [(b, c, None) for c in range(passes) for b, _ in own]
        rest = take - passes * total
        for k in rng.permutation(len(own)):
            if passes >= caps[source] or rest < 1:
                break
            b, t = own[k]
            picked.append((b, passes, None if t <= rest else float(rest)))
            rest -= min(t, rest)
        drawn[source] = [picked[k] for k in rng.permutation(len(picked))]
    names = sorted(drawn)
    by_shard = split_tree(np.array([len(drawn[s]) for s in names], np.int64), shards, rng) if names else []
    out, at = [], dict.fromkeys(names, 0)
    for shard, counts in enumerate(by_shard):
        for s, n in zip(names, counts.tolist(), strict=True):
            out += [(s, b, c, shard, budget) for b, c, budget in drawn[s][at[s] : at[s] + n]]
            at[s] += n
    return out


def targets_of(targets: DataFrame, most_sources: int) -> pd.DataFrame:
    """One row for each mixture and source that has a share; `part` is its share of the mixture's sum."""
    rows = targets.select(F.col("mix"), source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).cast("int").alias("cap"), F.coalesce("size_factor", F.lit(1.0)).alias("factor")).filter("mix IS NOT NULL AND source IS NOT NULL")
    wanted = rows.filter("target_share > 0 AND cap > 0 AND factor > 0").groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("cap").alias("cap"), F.max("factor").alias("factor")).limit(most_sources + 1).toPandas()
    if len(wanted) > most_sources:
        raise ValueError(f"more than {most_sources} sources in mixtures")
    return wanted.sort_values(["mix", "source"], ignore_index=True)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 1, shard_tokens: int = 8_000_000, least_shards: int = 4, block_docs: int = 64, most_blocks: int = 4096, most_sources: int = 1000, most_bytes: int = 32 << 20) -> DataFrame:
    """The documents of every mixture, each use a row: mix, shard, position, source, doc_id, copy, n_tokens."""
    spark = docs.sparkSession
    wanted = targets_of(targets, most_sources)
    named = sorted(set(wanted["source"]))
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    pool = docs.filter(F.col("source").isin(named) & (F.col("n_tokens") > 0))
    sizes = {r.source: r["n"] for r in pool.groupBy("source").agg(F.count("*").alias("n")).collect()}
    number = F.lit(1)
    for s, n in sizes.items():
        number = F.when(F.col("source") == s, min(most_blocks, math.ceil(n / block_docs))).otherwise(number)
    placed = pool.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), number).cast("int"))
    blocks: dict[str, list[tuple[int, int]]] = {s: [] for s in sizes}
    for r in placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).orderBy("source", "block").collect():
        blocks[r.source].append((r.block, r.t))
    rng, draws = np.random.default_rng(seed), []
    for name, rows in wanted.groupby("mix", sort=True):
        own = rows[rows["source"].isin(sizes)]
        if not len(own):
            continue
        size = total * float(own["factor"].max())
        parts = own["target_share"] / own["target_share"].sum()
        shards = max(least_shards, 1 << max(0, math.ceil(math.log2(max(1.0, size / shard_tokens)))))
        draws += [(name, *d) for d in draw(blocks, dict(zip(own["source"], parts * size, strict=True)), dict(zip(own["source"], own["cap"].astype(int), strict=True)), shards, rng)]
    chosen = spark.createDataFrame(draws, SELECTION)
    small = sum(64 + 2 * len(d[0]) + 2 * len(d[1]) for d in draws) <= most_bytes
    used = placed.join(F.broadcast(chosen) if small else chosen, ["source", "block"])
    order = F.xxhash64(F.lit(seed + 1), "mix", "doc_id", "copy")
    cell = ["mix", "source", "block", "copy"]
    # one block a mixture and source is drawn in part, by the order of its documents' hashes
    cells = used.filter(F.col("budget").isNotNull()).withColumn("order", order).withColumn("small", F.floor((F.shiftright("order", 1) + F.lit(1 << 62)) / F.lit(2.0**63 / most_blocks)))
    before = cells.groupBy(*cell, "small").agg(F.sum("n_tokens").alias("own")).withColumn("before", F.sum("own").over(Window.partitionBy(*cell).orderBy("small")) - F.col("own")).drop("own")
    sums = F.sum("n_tokens").over(Window.partitionBy(*cell, "small").orderBy("order", "doc_id"))
    part = cells.join(before, [*cell, "small"]).withColumn("sum", F.col("before") + sums).filter(F.col("sum") - F.col("n_tokens") / 2 <= F.col("budget")).select(*used.columns)
    both = used.filter(F.col("budget").isNull()).unionByName(part)
    place = F.row_number().over(Window.partitionBy("mix", "shard").orderBy(order, "doc_id", "copy"))
    return both.withColumn("position", place).select("mix", "shard", "position", "source", "doc_id", "copy", "n_tokens")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of each mixture reached: mix, source, target_share (as given), reached_tokens, reached_share, n_documents, most_uses."""
    uses = selection.groupBy("mix", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    reached = uses.groupBy("mix", "source").agg(F.sum("t").alias("reached_tokens"), F.count("*").alias("n_documents"), F.max("n").alias("most_uses"))
    asked = targets.select("mix", source_name(F.col("source")).alias("source"), "target_share").filter("mix IS NOT NULL").groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"))
    whole = F.sum("reached_tokens").over(Window.partitionBy("mix"))
    out = asked.join(reached, ["mix", "source"], "left").fillna(0, ["reached_tokens", "n_documents", "most_uses"])
    return out.withColumn("reached_share", F.round(F.col("reached_tokens") / whole, 6))


def p8_deviations(spark: SparkSession, base: str) -> DataFrame:
    """What a source with no cap in its way reached beside what it should have, in tokens: mix, source, off (a share of what
    was asked). Fails where one is off by more than its last document and a hundredth."""
    targets, docs = table(spark, base, "mix_targets"), cut(sized(table(spark, base, "documents"), "doc_id", "text", "source"))
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.max("n_tokens").alias("longest"))
    total = docs.agg(F.sum("n_tokens").alias("total"))
    rows = targets.select("mix", source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("cap"), F.coalesce("size_factor", F.lit(1.0)).alias("factor")).filter("mix IS NOT NULL AND target_share > 0 AND cap > 0 AND factor > 0")
    asked = rows.groupBy("mix", "source").agg(F.sum("target_share").alias("share"), F.max("cap").alias("cap"), F.max("factor").alias("factor")).join(sizes, "source")
    whole = Window.partitionBy("mix")
    due = asked.join(F.broadcast(total)).withColumn("due", F.least(F.col("share") / F.sum("share").over(whole) * F.max("factor").over(whole) * F.col("total"), F.col("cap") * F.col("there")))  # total is one row
    got = shares(mix(docs, targets), targets).select("mix", "source", "reached_tokens")
    off = due.join(got, ["mix", "source"]).withColumn("off", F.abs(F.col("reached_tokens") - F.col("due")))
    fails = F.when(F.col("off") > F.col("longest") + 0.01 * F.col("due"), F.raise_error(F.lit("a mixture misses a share")).cast("double"))
    return off.select("mix", "source", F.coalesce(fails, F.round(F.col("off") / F.col("due"), 6)).alias("off"))


def p8_selection(spark: SparkSession, base: str) -> DataFrame:
    docs = cut(sized(table(spark, base, "documents"), "doc_id", "text", "source"))
    return mix(docs, table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return shares(p8_selection(spark, base), table(spark, base, "mix_targets"))


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares, "p8_deviations": p8_deviations}
