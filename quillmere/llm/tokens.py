"""Problem 4: tokens of each document under a tokenizer's merge list, and their sums by source, language and domain.

Method: prefix tries of the distinct words. Words are counted once each: they are parted by ranges and sorted, which
makes a part a prefix trie walked in depth-first order, and no part larger than others, however common a prefix is. Along a trie's edge the exact
state of the tokenization is carried: for each prefix its last token and its number of tokens. The next state
follows from earlier ones, as a sequence of tokens is the tokenization of its text if and only if every two
neighbours are the tokenization of theirs; so words share the work on their common prefix. The counts at the
words' ends are then joined to the words of the documents and summed.

The most frequent words, up to `most_bytes` of them, go to all workers; the rest are rare words, which documents meet by a
shuffle, summed by document and word before it.

A word is what stands between white space, with `▁` put before it. Characters in no merge are tokens of their own.

Defined results: null and empty texts have 0 tokens; words of any length are counted; rows that repeat an id add
up; a label that names no language counts as `unknown`, a path without a numbered folder as `none`; merges that are
null or empty are left out, and of a repeated one the first rank holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import language_label
from quillmere.session import cut, table

SPACE = "▁"


class Tokenizer:
    """A merge list. Pieces are strings."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(merges):
            self.rank.setdefault(pair, k)
        self.longest = max((len(a) + len(b) for a, b in self.rank), default=1)
        self.whole = {t: self.encode(t) == [t] for t in {a + b for a, b in self.rank}}
        self.follows: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """The tokens of a text: the merge of lowest rank first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        """Whether tokens `a` and `b` can stand next to each other."""
        key = (a, b)
        if key not in self.follows:
            self.follows[key] = self.encode(a + b) == [a, b]
        return self.follows[key]

    def walk(self, words: Iterator[str]) -> Iterator[int]:
        """The number of tokens of each of some words, sorted so that common prefixes meet."""
        before, last, count = "", [""], [0]
        whole, follows, longest = self.whole, self.follows, self.longest
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in range(min(end, longest), 0, -1):
                    token = word[end - size : end]
                    if size > 1 and not whole.get(token):
                        continue
                    if size < end:
                        key = (last[end - size], token)
                        ok = follows.get(key)
                        if ok is None:
                            ok = self.neighbours(*key)
                        if not ok:
                            continue
                    last.append(token)
                    count.append(count[end - size] + 1)
                    break
            before = word
            yield count[len(word)]


def load_merges(merges: DataFrame, most: int = 1_000_000) -> Tokenizer:
    """The tokenizer of a table of merges, of which there may be at most `most`."""
    rows = merges.filter("length(left_piece) > 0 AND length(right_piece) > 0").orderBy("merge_rank", "left_piece", "right_piece").select("left_piece", "right_piece").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} merges")
    return Tokenizer([(r.left_piece, r.right_piece) for r in rows])


def words_of(text: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_tokens(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The number of tokens of each distinct word of the column `word`, and how often it is there: word, n, n_tokens."""
    known = words.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(n_tokens=list(known.value.walk(SPACE + x for x in batch["word"].tolist())))

    distinct = words.groupBy("word").agg(F.count("*").alias("n"))
    return distinct.repartitionByRange("word").sortWithinPartitions("word").mapInPandas(run, "word string, n bigint, n_tokens int")


def count_tokens(docs: DataFrame, keys: list[str], text_col: str, tokenizer: Tokenizer, most_bytes: int = 64 << 20) -> DataFrame:
    """`keys` and n_tokens for each document. `keys` must tell the documents apart."""
    exploded = docs.select(*keys, F.explode_outer(words_of(F.col(text_col))).alias("word"))
    counted = cut(word_tokens(exploded.filter("word IS NOT NULL").select("word"), tokenizer))
    least = frequent_from(counted, most_bytes)
    known = F.broadcast(counted.filter(F.col("n") >= least).select("word", "n_tokens"))
    met = exploded.join(known, "word", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    if least <= 1:
        return met.groupBy(*keys).agg(total("n_tokens").alias("n_tokens"))
    rest = met.filter("n_tokens IS NULL AND word IS NOT NULL").groupBy(*keys, "word").agg(F.count("*").alias("times"))
    rare = rest.join(counted.filter(F.col("n") < least).select("word", "n_tokens").hint("merge"), "word").select(*keys, (F.col("n_tokens") * F.col("times")).alias("n_tokens"))
    both = met.filter("n_tokens IS NOT NULL OR word IS NULL").groupBy(*keys).agg(total("n_tokens").alias("n_tokens")).unionByName(rare)
    return both.groupBy(*keys).agg(total("n_tokens").alias("n_tokens"))


def frequent_from(counted: DataFrame, most_bytes: int, word_bytes: int = 120) -> int:
    """The frequency from which on words (word, n) take at most `most_bytes` on a worker: their letters and `word_bytes` each."""
    sizes = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.sum(F.octet_length("word") + word_bytes).alias("b")).collect()  # 63 rows at most
    held, power = 0, 62
    for row in sorted(sizes, reverse=True):
        if (held := held + row.b) > most_bytes:
            break
        power = row.power
    else:
        return 0
    return 1 << power


def domain_of(path: Column) -> Column:
    """The number of the numbered folder at the top of a path, below its branch."""
    found = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"(?i)^(?:\./)*(?:[a-z]{2}/)?(\d+)\.[^/]*/", 1)
    return F.when(found == "", None).otherwise(found)


def source_name(source: Column) -> Column:
    """A source's name without case, outer blanks and a trailing slash."""
    return F.regexp_replace(F.lower(F.trim(source)), "[/ ]+$", "")


def corpus(spark: SparkSession, base: str) -> DataFrame:
    """Notes and documents in one table: collection, id, source, language, domain, text."""
    notes = table(spark, base, "search_notes").select(F.lit("search_notes").alias("collection"), F.col("note_row").alias("id"), F.lit("search_notes").alias("source"), language_label(F.col("language_branch")).alias("language"), domain_of(F.col("source_path")).alias("domain"), "text")
    docs = table(spark, base, "documents").select(F.lit("documents").alias("collection"), F.col("doc_id").alias("id"), source_name(F.col("source")).alias("source"), F.coalesce(language_label(F.col("lang")), language_label(F.col("language_branch"))).alias("language"), domain_of(F.col("source_path")).alias("domain"), "text")
    return notes.unionByName(docs).fillna({"source": "unknown", "language": "unknown", "domain": "none"})


def p4_documents(spark: SparkSession, base: str) -> DataFrame:
    tokenizer = load_merges(table(spark, base, "tokenizer_merges"))
    return count_tokens(corpus(spark, base), ["collection", "id", "source", "language", "domain"], "text", tokenizer)


def p4_totals(spark: SparkSession, base: str) -> DataFrame:
    return p4_documents(spark, base).groupBy("source", "language", "domain").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))


QUERIES = {"p4_documents": p4_documents, "p4_totals": p4_totals}
