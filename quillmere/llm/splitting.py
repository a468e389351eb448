"""Problem 6: texts over a size limit cut into overlapping pieces at natural boundaries.

Method: range processing. A text is read in ranges of `range_chars` characters (a file: of `range_bytes` bytes),
each with a halo of its surroundings. A worker cuts its range off at the best boundary before the range's end
and finds, from its halo, the very cut its forerunner made; so the ranges' boundary tables fit together without
passing them on. Between two such cuts it lays pieces one after another. Prefix sums of the pieces' numbers,
first over groups of ranges and then within them, give the new chunk_index. A file is never held whole; a text that is
a table's cell is parted into its ranges in one pass.

A piece has at most max_chars characters (code points). It ends at the best kind of boundary in the second half
of what it may hold, else at any boundary in the first half, else, where a text has none, at the limit, though not
before a combining mark. The next piece begins exactly overlap_chars before that end. An overlap of more than half
of the limit counts as half of it; a limit that is null or below 2 takes the default's.

Defined results: a null text gives no piece and an empty one a single empty piece; a repeated row is split again;
a null or unlisted kind takes the limit of `default`; other columns of the input take no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.session import cut, table

_BLANK_LINE = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…][\"'»”)\]]*\s+")
_CLAUSE = re.compile(r"[;:,]\s+")
_SPACE = re.compile(r"\s+")
PROSE = (_BLANK_LINE, _SENTENCE, _LINE, _CLAUSE, _SPACE)
LINES = (_BLANK_LINE, _LINE, _SENTENCE, _CLAUSE, _SPACE)
ROWS = (_LINE, _SPACE)
#: Boundaries by kind of block, best first.
BOUNDARIES = {"code_block": LINES, "diagram": LINES, "formula": LINES, "table": ROWS}
EDGE = 64


def best_boundary(text: str, after: int, until: int, kinds: tuple[re.Pattern, ...]) -> int | None:
    """The last position in (after, until] behind a boundary of the best kind that is there."""
    for pattern in kinds:
        last = None
        for m in pattern.finditer(text, max(0, after - EDGE), until):
            if m.end() > after:
                last = m.end()
        if last is not None:
            return last
    return None


def hard_cut(text: str, at: int, least: int) -> int:
    """`at`, or a few characters earlier so as not to part a combining mark or joiner from its base."""
    for back in range(at, max(least, at - 16), -1):
        if back >= len(text) or not (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1] == "‍"):
            return back
    return at


def cut_before(text: str, edge: int, limit: int, kinds: tuple[re.Pattern, ...]) -> int:
    """Where a range that ends at `edge` is cut off. It depends only on the half limit of text before the edge."""
    low = max(1, edge - limit // 2)
    found = best_boundary(text[: edge + 1], low, edge, kinds)
    return found if found is not None else hard_cut(text, edge, low)


def range_pieces(text: str, low: int, high: int, first: bool, last: bool, limit: int, overlap: int, kinds: tuple[re.Pattern, ...]) -> list[tuple[int, int]]:
    """The pieces of the range [low, high) of a text, of which `text` holds the range and its halo."""
    begin = low if first else cut_before(text, low, limit, kinds)
    end = high if last else cut_before(text, high, limit, kinds)
    at, out = begin if first else max(0, begin - overlap), []
    done = begin
    while end - at > limit:
        cut = best_boundary(text, max(at + limit // 2, done), at + limit, kinds)
        if cut is None:
            cut = best_boundary(text, max(at + overlap, done), at + limit // 2, kinds)
        if cut is None:
            cut = hard_cut(text, at + limit, max(at + overlap, done) + 1)
        out.append((at, cut))
        done, at = cut, cut - overlap
    if end > done or first and last:
        out.append((at, end))
    return out


def limits_of(spark: SparkSession, limits: DataFrame, most_kinds: int = 1000) -> dict[str, tuple[int, int]]:
    """Limits by kind of block; at most `most_kinds` of them, which are sent to all workers."""
    rows = limits.select(F.lower(F.trim("block_kind")).alias("k"), "max_chars", "overlap_chars").limit(most_kinds + 1).collect()
    if len(rows) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of block")
    default = next(((r.max_chars, r.overlap_chars or 0) for r in rows if r.k == "default" and (r.max_chars or 0) > 1), (1200, 200))
    out = {r.k: (r.max_chars, r.overlap_chars or 0) if (r.max_chars or 0) > 1 else default for r in rows if r.k is not None}
    return {k: (most, max(0, min(over, most // 2))) for k, (most, over) in ({"default": default} | out).items()}


def split_texts(df: DataFrame, id_col: str, text_col: str, kind_col: str, limits: dict[str, tuple[int, int]], range_chars: int = 16_384, also: dict[str, Column] | None = None) -> DataFrame:
    """Pieces of texts: id, kind, range, piece (within the range), start, end, n_chars (of the whole text), limit, text, and
    the expressions of `also`."""
    halo = 2 * max(most for most, _ in limits.values()) + 2 * EDGE
    size = max(range_chars, 2 * halo)
    kind = F.lower(F.trim(F.col(kind_col).cast("string")))
    also = also or {}
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(name) for name, c in also.items()], F.when(kind.isin(*limits), kind).otherwise("default").alias("kind"), F.length(text_col).alias("n"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    extra = list(also)
    whole = F.when(F.col("n") <= size, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    # a range with the end of its forerunner and the beginning of its successor
    ranges = F.expr(f"transform(s, (x, i) -> struct(i AS range, concat(if(i > 0, right(s[i - 1], {halo}), ''), x, if(i + 1 < size(s), left(s[i + 1], {EDGE}), '')) AS part))")
    ranged = rows.withColumn("s", whole).select("id", *extra, "kind", "n", F.explode(ranges).alias("r")).select("id", *extra, "kind", "n", "r.range", "r.part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, *more, kind_, n, r, part in batch.itertuples(index=False, name=None):
                most, over = limits[kind_]
                base = max(0, r * size - halo)
                low, high = r * size - base, min(n, (r + 1) * size) - base
                for k, (a, b) in enumerate(range_pieces(part, low, high, r == 0, (r + 1) * size >= n, most, over, BOUNDARIES.get(kind_, PROSE))):
                    out.append((id_, *more, kind_, r, k, base + a, base + b, n, most, part[a:b]))
            yield pd.DataFrame(out, columns=["id", *extra, "kind", "range", "piece", "start", "end", "n_chars", "limit", "text"])

    id_type = df.schema[id_col].dataType.simpleString()
    kinds = "".join(f"{name} {rows.schema[name].dataType.simpleString()}, " for name in extra)
    return ranged.mapInPandas(run, f"id {id_type}, {kinds}kind string, range int, piece int, start int, end int, n_chars int, limit int, text string")


def split_files(spark: SparkSession, path: str, limit: int = 1200, overlap: int = 200, range_bytes: int = 8 << 20, glob: str = "*") -> DataFrame:
    """Pieces of UTF-8 files, each read in byte ranges: path, chunk_index, start_byte, end_byte, text. Workers open files by
    their addresses, of a local or shared disk or an object store; bytes that are no UTF-8 become replacement characters."""
    halo = 8 * limit + 4 * EDGE
    size = max(range_bytes, 2 * halo)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranged = files.select("path", "length", F.explode(F.expr(f"sequence(0, int(greatest(0, length - 1) div {size}))")).alias("range")).repartition("path", "range")
    overlap = min(overlap, limit // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        from pyarrow.fs import FileSystem, LocalFileSystem

        for batch in batches:
            for name, length, r in batch.itertuples(index=False):
                low, high = r * size, min(length, (r + 1) * size)
                base, until = max(0, low - halo), min(length, high + 4 * EDGE)
                local = name.startswith("file:")
                disk, inner = (LocalFileSystem(), "/" + name[5:].lstrip("/")) if local else FileSystem.from_uri(quote(name, safe=":/@"))
                with disk.open_input_file(inner) as f:
                    f.seek(base)
                    raw = f.read(until - base)
                cuts = [_aligned(raw, x - base) for x in (base, low, high)]
                head, own, tail = (raw[a:b].decode("utf-8", "surrogateescape") for a, b in ((cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[2], len(raw))))
                text = head + own + tail.rstrip(_ESCAPED)
                out, seen, at = [], base + cuts[0], 0
                for k, (a, b) in enumerate(range_pieces(text, len(head), len(head) + len(own), r == 0, high >= length, limit, overlap, PROSE)):
                    seen, at = seen + _bytes(text[at:a]) if a >= at else seen - _bytes(text[a:at]), a
                    out.append((name, r, k, seen, seen + _bytes(text[a:b]), text[a:b].translate(_REPLACED)))
                yield pd.DataFrame(out, columns=["path", "range", "piece", "start_byte", "end_byte", "text"])

    pieces = cut(ranged.mapInPandas(run, "path string, range int, piece int, start_byte bigint, end_byte bigint, text string"))
    return numbered(pieces, ["path"], ["range", "piece"], [F.col("range")], "chunk_index").select("path", "chunk_index", "start_byte", "end_byte", "text")


_ESCAPED = "".join(map(chr, range(0xDC80, 0xDD00)))
_REPLACED = dict.fromkeys(range(0xDC80, 0xDD00), "\ufffd")


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _aligned(raw: bytes, at: int) -> int:
    """The first position from `at` on where a UTF-8 character may begin."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: list, name: str) -> DataFrame:
    """`name`: each row's place (from 0) in its group. `bucket` are expressions that `order` sorts by first; sums
    over buckets are added to places within them, so that a large group is not sorted in one task."""
    keyed = df.select("*", *[b.alias(f"_b{k}") for k, b in enumerate(bucket)], *[F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"_g{k}") for k, g in enumerate(group)])
    g, b = [f"_g{k}" for k in range(len(group))], [f"_b{k}" for k in range(len(bucket))]
    before = keyed.groupBy(*g, *b).count().select(*g, *b, (F.sum("count").over(Window.partitionBy(*g).orderBy(*b)) - F.col("count")).alias("_before"))
    within = keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*g, *b).orderBy(*order)))
    return within.join(before, [*g, *b]).withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("int")).drop(*g, *b, "_before", "_at")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    pieces = split_texts(table(spark, base, "chunking_blocks"), "block_id", "text", "block_kind", limits_of(spark, table(spark, base, "chunk_limits")))
    return pieces.filter(F.col("n_chars") > F.col("limit")).select(F.col("id").alias("block_id")).distinct()


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    blocks = table(spark, base, "chunking_blocks")
    places = {"source_path": F.col("source_path"), "place": F.coalesce(F.col("block_index").cast("bigint"), F.col("block_id")), "unplaced": F.col("block_index").isNull()}
    joined = split_texts(blocks, "block_id", "text", "block_kind", limits_of(spark, table(spark, base, "chunk_limits")), also=places)
    bucket = [F.col("unplaced"), F.floor(F.col("place") / 1024)]
    out = numbered(joined, ["source_path"], ["unplaced", "place", "id", "range", "piece"], bucket, "chunk_index")
    return out.select(F.col("id").alias("block_id"), "source_path", "chunk_index", "kind", "start", "end", (F.col("n_chars") > F.col("limit")).alias("was_split"), "text")


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}

SQL = {
    "p6_found": """
SELECT b.block_id
FROM chunking_blocks b
LEFT JOIN chunk_limits l ON lower(trim(b.block_kind)) = l.block_kind
CROSS JOIN (SELECT max_chars FROM chunk_limits WHERE block_kind = 'default') d
WHERE length(b.text) > coalesce(l.max_chars, d.max_chars)
GROUP BY b.block_id
""",
}
