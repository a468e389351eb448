"""Text structure: sections of markdown notes, typed blocks, running lines and blocks of pages.

Line-wise work whose result depends on all lines before it (fences, heading stacks) runs in Arrow batches on one
document at a time; everything else is expressions and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import text as X

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)
#: Links of notes, and lines of nothing but links with separators between.
_LINK = r"(?:\[\[[^\]]+\]\]|\[[^\]]+\]\([^)]+\))"
_NAVIGATION = re.compile(rf"^\s*(?:[-*+]\s+)?{_LINK}(?:\s*(?:\||/|->|>|→|::|·|•)\s*{_LINK})+\s*$")
_LINK_ONLY = re.compile(rf"^\s*(?:[-*+]\s+)?{_LINK}\s*$")
#: Sections that only list other notes.
RELATED = {"related notes", "see also", "links", "пов'язані нотатки", "див. також", "посилання"}
#: Sections that list sources, and those that sum a note up.
REFERENCES = {*X.REFERENCE_TITLES, "sources", "references and links", "джерела", "література"}
ABSTRACTS = {"abstract", "summary", "overview"}
SECTIONS = "path string, seq int, section string, level int, section_path string, text string"


def clean_markdown(text: str) -> str:
    """A note without lines that only navigate, and without sections that only list related notes."""
    out: list[str] = []
    block: list[str] | None = None
    for line in [*text.split("\n"), "# "]:
        head = _HEADING.match(line)
        if head or line == "# ":
            if block is not None and any(x.strip() and not (_NAVIGATION.match(x) or _LINK_ONLY.match(x)) for x in block[1:]):
                out += block
            block = None
            if line == "# ":
                break
            if head.group(2).strip().lower() in RELATED:
                block = [line]
                continue
        if block is not None:
            block.append(line)
        elif not _NAVIGATION.match(line):
            out.append(line)
    return "\n".join(out)


def normal(text: str) -> str:
    text = re.sub(r"\s+\n", "\n", text.replace("\0", " "))
    return re.sub(r"[ \t]+", " ", text).strip()


def sections_of(text: str) -> list[tuple[str, int, str, str]]:
    """A note's sections: title, level, path of titles, text (title and body). No headings: one `Document` of level 0."""
    if text.startswith("---\n") and "\n---\n" in text:
        text = text.split("\n---\n", 1)[1]
    text = normal(clean_markdown(text))
    heads = list(_HEADING.finditer(text))
    if not heads:
        return [("Document", 0, "Document", text)] if text else []
    out = []
    if before := text[: heads[0].start()].strip():
        out.append(("Preamble", 0, "Preamble", before))
    stack: list[tuple[int, str]] = []
    for i, h in enumerate(heads):
        level, title = len(h.group(1)), h.group(2).strip()
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        body = text[h.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].strip()
        out.append((title, level, " > ".join(t for _, t in stack), f"{title}\n{body}".strip()))
    return out


def sections(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The sections of markdown notes: path, seq (from 0), section, level, section_path, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, i, *s) for p, t in batch.itertuples(index=False) for i, s in enumerate(sections_of(t or ""))], columns=["path", "seq", "section", "level", "section_path", "text"])

    return notes.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, SECTIONS)


def note_titles(found: DataFrame) -> DataFrame:
    """path, title: a note's first section of level 1, else its file's stem."""
    stem = F.regexp_replace(X.file_name(F.col("path")), r"\.md$", "")
    return found.groupBy("path").agg(F.min_by("section", F.when(F.col("level") == 1, F.col("seq"))).alias("t")).select("path", F.coalesce("t", stem).alias("title"))


def title_of(found: list[tuple[str, int, str, str]], path: str | None) -> str:
    """A note's first section of level 1, else its file's stem."""
    return next((s for s, level, _, _ in found if level == 1), (path or "").rsplit("/", 1)[-1].removesuffix(".md"))


def section_blocks(section: str, text: str) -> list[tuple[str, str]]:
    """The blocks of a section, none if it lists sources; paragraphs of summaries are abstracts."""
    name = section.strip().lower()
    if name in REFERENCES:
        return []
    own = blocks_of(text) or [("paragraph", text)]
    if len(own) > 1 and own[0][1].strip() == section.strip():
        own = own[1:]
    return [("abstract" if name in ABSTRACTS and k == "paragraph" else k, t) for k, t in own]


def blocks_of(text: str) -> list[tuple[str, str]]:
    """The typed blocks of a section: code, diagrams, formulas, images, captions, tables and paragraphs."""
    out: list[tuple[str, str]] = []
    plain: list[str] = []

    def flush() -> None:
        if body := "\n".join(plain).strip():
            out.append(("paragraph", body))
        plain.clear()

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        if fence := re.match(r"^(`{3,}|~{3,})\s*([\w-]*)", bare):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence.group(1)[:3])), len(lines) - 1)
            word = fence.group(2).lower()
            kind = "diagram" if word in X.DIAGRAM_FENCES else "formula" if word in X.FORMULA_FENCES else "code_block"
            out.append((kind, "\n".join(lines[i : end + 1])))
            i = end + 1
        elif bare == "$$":
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "$$"), len(lines) - 1)
            out.append(("formula", "\n".join(lines[i : end + 1])))
            i = end + 1
        elif re.match(r"^!\[[^\]]*\]\([^)]*\)$|^!\[\[[^\]]+\]\]$", bare):
            flush()
            out.append(("image", bare))
            i += 1
        elif re.match(r"(?i)^(?:figure|fig\.|рис\.|рисунок)\s*\d+", bare) and len(bare) <= 300:
            flush()
            out.append(("figure_caption", bare))
            i += 1
        elif bare.startswith("|") and i + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]*-{2,}[\s:|-]*$", lines[i + 1]):
            flush()
            end = i
            while end < len(lines) and lines[end].strip().startswith("|"):
                end += 1
            out.append(("table", "\n".join(lines[i:end])))
            i = end
        else:
            if bare:
                plain.append(line)
            else:
                flush()
            i += 1
    flush()
    return out


def blocks(found: DataFrame) -> DataFrame:
    """Blocks of sections (path, seq, section, level, section_path, text) without those that list sources: their columns
    with block_seq (within the section), kind and text. Paragraphs of summaries are abstracts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, seq, section, level, section_path, text in batch.itertuples(index=False):
                out += [(path, seq, section, level, section_path, i, k, t) for i, (k, t) in enumerate(section_blocks(section, text))]
            yield pd.DataFrame(out, columns=["path", "seq", "section", "level", "section_path", "block_seq", "kind", "text"])

    return found.select("path", "seq", "section", "level", "section_path", "text").mapInPandas(run, "path string, seq int, section string, level int, section_path string, block_seq int, kind string, text string")


def _page_lines(text: str) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: X.normalize(x)), lambda x: x != "")


def repeated_lines(pages: DataFrame, file: str = "source_path", text: str = "text", edge: int = 3) -> DataFrame:
    """Lines, in lower case, that return at an end of a file's pages: file, place (top, bottom), line, n. A line counts each
    time it is among the first (or last) `edge` lines of a page; of up to 3 pages it must be there as often as there are
    pages, of more half as often. A file of one page has none."""
    lines = pages.filter(F.col(text).isNotNull()).select(F.col(file).alias("file"), F.transform(_page_lines(text), lambda x: F.lower(x)).alias("lines"))
    sizes = lines.groupBy("file").agg(F.count("*").alias("pages"))
    # both ends in one array, so that one pass counts them
    ends = F.concat(F.transform(F.slice("lines", 1, edge), lambda x: F.struct(F.lit("top").alias("place"), x.alias("line"))), F.transform(F.slice("lines", F.greatest(F.lit(1), F.size("lines") - edge + 1), F.lit(edge)), lambda x: F.struct(F.lit("bottom").alias("place"), x.alias("line"))))
    counts = lines.select("file", F.explode(ends).alias("x")).groupBy("file", "x.place", "x.line").agg(F.count("*").alias("n"))
    least = F.when(F.col("pages") <= 3, F.col("pages")).otherwise(F.ceil(F.col("pages") / 2))
    return counts.join(sizes, "file").filter((F.col("pages") > 1) & (F.col("n") >= least)).select("file", "place", "line", "n")


def trimmed_pages(pages: DataFrame, id_col: str = "page_id", file: str = "source_path", text: str = "text", label: str = "page_label", edge: int = 3) -> DataFrame:
    """Pages without running lines at their ends: id, text, n_removed. Lines that return at that end, numbers of up to four
    digits, the page's label, and `page` or `p.` before it go from both ends until a line stays; empty pages are dropped."""
    known = repeated_lines(pages, file, text, edge).groupBy("file").agg(*[F.collect_set(F.when(F.col("place") == k, F.col("line"))).alias(k) for k in ("top", "bottom")])
    rows = pages.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(file).alias("file"), F.lower(F.coalesce(F.col(label), F.lit(""))).alias("label"), _page_lines(text).alias("lines")).join(known, "file", "left")
    none = F.array().cast("array<string>")
    number = lambda x: x.rlike(r"^\d{1,4}$") | ((F.col("label") != "") & ((x == F.col("label")) | ((x.startswith("page") | x.startswith("p.")) & (F.regexp_replace(x, r"^(?:page|p\.)\s*", "") == F.col("label")))))
    stays = lambda side: F.transform("lines", lambda x: ~(F.array_contains(F.coalesce(side, none), F.lower(x)) | number(F.lower(x))))
    marked = rows.withColumn("first", F.array_position(stays("top"), True).cast("int")).withColumn("last", (F.size("lines") + 1 - F.array_position(F.reverse(stays("bottom")), True)).cast("int"))
    kept = marked.filter((F.col("first") > 0) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size("lines"))).withColumn("kept", F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1))
    return kept.select(F.col("id").alias(id_col), F.array_join("kept", "\n").alias("text"), (F.size("lines") - F.size("kept")).alias("n_removed"))


def paper_heads(pages: DataFrame, file: str = "source_path", page: str = "page", text: str = "text", name: str = "source_file") -> DataFrame:
    """What a paper's first page says: file, first_page, title, authors, year."""
    own = pages.filter(F.col(text).isNotNull() & F.col(file).isNotNull())
    first = own.groupBy(F.col(file).alias("file")).agg(F.min(F.col(page)).alias("first_page"), F.min_by(F.struct(F.col(text).alias("t"), F.col(name).alias("s")), F.struct(F.col(page), F.xxhash64(text))).alias("f"))
    rows = first.select("file", "first_page", X.text_lines(F.col("f.t")).alias("lines"), F.col("f.s").alias("s"), X.first_year(F.col("f.t")).alias("year"))
    titled = rows.withColumn("title", X.first_title(F.col("lines"), F.col("s")))
    return titled.select("file", "first_page", "title", X.first_authors(F.col("lines"), F.col("title")).alias("authors"), "year")


def page_blocks(pages: DataFrame, file: str = "source_path", page: str = "page", text: str = "text", name: str = "source_file", levels: int = 12) -> DataFrame:
    """Typed blocks of papers' pages: file, page, line_no, title, kind (figure_caption, table, abstract, paragraph), section,
    section_level, section_path, text, block_index (within the file, from 0). Lines after a heading of references are left
    out to the file's end, those of title, authors and year before the first block too. Blocks are runs of lines of one kind
    on a page. Headings (of up to `levels` levels) are carried on by pages first and by lines within them, so that no
    window holds the lines of a whole file. Paragraphs and tables end at blank lines. Pages without a number come first."""
    heads = paper_heads(pages, file, page, text, name)
    numbered = pages.filter(F.col(text).isNotNull() & F.col(file).isNotNull()).select(F.col(file).alias("file"), F.col(page).alias("page"), F.xxhash64(text).alias("k"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    lines = numbered.withColumn("line", X.normalize(F.col("raw"))).filter("line != ''").drop("raw").join(heads, "file")
    level = X.heading_level(F.col("line"))
    kind = F.when(_preamble() & F.col("page").eqNullSafe(F.col("first_page")), "preamble").when(level.isNotNull(), "heading").when(X.is_figure_caption(F.col("line")), "figure_caption").when(F.col("line").startswith("|"), "table").otherwise("paragraph")
    at = F.struct(F.col("page"), F.col("k"), F.col("line_no"))
    seen = lines.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.least(level, F.lit(levels)))).withColumn("name", F.when(F.col("kind") == "heading", X.heading_title(F.col("line")))).withColumn("at", at)
    # preamble lines count as text once anything else has come
    page_key, inside = ["file", "page", "k"], Window.partitionBy("file", "page", "k").orderBy("line_no")
    last = lambda n: F.max(F.when(F.col("level") == n, F.struct("at", "level", "name")))
    ended = F.max(F.when((F.col("kind") == "heading") & F.lower("name").isin(*X.REFERENCE_TITLES), 1).otherwise(0))
    begun = F.max(F.when(F.col("kind") != "preamble", 1).otherwise(0))
    stats = [last(n).alias(f"h{n}") for n in range(1, levels + 1)] + [ended.alias("ended"), begun.alias("begun")]
    names = [f"h{n}" for n in range(1, levels + 1)] + ["ended", "begun"]
    per_page = seen.groupBy(*page_key).agg(*stats)
    earlier = Window.partitionBy("file").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, -1)
    before = per_page.select(*page_key, *[F.max(c).over(earlier).alias(f"p_{c}") for c in names])
    here = seen.select("*", *[last(n).over(inside).alias(f"h{n}") for n in range(1, levels + 1)], ended.over(inside).alias("ended"), begun.over(inside).alias("begun"))
    both = here.alias("a").join(before.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in page_key]).select("a.*", *[f"b.p_{c}" for c in names])
    stack = F.array_compact(F.array(*[F.greatest(f"h{n}", f"p_h{n}") for n in range(1, levels + 1)]))
    # a heading stands as long as none of its level or above has come after it
    standing = F.filter(stack, lambda x: ~F.exists(stack, lambda y: (y["level"] < x["level"]) & (y["at"] > x["at"])))
    open_ = F.coalesce(F.greatest("ended", "p_ended"), F.lit(0)) == 0
    kept = both.filter(open_ & (F.col("kind") != "heading")).withColumn("stack", standing).withColumn("kind", F.when((F.col("kind") == "preamble") & (F.greatest("begun", F.coalesce("p_begun", F.lit(0))) == 1), "paragraph").otherwise(F.col("kind"))).filter("kind != 'preamble'")
    run = (F.lag("kind").over(inside) == F.col("kind")) & F.col("kind").isin("paragraph", "table") & (F.lag("line_no").over(inside) == F.col("line_no") - 1) & F.lag("stack").over(inside).eqNullSafe(F.col("stack"))
    grouped = kept.withColumn("starts", F.when(run, 0).otherwise(1)).withColumn("block", F.sum("starts").over(inside))
    out = grouped.groupBy(*page_key, "block", "kind", "title").agg(F.min("line_no").alias("line_no"), F.first("stack").alias("stack"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    section = F.coalesce(F.try_element_at(F.col("stack"), F.lit(-1))["name"], F.lit("Document"))
    path = F.when(F.size("stack") > 0, F.array_join(F.transform("stack", lambda x: x["name"]), " > ")).otherwise("Document")
    spoken = lambda sep: F.array_join(F.transform("l", lambda x: x["line"]), sep)
    body = F.when(F.col("kind") == "table", spoken("\n")).otherwise(X.clean_block(spoken(" ")))
    final = F.when((F.col("kind") == "paragraph") & (F.lower(section) == "abstract"), "abstract").otherwise(F.col("kind"))
    rows = out.select("file", "page", "k", "line_no", "title", final.alias("kind"), section.alias("section"), F.coalesce(F.try_element_at(F.col("stack"), F.lit(-1))["level"], F.lit(0)).alias("section_level"), path.alias("section_path"), body.alias("text")).filter("text != ''")
    counted = rows.groupBy(*page_key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = rows.withColumn("here", F.row_number().over(inside)).alias("a").join(counted.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in page_key]).select("a.*", "b.before")
    return placed.select("file", "page", "line_no", "title", "kind", "section", "section_level", "section_path", "text", (F.col("before") + F.col("here") - 1).cast("int").alias("block_index"))


def _preamble() -> Column:
    """Whether a line gives a paper's title, its authors, or, in up to eight words, its year."""
    authors = [F.array_join("authors", sep) for sep in (", ", " and ", " , ")]
    named = (F.size("authors") > 0) & ((F.col("line") == authors[0]) | (F.col("line") == authors[1]) | (F.col("line") == authors[2]))
    dated = (F.col("year") != "") & F.array_contains(F.regexp_extract_all("line", F.lit(r"\b(\d+)\b"), F.lit(1)), F.col("year")) & (F.size(F.split("line", " ")) <= 8)
    return (F.col("line") == F.col("title")) | named | dated


def paper_chunks(pages: DataFrame, file: str = "source_path", page: str = "page", text: str = "text", name: str = "source_file", size: int = 1200, overlap: int = 200) -> DataFrame:
    """The chunks of papers' pages: as `chunking.chunks`, by the rules of papers."""
    from quillmere.operators import chunking

    found = page_blocks(pages, file, page, text, name)
    return chunking.chunks(found.select(F.col("file").alias("path"), "title", "section_path", "page", F.lit(0).alias("seq"), F.col("block_index").alias("block_seq"), "kind", "text"), size, overlap, chunking.PAPERS)


def table_markdown(rows: list[list[str | None]]) -> str:
    """A grid of cells as a markdown table: a heading, a divider and the padded rest; empty rows are dropped."""
    cells = [[" ".join((c or "").split()) for c in r] for r in rows]
    cells = [r for r in cells if any(r)]
    if not cells:
        return ""
    width = max(map(len, cells))
    padded = [r + [""] * (width - len(r)) for r in cells]
    body = padded[1:] or [[""] * width]
    return "\n".join("| " + " | ".join(r) + " |" for r in [padded[0], ["---"] * width, *body])
