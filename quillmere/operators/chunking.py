"""Chunks: a recursive splitter, a splitter of code, and a packer of typed blocks.

Packing never crosses a run of blocks of one note and section. Notes are parsed and packed whole, a note a row, without a
shuffle; blocks that are rows of their own are sorted within their files and packed as they come by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import structure

#: What chunks call the kinds of block, and where texts that are too long part.
LABELS = {"table": "Table", "figure_caption": "Figure Caption", "abstract": "Abstract", "formula": "Formula", "diagram": "Diagram", "image": "Image", "code_block": "Code Block"}
SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")
PAPER_SEPARATORS = (". ", "; ", ", ", " ", "")


@dataclass(frozen=True)
class Rules:
    """How a packer treats kinds of block: `special` ones never begin behind a full chunk, `stops` end the overlap,
    `labels` head a block's text, `parts` says whether special blocks over the size are cut."""

    special: frozenset[str]
    stops: frozenset[str]
    labels: dict[str, str]
    separators: tuple[str, ...]
    parts: bool


NOTES = Rules(frozenset({"table", "figure_caption", "formula", "diagram", "image", "code_block"}), frozenset({"table", "figure_caption", "formula", "diagram", "image", "code_block"}), LABELS, SEPARATORS, True)
PAPERS = Rules(frozenset({"table", "figure_caption"}), frozenset({"table"}), {k: LABELS[k] for k in ("table", "figure_caption")}, PAPER_SEPARATORS, False)


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first of the separators that is there, parts that are still too
    long at the next ones; neighbouring pieces share whole parts of up to `overlap` characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep = separators[at]
    parts = list(text) if sep == "" else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    current: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if current:
                out.append("".join(current))
                current, length = [], 0
            out += recursive_split(part, size, overlap, separators[at + 1 :])
            continue
        if length + len(part) > size and current:
            out.append("".join(current))
            while current and (length > overlap or length + len(part) > size):
                length -= len(current.pop(0))
        current.append(part)
        length += len(part)
    if current:
        out.append("".join(current))
    return [p.strip() for p in out if p.strip()]


def split_code(text: str, head: str, size: int, overlap: int, label: str = "Code Block\n") -> list[str]:
    """A code block in runs of whole lines, each fenced again, whose chunks have at most `size` characters where a line
    allows it. A run begins with the last lines of its forerunner, up to `overlap` characters, if its own first line still
    fits behind them; no line is a chunk twice."""
    lines = text.split("\n")
    fence = lines[0] if lines[0].strip().startswith(("```", "~~~")) else "```"
    body = lines[1:]
    if body and body[-1].strip().startswith(fence.strip()[:3]):
        body = body[:-1]
    body = body or [""]
    wrapped = lambda i, j: "\n".join([fence, *body[i:j], fence.strip()[:3]])
    fits = lambda i, j: len(joined(head, label + wrapped(i, j))) <= size
    out, start, at = [], 0, 0
    while at < len(body):
        end = at + 1
        while end < len(body) and fits(start, end + 1):
            end += 1
        out.append(wrapped(start, end))
        back, held = end, 0
        while back > start + 1 and held < overlap:
            back -= 1
            held += len(body[back]) + 1
        start, at = (back if end < len(body) and fits(back, end + 1) else end), end
    return out


def joined(*parts: str) -> str:
    """A chunk's text."""
    return structure.normal("\n\n".join(p for p in parts if p))


def prefix(title: str | None, section_path: str | None, rules: Rules = NOTES) -> str:
    """What a chunk's text begins with: title and path of sections. Notes name them once if they say the same."""
    parts = [structure.normal(p) for p in (title or "", section_path or "")]
    if rules is NOTES:
        parts = list(dict.fromkeys(parts))
    return " | ".join(p for p in parts if p and p != "Document")


def pack(blocks: list[tuple[str, str]], size: int, overlap: int, head: str, rules: Rules = NOTES) -> list[tuple[str, list[int], str]]:
    """Chunks of one run of blocks (kind, text): kind (or `mixed`), the blocks' places in the run, and the text.

    A block weighs what it would alone. A chunk takes blocks while their weights stay within the size; the next one then
    begins with its last blocks, enough for `overlap` characters, but not from before a block that stops it. A special
    block behind a chunk that is full begins anew; one that fills a chunk stands alone or, where rules say so, is cut.
    Paragraphs over the size are cut, and what was to overlap into them is dropped."""
    texts = [f"{rules.labels[k]}\n{t}" if k in rules.labels else t for k, t in blocks]
    weights = [len(joined(head, t)) for t in texts]
    out: list[tuple[str, list[int], str]] = []

    def close(held: list[int]) -> None:
        kinds = {blocks[i][0] for i in held}
        out.append((kinds.pop() if len(kinds) == 1 else "mixed", held, joined(head, *(texts[i] for i in held))))

    def shared(held: list[int]) -> list[int]:
        if overlap <= 0 or len(held) < 2:
            return []
        first = len(held) - 1
        while first > 0 and sum(weights[i] for i in held[first:]) < overlap and blocks[held[first - 1]][0] not in rules.stops:
            first -= 1
        return held[first:]

    def cut(i: int) -> None:
        kind, text = blocks[i]
        if kind == "code_block":
            pieces = [f"{rules.labels[kind]}\n{x}" for x in split_code(text, head, size, overlap)]
        else:
            pieces = recursive_split(text, size, overlap, rules.separators)
        out.extend((kind, [i], joined(head, x)) for x in pieces)

    held: list[int] = []
    for i, (kind, _) in enumerate(blocks):
        full = sum(weights[j] for j in held)
        if kind in rules.special and held and full >= size:
            close(held)
            held = []
        if kind in rules.special and not held and weights[i] >= size:
            if rules.parts and weights[i] > size:
                cut(i)
            else:
                close([i])
            continue
        if held and full + weights[i] > size:
            close(held)
            held = shared(held)
        if kind == "paragraph" and weights[i] > size:
            cut(i)
            held = []
            continue
        held = [*held, i]
    if held:
        close(held)
    return out


NOTE_CHUNKS = "path string, chunk_index int, title string, section string, section_level int, section_path string, block_kind string, chunk_kind string, block_count int, char_count int, word_count int, text string"


def note_chunks(notes: DataFrame, path: str = "path", text: str = "text", size: int = 1200, overlap: int = 200) -> DataFrame:
    """The chunks of notes, numbered within each note from 0: sections, blocks and packing in one pass over a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in batch.itertuples(index=False):
                found = structure.sections_of(content or "")
                title = structure.title_of(found, name)
                n = 0
                for section, level, section_path, body in found:
                    own = structure.section_blocks(section, body)
                    for kind, places, t in pack(own, size, overlap, prefix(title, section_path)):
                        out.append((name, n, title, section, level, section_path, own[places[0]][0], kind, len(places), len(t), len(t.split()), t))
                        n += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NOTE_CHUNKS.split(", ")])

    return notes.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInPandas(run, NOTE_CHUNKS)


def chunks(blocks: DataFrame, size: int = 1200, overlap: int = 200, rules: Rules = NOTES) -> DataFrame:
    """Chunks of blocks (path, title, section_path, seq, block_seq, kind, text, page): path, chunk_index (within the path, from
    0), title, section_path, page (of the first block), block_kind, chunk_kind, block_count, char_count, word_count, text.
    A run of blocks of one title and section_path is packed by itself. `page` may be missing."""
    paged = blocks if "page" in blocks.columns else blocks.withColumn("page", F.lit(None).cast("int"))
    columns = ["path", "title", "section_path", "page", "kind", "text"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from batch.astype(object).where(batch.notna(), None)[columns].itertuples(index=False, name=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, n = [], None, 0
        for (path, title, section_path), own in groupby(rows(batches), key=lambda r: r[:3]):
            last, n = path, n if path == last else 0
            held = list(own)
            for kind, places, t in pack([r[4:] for r in held], size, overlap, prefix(title, section_path, rules), rules):
                out.append((path, n, title, section_path, held[places[0]][3], held[places[0]][4], kind, len(places), len(t), len(t.split()), t))
                n += 1
            if len(out) >= 5000:
                yield _frame(out)
                out = []
        yield _frame(out)

    sorted_ = paged.select("path", "title", "section_path", "page", "kind", "text", "seq", "block_seq").repartition("path").sortWithinPartitions("path", "seq", "block_seq")
    return sorted_.mapInPandas(run, CHUNKS)


CHUNKS = "path string, chunk_index int, title string, section_path string, page int, block_kind string, chunk_kind string, block_count int, char_count int, word_count int, text string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")]).astype({"page": "Int32"})


def split_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Fixed-size pieces of texts: id, piece (from 0), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, i, p) for d, t in batch.itertuples(index=False) for i, p in enumerate(recursive_split(t or "", size, overlap))], columns=[id_col, "piece", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, piece int, text string")
