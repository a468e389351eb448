"""Every query over dirty and over empty tables: nulls in any column, empty and very long texts, repeated rows,
other columns whose names operators use inside."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillmere.llm import registry

TABLES = ("search_notes", "indexing_pages", "indexing_chunks", "chunking_blocks", "documents", "subject_labels", "subject_areas", "eval_items", "mix_targets", "chunk_limits", "tokenizer_merges")
CLASH = ("id", "h", "t", "d", "key", "kind", "n", "range", "file", "part", "own", "word", "line", "rank", "n_tokens", "text_", "labels", "lang_", "row", "other", "size")


def _set(t: pa.Table, column: str, at: dict) -> pa.Table:
    values = t.column(column).to_pylist()
    for k, v in at.items():
        values[k % len(values)] = v
    return t.set_column(t.schema.get_field_index(column), t.schema.field(column), pa.array(values, t.schema.field(column).type))


@pytest.fixture(scope="module")
def dirty(tiny, tmp_path_factory):
    base = tmp_path_factory.mktemp("dirty")
    for name in TABLES:
        t = pq.read_table(f"{tiny}/{name}.parquet")
        whole = t
        ids = {"note_row", "page_id", "block_id", "doc_id", "item_id"}
        for k, column in enumerate(t.column_names):
            if column not in ids:
                t = _set(t, column, {k: None})
        if "text" in t.column_names and name not in ("eval_items",):
            long = " ".join(str(x) for x in whole.column("text").to_pylist()[:40] if x) * 12
            t = _set(t, "text", {20: "", 21: " \n ", 22: long, 23: "a" * 50_000, 24: "\n\n\n", 25: "é" * 3 + "́" * 2000 + "😀".encode("utf-16", "surrogatepass").decode("utf-16")})
        t = pa.concat_tables([t, t.slice(0, 5)])
        for c in CLASH:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([c] * len(t)))
        pq.write_table(t, base / f"{name}.parquet")
    return str(base)


@pytest.fixture(scope="module")
def empty(tiny, tmp_path_factory):
    base = Path(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        pq.write_table(pq.read_table(f"{tiny}/{name}.parquet").slice(0, 0), base / f"{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_dirty(spark, dirty, name):
    rows = registry.queries()[name](spark, dirty).collect()
    assert len(rows) > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0
