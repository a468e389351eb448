"""Sources: trees of markdown notes, PDFs, and the tables of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders whose notes are no content.
EXCLUDED = (".git", ".obsidian", ".smart-env", "PDF")


def notes(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """The markdown notes below a folder: path (relative), text. Folders in `excluded` are left out."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = F.concat(F.regexp_replace(F.lit(root), "^file:/*|/+$", ""), F.lit("/"))
    full = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"\+", "%2B"), "^file:/*", ""))
    at = F.when(full.startswith(F.regexp_replace(base, "^/+", "")), F.substring(full, F.length(F.regexp_replace(base, "^/+", "")) + 1, F.length(full))).otherwise(full)
    return rows.select(at.alias("path"), F.col("value").alias("text")).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """The PDFs below a folder: path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root).select("path", "content")


def pages(files: DataFrame, backends: dict[str, Callable[[bytes], list[str]]], parser: str = "auto") -> DataFrame:
    """The pages of PDFs: source_path, page, parser, text, warning. A backend returns the texts of a file's pages; with
    `auto` the next one is tried where one fails. No backend comes with this package; files that none reads get a row
    without text that says why."""
    order = list(backends) if parser == "auto" else [parser]
    if missing := [p for p in order if p not in backends]:
        raise ValueError(f"no such backend: {missing[0]}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in batch.itertuples(index=False):
                warnings = []
                for name in order:
                    try:
                        texts = backends[name](content)
                    except Exception as e:  # noqa: BLE001
                        warnings.append(f"{name}: {type(e).__name__}")
                        continue
                    out += [(path, i, name, t, "; ".join(warnings) or None) for i, t in enumerate(texts, 1) if t.strip()]
                    break
                else:
                    out.append((path, None, None, None, "; ".join(warnings) or "no backend"))
            yield pd.DataFrame(out, columns=["source_path", "page", "parser", "text", "warning"]).astype({"page": "Int64"})

    return files.mapInPandas(run, "source_path string, page int, parser string, text string, warning string")
