"""Names stay marks however often slips write them small."""

import re

from pyspark.sql import functions as F

from quillmere.llm import alignment as A


def test_names_written_small_now_and_then_lose_no_pairs(spark, tiny):
    notes = spark.read.parquet(f"{tiny}/search_notes.parquet")
    pairs = lambda t: {tuple(r) for r in A.align(t).select("row_a", "sent_a", "row_b", "sent_b").collect()}
    names = sorted({w for r in notes.filter("text IS NOT NULL").select("text").collect() for w in re.findall(r"(?<=[a-zа-яіїє] )[A-Z][a-z]{4,}", r.text)})
    # a note without twin, as large tables have many: each name small in 3 of 63 sentences
    text = "S\n" + " ".join([f"See {', '.join(n.lower() for n in names)}."] * 3 + [f"See {', '.join(names)}."] * 60)
    own = {"note_row": F.lit(9_000_001).cast("bigint"), "text": F.lit(text), "source_path": F.lit("EN/1. Models/1.99999999. X.md")}
    more = notes.limit(1).withColumns(own)
    found = pairs(notes)
    assert found and pairs(notes.unionByName(more)) >= found
