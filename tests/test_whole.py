"""Registered queries do the whole job, not a part of it."""

import math
import random
import re
from collections import Counter

import pytest

from quillmere.operators import retrieval
from quillmere.plans import registry


def _brute_bm25(docs, queries, k):
    words = {d: re.findall(r"\w+", t.lower()) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    tf = {d: Counter(w) for d, w in words.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries:
        score = {}
        for term in set(re.findall(r"\w+", text.lower())):
            idf = math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5))
            for d, c in tf.items():
                if n := c[term]:
                    score[d] = score.get(d, 0.0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
        best = sorted((-round(s, 9), d) for d, s in score.items())[:k]
        out += [(q, d, round(-s, 6), n) for n, (s, d) in enumerate(best, 1)]
    return sorted(out)


def test_batch_search_takes_every_item(spark, tmp_path):
    rng = random.Random(1)
    names = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(names, k=rng.randint(3, 30)))) for i in range(1, 61)]
    items = [(i, "Instruction line.\n" + " ".join(rng.sample(names, 4))) for i in (1, 7, 20, 21, 22, 100, 299, 300)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = registry.queries()["fts_bm25_batch"](spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank").collect()
    want = _brute_bm25(docs, [(i, t.split("\n")[-1]) for i, t in items], 5)
    assert sorted((r[0], r[1], r[3]) for r in got) == [(q, d, n) for q, d, _, n in want]
    assert [r[2] for r in sorted(got)] == pytest.approx([s for _, _, s, _ in want], abs=2e-6)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(1, "cat sat", [1.0, 0.0], "a.md"), (2, "cat cat dog", [0.9, 0.1], "b.md"), (3, "cat bird", [0.8, 0.0], "c.md"), (4, "cat tree", [0.1, 0.9], "d.md")], "id int, text string, v array<double>, source_path string")


def test_hybrid_graph_merges_notes_and_boosts(spark, chunks):
    edges = spark.createDataFrame([("note::a.md", "note::far.md", "mirror_of"), ("note::a.md", "note::d.md", "links_to")], "src string, dst string, edge_type string")
    domains = spark.createDataFrame([], "id string, domain string")
    hits, warnings, mode = retrieval.search(chunks, "id", "text", "v", "how does cat relate", [1.0, 0.0], mode="auto", k=4, graph=(edges, domains))
    rows = {r.source_path: r for r in hits.collect()}
    assert (warnings, mode) == ([], "hybrid-graph")
    assert rows["far.md"].origin == "graph" and rows["far.md"].id is None
    assert rows["far.md"].score == pytest.approx(0.6 * 1.4)
    assert rows["d.md"]["rank"] == 1 and rows["d.md"].id == 4


def test_hybrid_graph_without_a_graph_says_so(chunks):
    hits, warnings, mode = retrieval.search(chunks, "id", "text", "v", "cat", [1.0, 0.0], mode="hybrid-graph", k=2)
    assert (mode, len(warnings), hits.count()) == ("hybrid", 1, 2)


def test_llm_reranks_by_replies_or_warns(chunks):
    hits, warnings, _ = retrieval.search(chunks, "id", "text", "v", "cat", mode="fts", reranker="llm", k=2, replier=lambda texts: ["90" if "bird" in t else "5" for t in texts])
    assert hits.first().id == 3 and not warnings
    assert retrieval.search(chunks, "id", "text", "v", "cat", mode="fts", reranker="llm", k=2)[1]


def test_governed_files_seed_only_where_there_is_no_other(spark, chunks):
    edges = spark.createDataFrame([("note::a.md", "note::far.md", "mirror_of"), ("note::b.md", "note::off.md", "mirror_of")], "src string, dst string, edge_type string")
    domains = spark.createDataFrame([], "id string, domain string")
    found = lambda *governed: {r.source_path for r in retrieval.search(chunks, "id", "text", "v", "cat", [1.0, 0.0], mode="hybrid-graph", k=6, graph=(edges, domains), governed=governed)[0].collect()}
    assert {"far.md", "off.md"} <= found()
    assert "far.md" not in found("a.md")
    assert "far.md" in found("a.md", "b.md", "c.md", "d.md")
