"""Searches of the graph without a row for each mention: the same as over all rows, and no more rows than they need."""

import pytest
from pyspark.sql import functions as F

from quillmere.operators import graph
from quillmere.plans import graphs


@pytest.fixture(scope="module")
def both(spark):
    names = ["Alpha", "Beta", "Gamma", "Delta Ray", "C++"]
    rows = []
    for p in range(40):
        for branch, k in (("EN", p), ("UA", p // 5)):
            path = f"{branch}/{p % 4}. T/{p % 4}.{p}. N{p}.md"
            rows.append((path, names[k % 5], branch, [branch.lower(), f"t{p % 3}"], [f"{branch}/{p * 3 % 4}. T/{p * 3 % 4}.{p * 3 % 40}. N{p * 3 % 40}.md"], [f"10.1/{p % 7}"], f"The {names[p % 5]} and {names[(p + 1 + p // 7) % 5].lower()} of delta, ray, alphas."))
    notes = spark.createDataFrame(rows, "path string, title string, branch string, tags array<string>, links array<string>, dois array<string>, text string")
    return graph.build(notes), graph.parts(notes)


def test_edges_are_counted_without_rows(both):
    count = lambda g: {r.edge_type: r["count"] for r in graph.edge_counts(g[1], g[2]).collect()}
    assert count(both[0]) == count(both[1])
    assert count(both[1])["mentions_entity"] > 0 and "rows" not in vars(both[1][1])


@pytest.mark.parametrize("query", ["alpha", "delta ray", "beta en t1"])
@pytest.mark.parametrize("hops", [1, 2, 3])
def test_searches_agree(both, query, hops):
    one, other = ([tuple(r) for r in graph.search(*g, query, 30, hops).collect()] for g in both)
    assert one == other and one


def test_results_agree(both):
    one, other = ([tuple(r) for r in graph.results(*g, "gamma t2", 6).collect()] for g in both)
    assert one == other and one


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_expansions_agree(both, hops):
    seeds = both[0][2].orderBy("id").limit(2).select("id")
    one, other = ([tuple(r) for r in graph.expand(g[1], g[2], seeds, hops, 50).collect()] for g in both)
    assert one == other and one


@pytest.mark.parametrize("query", ["graph_edges_by_type", "graph_search", "graph_search_two_hops", "graph_results", "seed_expansion", "related_notes", "hybrid_graph_merge"])
def test_no_query_writes_mentions_out(spark, tiny, monkeypatch, query):
    def rows(*_):
        raise AssertionError("a row for each mention")

    monkeypatch.setattr(graph, "build", rows)
    monkeypatch.setattr(graph.Families, "rows", property(rows))
    assert graphs.QUERIES[query](spark, tiny).count() > 0


def test_a_start_enters_a_domain_once(spark):
    # 30 notes of a domain and no edges: the second step has nothing left to see
    ids = spark.range(30).select(F.concat(F.lit("note::"), "id").alias("id"))
    far = graph._far(ids.limit(3).withColumn("base", F.lit(1.0)), spark.createDataFrame([], "src string, dst string, bonus double"), ids.withColumn("domain", F.lit("1")), 2)
    assert [g.count() for g in far] == [0]
