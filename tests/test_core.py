"""Core operators: known answers, round trips and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import chunking, corpus, graph, retrieval, structure
from quillmere.session import cut
from quillmere.sources import files
from quillmere.streaming import reindex


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_normalize(spark):
    assert one(spark, "A   line \n\n\n with\t\tspaces", X.normalize) == "A line\n with spaces"
    assert one(spark, None, X.normalize) is None


@pytest.mark.parametrize(("value", "want"), [("a " * 30, "a a a a..."), ("short", "short"), ("", "")])
def test_snippet(spark, value, want):
    assert one(spark, value, lambda c: X.snippet(c, 11)) == want


def test_frontmatter(spark):
    note = "---\ntags: [b, 'a', b]\n---\n# T\n[[X|y]] [[X#z]] `c`\n```\n[[no]]\n```\n10.1000/AbC."
    assert one(spark, note, X.tags) == ["a", "b"]
    assert one(spark, note, X.links) == ["X"]
    assert one(spark, note, X.dois) == ["10.1000/AbC"]
    assert one(spark, "---\n---\nx", X.without_frontmatter) in ("x", "---\n---\nx")
    assert one(spark, note, X.without_frontmatter).startswith("# T")


def test_paths(spark):
    assert one(spark, "EN/3. M/3.7.2. Boltz-1.md", X.numeric_id) == "3.7.2"
    assert one(spark, "EN/3. M/3.7.2. Boltz-1.md", X.domain) == "3"
    assert one(spark, "UA/x.md", X.branch) == "UA"
    assert one(spark, "3.7. Alpha — Beta: Gamma", X.title_aliases) == sorted({"Alpha — Beta: Gamma", "Alpha", "Beta: Gamma", "Alpha — Beta", "Gamma", "Beta"} & set(one(spark, "3.7. Alpha — Beta: Gamma", X.title_aliases)))


def test_urls(spark):
    assert one(spark, "see (https://a.org/x_(1).pdf), https://b.org/y).", X.urls) == ["https://a.org/x_(1).pdf", "https://b.org/y"]
    assert one(spark, "https://arxiv.org/abs/1234.5", X.pdf_candidates) == ["https://arxiv.org/abs/1234.5", "https://arxiv.org/pdf/1234.5.pdf"]
    assert one(spark, "https://dx.doi.org/10.48550/ARXIV.77.1", X.pdf_candidates) == ["https://arxiv.org/abs/77.1", "https://arxiv.org/pdf/77.1.pdf", "https://dx.doi.org/10.48550/ARXIV.77.1"]
    assert one(spark, "https://www.openreview.net/forum?x=2&id=q#y", X.pdf_candidates)[0] == "https://openreview.net/pdf?id=q"


@pytest.mark.parametrize(("header", "want"), [("attachment; filename*=UTF-8''my%20paper.v2.pdf", "my_paper.v2.pdf"), ('inline; filename="A (b).pdf"', "A_b.pdf"), (None, "last.pdf"), ("x", "last.pdf")])
def test_file_names(spark, header, want):
    assert one(spark, header, lambda h: X.pdf_file_name(h, F.lit("https://a.org/b/last.html?c=d"))) == want


@pytest.mark.parametrize(("line", "level"), [("# A", 1), ("## A", 2), ("1.2 Title", 2), ("References", 1), ("plain text here.", None), ("Our Own Words Say So and more of it", 1), ("Our own words", None), ("THE WHOLE line here", 1), ("Ends With A Stop.", None), ("1.2. Title:", None), ("", None)])
def test_headings(spark, line, level):
    assert one(spark, line, X.heading_level) == level


def test_router(spark):
    assert one(spark, "[[a]]", X.route) == "fts"
    assert one(spark, "how does a relate to b", X.route) == "hybrid-graph"
    assert one(spark, "GROBID setup", X.route) == "fts"
    assert one(spark, "  ", X.route) == "hybrid"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat sat"), (2, "the dog sat on the cat"), (3, "a bird"), (4, None), (5, ""), (6, "cat cat cat")]
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [0.0], [1.0, 0.1]]
    return spark.createDataFrame([(i, t, v) for (i, t), v in zip(rows, vectors, strict=True)], "id int, text string, v array<double>")


def test_bm25(docs):
    rows = retrieval.bm25(docs, "id", "text", "cat", 2).collect()
    assert [r.id for r in rows] == [6, 1]
    assert retrieval.bm25(docs, "id", "text", "...", 2).count() == 0
    assert retrieval.bm25(docs.limit(0), "id", "text", "cat", 2).count() == 0


def test_batch_equals_single(spark, docs):
    queries = spark.createDataFrame([(1, "cat sat"), (2, "dog"), (3, "")], "q int, t string")
    got = {(r.q, r.id): r.score for r in retrieval.bm25_batch(docs, "id", "text", queries, "q", "t", 10).collect()}
    for q, t in ((1, "cat sat"), (2, "dog")):
        for r in retrieval.bm25(docs, "id", "text", t, 10).collect():
            assert got.pop((q, r.id)) == pytest.approx(r.score)
    assert not got


def test_vectors_and_fusion(docs):
    near = retrieval.nearest(docs, "id", "v", [1.0, 0.0], 3)
    assert [r.id for r in near.collect()] == [1, 6, 2] or [r.id for r in near.collect()] == [1, 6, 3]
    both = retrieval.fuse([near, retrieval.bm25(docs, "id", "text", "cat", 3)], "id", 3).collect()
    assert [r["rank"] for r in both] == [1, 2, 3]
    assert both[0].score >= both[1].score >= both[2].score
    assert retrieval.above(near, max_distance=0.5).count() == 2


def test_search_modes(docs):
    hits, warnings, mode = retrieval.search(docs, "id", "text", "v", "cat", None, mode="hybrid", k=2)
    assert mode == "hybrid"
    assert warnings
    assert hits.count() == 2
    scored, _, _ = retrieval.search(docs, "id", "text", "v", "cat", mode="fts", reranker="cross-encoder", k=2, scorer=lambda texts: [len(t) for t in texts])
    assert scored.first().id == 2
    with pytest.raises(ValueError, match="fetch_k"):
        retrieval.search(docs, "id", "text", "v", "cat", k=5, fetch_k=2)
    rows, warnings = retrieval.degrade([("bad", lambda: docs.select(F.raise_error(F.lit("x")))), ("good", lambda: docs.select("id"))])
    assert len(rows) == 6
    assert warnings == ["bad failed: SparkRuntimeException"] or len(warnings) == 1


def test_sections():
    got = structure.sections_of("intro\n# A\ntext\n## B\nmore\n# See also\n- [[x]]\n- [[y]]\n# C\n[[a]] | [[b]]\nlast")
    assert [(s, level, p) for s, level, p, _ in got] == [("Preamble", 0, "Preamble"), ("A", 1, "A"), ("B", 2, "A > B"), ("C", 1, "C")]
    assert got[-1][3] == "C\nlast"
    assert structure.sections_of("") == []


def test_blocks():
    text = "para one\n| a | b |\n|---|---|\n| 1 | 2 |\n```mermaid\ngraph\n```\n$$\nx\n$$\nFigure 2: caption\n![[pic.png]]\nend"
    assert [k for k, _ in structure.blocks_of(text)] == ["paragraph", "table", "diagram", "formula", "figure_caption", "image", "paragraph"]


def test_table_markdown():
    assert structure.table_markdown([["a", None], [None, ""], ["1"]]) == "| a |  |\n| --- | --- |\n| 1 |  |"
    assert structure.table_markdown([]) == ""


def test_trimmed_pages(spark):
    rows = [(i, f"Journal\n{i}\nbody {i} a\nbody {i} b\nPage {i}\nFooter", "f", str(i)) for i in (1, 2)]
    got = structure.trimmed_pages(spark.createDataFrame(rows, "page_id int, text string, source_path string, page_label string")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["body 1 a\nbody 1 b", "body 2 a\nbody 2 b"]
    assert [r.n_removed for r in got] == [4, 4]


def test_recursive_split():
    text = "one two three. four five six. " * 20
    pieces = chunking.recursive_split(text, 80, 20)
    assert all(len(p) <= 80 for p in pieces)
    assert set(text.split()) == {w for p in pieces for w in p.split()}
    assert max(map(len, chunking.recursive_split("x" * 500, 80, 0))) == 80


def _packed(blocks, size, overlap, head="", rules=chunking.NOTES):
    return [(kind, places) for kind, places, _ in chunking.pack(blocks, size, overlap, head, rules)]


def test_packing():
    p, t = ("paragraph", "p" * 50), ("table", "t" * 30)
    assert _packed([p, t, p, ("paragraph", "r" * 10)], 120, 0) == [("mixed", [0, 1]), ("paragraph", [2, 3])]
    # a special block that would pass the size begins a chunk with the last blocks of the one before
    assert _packed([("paragraph", "p" * 700), ("table", "t" * 600)], 1000, 100) == [("paragraph", [0]), ("table", [1])]
    assert _packed([p, p, ("table", "t" * 90)], 120, 40) == [("paragraph", [0, 1]), ("mixed", [1, 2])]
    # the overlap stops at a special block
    assert _packed([p, t, ("paragraph", "q" * 5), ("paragraph", "q" * 80)], 120, 60) == [("mixed", [0, 1, 2]), ("paragraph", [2, 3])]
    # a long paragraph is cut, a long abstract is not; papers keep a long table whole
    assert len(_packed([("paragraph", "word " * 100)], 120, 0)) > 3
    assert _packed([("abstract", "word " * 100)], 120, 0) == [("abstract", [0])]
    assert _packed([("table", "t" * 500)], 120, 0, rules=chunking.PAPERS) == [("table", [0])]
    assert chunking.prefix("A", "A > B") == "A | A > B" and chunking.prefix("A", "A") == "A"
    assert chunking.prefix("A", "A", chunking.PAPERS) == "A | A"


def test_long_code_is_cut_at_lines():
    code = "```py\n" + "\n".join(f"call({k})" for k in range(40)) + "\n```"
    got = chunking.pack([("code_block", code)], 200, 30, "N | N > S")
    assert len(got) > 2 and {k for k, _, _ in got} == {"code_block"}
    assert all(len(t) <= 200 and t.startswith("N | N > S\nCode Block\n```py\n") and t.endswith("```") for _, _, t in got)
    lines = [x for _, _, t in got for x in t.split("\n") if x.startswith("call")]
    assert list(dict.fromkeys(lines)) == [f"call({k})" for k in range(40)]
    assert len(lines) > 40  # they overlap
    alone = chunking.split_code("```\n" + "x" * 500 + "\ny\n```", "", 100, 30)
    assert [t.count("\n") for t in alone] == [2, 2]


def test_chunks_of_blocks_and_notes(spark):
    blocks = [("paragraph", "p" * 50), ("table", "t" * 30), ("paragraph", "q" * 90), ("code_block", "c" * 300), ("paragraph", "r" * 10)]
    df = spark.createDataFrame([("n", "T", "S", 0, i, k, t) for i, (k, t) in enumerate(blocks)] + [("m", None, None, 0, 0, "paragraph", "alone")], "path string, title string, section_path string, seq int, block_seq int, kind string, text string")
    got = chunking.chunks(df, 120, 0).filter("path = 'n'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert all(r.text.startswith("T | S\n") and r.char_count == len(r.text) for r in got)
    notes = spark.createDataFrame([("EN/a.md", "# A\nfirst words\n## B\nmore words\n## References\n- x"), ("b.md", ""), ("c.md", None)], "path string, text string")
    rows = chunking.note_chunks(notes).orderBy("chunk_index").collect()
    assert [(r.path, r.chunk_index, r.title, r.section_path) for r in rows] == [("EN/a.md", 0, "A", "A"), ("EN/a.md", 1, "A", "A > B")]
    assert rows[1].text == "A | A > B\nB\nmore words"


def test_blocks_of_a_paper(spark):
    page = "A Study of Small Things\nAnn Lee, Bo Kim\nIssued 2021\n\nAbstract\nWe look (Lee et al., 2019) at it [2].\n\n1 Start\nIt goes on.\n| a | b |\n\n1.1 Ways\nSome ways are\nlong.\nFigure 2: what is seen\n2 End\nThe last of it."
    second = "More of the end.\nReferences\n[1] Hidden.\n3 After\nHidden too."
    rows = [(1, page, "p.pdf", "p.pdf", 1), (2, second, "p.pdf", "p.pdf", 2), (3, None, "p.pdf", "p.pdf", 3), (4, "Lone words of a page here.", None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, text string, source_path string, source_file string, page int")
    got = structure.page_blocks(df).orderBy("block_index").collect()
    assert [(r.kind, r.section_path, r.section_level) for r in got] == [("abstract", "Abstract", 1), ("paragraph", "Start", 1), ("table", "Start", 1), ("paragraph", "Start > Ways", 2), ("figure_caption", "Start > Ways", 2), ("paragraph", "End", 1), ("paragraph", "End", 1)]
    assert [r.text for r in got][:4] == ["We look  at it .".replace("  ", " "), "It goes on.", "| a | b |", "Some ways are long."]
    assert [r.block_index for r in got] == list(range(7)) and {r.title for r in got} == {"A Study of Small Things"}
    head = structure.paper_heads(df).first()
    assert head.authors == ["Ann Lee", "Bo Kim"] and head.year == "2021"
    chunked = structure.paper_chunks(df, size=60, overlap=0).orderBy("chunk_index").collect()
    assert chunked[0].text.startswith("A Study of Small Things | Abstract\n")
    assert [r.page for r in chunked][-1] == 2 or chunked[-1].page == 1


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("EN/1. A/1.1. Alpha.md", "EN", "Alpha", ["x"], ["EN/1. A/1.2. Beta"], ["10.1/a"], "about Beta"),
        ("UA/1. A/1.1. Alpha.md", "UA", "Alpha", ["x"], [], [], "nothing"),
        ("EN/1. A/1.2. Beta.md", "EN", "Beta", ["y"], ["missing"], ["10.1/A"], "see alpha"),
        ("EN/2. B/2.1. Gamma.md", "EN", "Gamma", [], [], [], "alphabet"),
    ]
    return spark.createDataFrame(rows, "path string, branch string, title string, tags array<string>, links array<string>, dois array<string>, text string")


def test_graph(notes):
    nodes, edges, domains = map(cut, graph.build(notes))
    assert {r.edge_type: r["count"] for r in graph.edge_counts(edges, domains).collect()} == {"has_tag": 6, "cites_doi": 4, "defines_entity": 8, "mentions_entity": 4, "mirror_of": 2, "links_to": 1, "same_top_level_domain": 6}
    assert nodes.filter("node_type = 'doi'").count() == 1
    assert graph.search(nodes, edges, domains, "alpha", 3).first().source_path.endswith("Alpha.md")
    near = graph.expand(edges, domains, notes.filter("path LIKE 'UA%'").select(F.concat(F.lit("note::"), "path").alias("id")), 1)
    assert near.first().source_path == "EN/1. A/1.1. Alpha.md"
    path = graph.explain(edges, domains, "UA/1. A/1.1. Alpha.md", "EN/1. A/1.2. Beta.md").first()
    assert path.cost == pytest.approx(1.6)
    assert path.n_edges == 2
    assert graph.explain(edges, domains, "UA/1. A/1.1. Alpha.md", "EN/2. B/2.1. Gamma.md").count() == 0


def test_graph_search_gives_neighbours_their_whole_share(spark, notes):
    nodes, edges, domains = map(cut, graph.build(notes, spark.createDataFrame([("EN/1. A/1.2. Beta.md", 0, "Ways", "Beta > Ways")], "path string, seq int, section string, section_path string")))
    score = {r.source_path: r.score for r in graph.search(nodes, edges, domains, "gamma", 9).collect()}
    assert score == {"EN/2. B/2.1. Gamma.md": (6 + 2 + 1.5 + 3) + (6 + 2 + 1 + 1.5)}  # the note, and the entity it defines
    ways = {r.source_path: r.score for r in graph.search(nodes, edges, domains, "ways", 9).collect()}
    beta, alpha, mirror = "EN/1. A/1.2. Beta.md", "EN/1. A/1.1. Alpha.md", "UA/1. A/1.1. Alpha.md"
    base = 2 + 1 + 2  # the section's words hold the query, but neither its title nor path does
    assert ways == {beta: base, alpha: pytest.approx(0.4 * base), mirror: pytest.approx(0.4 * base)}
    two = {r.source_path: r.score for r in graph.search(nodes, edges, domains, "ways", 9, hops=2).collect()}
    assert two == ways  # whoever is reached at once is not reached again
    assert graph.search(nodes, edges, domains, "ways", 9, hops=0).count() == 1
    with pytest.raises(ValueError, match="positive"):
        graph.search(nodes, edges, domains, "ways", 0)


def test_two_hops_give_a_half(spark):
    nodes = spark.createDataFrame([(f"note::{x}", "note", x, x, x) for x in ("q", "b", "c")], "id string, node_type string, source_path string, title string, search_text string")
    edges = spark.createDataFrame([("note::q", "note::b", "mirror_of"), ("note::b", "note::c", "links_to")], "src string, dst string, edge_type string")
    none = spark.createDataFrame([], "id string, domain string")
    got = {r.source_path: r.score for r in graph.search(nodes, edges, none, "q", 9, hops=2).collect()}
    base = 6 + 2 + 3
    assert got == {"q": base, "b": pytest.approx(base * 1.5), "c": pytest.approx(base * 1.2 / 2)}


def test_graph_results_and_names(spark, notes):
    nodes, edges, domains = map(cut, graph.build(notes, spark.createDataFrame([("EN/1. A/1.2. Beta.md", k, f"S{k}", f"Beta > S{k}") for k in range(4)], "path string, seq int, section string, section_path string")))
    row = {r.source_path: r for r in graph.results(nodes, edges, domains, "beta", 5).collect()}["EN/1. A/1.2. Beta.md"]
    assert row.snippet == "Beta | tags: y | sections: S0, S1, S2"
    assert row.evidence[0].startswith("matched ") and len(row.evidence) == 5
    assert graph.resolve(nodes, "GAMMA") == ("note::EN/2. B/2.1. Gamma.md", [])
    found, warned = graph.resolve(nodes, "alpha.md")
    assert found == "note::EN/1. A/1.1. Alpha.md" and "tied" in warned[0]
    with pytest.raises(ValueError, match="no note"):
        graph.resolve(nodes, "zzz")
    names = {r.id: r.label for r in nodes.select("id", graph.label().alias("label")).collect()}
    assert names["tag::x"] == "tag:x" and names["section::EN/1. A/1.2. Beta.md::Beta > S1"] == "Beta > S1" and names["entity::1.2"] == "beta"


def test_mentions_are_whole_words(spark):
    rows = [(f"EN/1. A/1.{k}. N.md", "EN", t, [], [], [], x) for k, (t, x) in enumerate([("C++ Tools", "---\na: art map\n---\nx"), ("Art Map", "use c++ tools.\n```\nart map\n```"), ("Art", "smart mapping of art maps, cart map"), ("Other", "art map; C++ Toolset")])]
    df = spark.createDataFrame(rows, "path string, branch string, title string, tags array<string>, links array<string>, dois array<string>, text string")
    got = {(r.path[8:11], r.numeric_id, r.alias) for r in graph.mentions(df, graph.entities(df)).collect()}
    assert got == {("1.1", "1.0", "C++ Tools"), ("1.3", "1.1", "Art Map"), ("1.3", "1.2", "Art")}


def test_special_pages_mirror_and_graphs_keep(spark, notes, tmp_path):
    built = graph.build(notes, special=(("UA/1. A/1.1. Alpha.md", "EN/2. B/2.1. Gamma.md"), ("EN/2. B/2.1. Gamma.md", "missing.md")))
    graph.save(built, str(tmp_path / "g"))
    nodes, edges, domains = graph.load(spark, str(tmp_path / "g"))
    assert edges.filter("edge_type = 'mirror_of'").count() == 4
    assert (nodes.count(), domains.count()) == (built[0].count(), built[2].count())
    way = graph.paths_between(edges, domains, "UA/1. A/1.1. Alpha.md", ["EN/2. B/2.1. Gamma.md", "EN/1. A/1.1. Alpha.md"]).collect()
    assert {r.target: r.n_edges for r in way} == {"EN/2. B/2.1. Gamma.md": 1, "EN/1. A/1.1. Alpha.md": 1}
    hits = spark.createDataFrame([("EN/1. A/1.1. Alpha.md", 1.0, 1), ("EN/1. A/1.2. Beta.md", 0.5, 2), ("UA/1. A/1.1. Alpha.md", 0.4, 3)], "source_path string, score double, rank int")
    near = graph.related(nodes, edges, domains, "EN/1. A/1.1. Alpha.md", hits).collect()
    assert [(r.source_path, r["rank"], r.path, r.n_edges) for r in near] == [("EN/1. A/1.2. Beta.md", 1, ["Alpha", "Beta"], 1)]


def test_merge(spark):
    hits = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "source_path string, score double, rank int")
    boosts = spark.createDataFrame([("b", 1.0), ("c", 2.0)], "source_path string, score double")
    assert [(r.source_path, r.origin) for r in graph.merge(hits, boosts, 3).collect()] == [("b", "text"), ("c", "graph"), ("a", "text")]


def test_memories(spark, tmp_path):
    path = str(tmp_path / "memory")
    corpus.append_memory(spark, path, [{"session_id": "s1", "query": "protein folding", "summary": "models"}])
    corpus.append_memory(spark, path, [{"session_id": "s2", "query": "other", "final_answer": "protein"}])
    held = corpus.load_memories(spark, path).withColumn("seq", F.col("session_id"))
    assert [r.session_id for r in corpus.recall(held, "Protein folding models", 3).collect()] == ["s1", "s2"]


def test_index_life(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "the first text", "p", "paragraph", "paragraph", "native", 14, 3), ("b", "the second", "p", "table", "table", None, 10, 2)], "id string, text string, source_path string, chunk_kind string, block_kind string, parser string, char_count int, word_count int")
    assert corpus.health(spark, root)["status"] == "missing"
    corpus.write_chunks(rows, root)
    manifest = corpus.write_manifest(rows, f"{root}/manifest.json", model="none")
    assert manifest["chunk_count"] == 2
    assert manifest["counts"]["parser"] == {"native": 1, "none": 1}
    other = str(tmp_path / "other")
    corpus.write_chunks(rows.limit(1), other)
    corpus.point_to(root, other)
    assert corpus.active(root) == other
    assert corpus.health(spark, root)["row_count"] == 1
    corpus.point_to(root, root)
    assert corpus.health(spark, root)["row_count"] == 2
    assert corpus.health(spark, root, timeout=0.0, retries=0)["status"] == "timeout"
    stored = retrieval.bm25_stored(spark, root, "The first second", 5)
    assert [tuple(r) for r in stored.select("id", "score", "rank").collect()] == [tuple(r) for r in retrieval.bm25(rows, "id", "text", "The first second", 5).select("id", "score", "rank").collect()]
    assert "PushedFilters: [In(term" in stored._jdf.queryExecution().toString() or "In(term" in stored._jdf.queryExecution().toString()
    assert retrieval.bm25_stored(spark, root, "...", 5).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        corpus.write_chunks(rows, root, replace=False)


def test_notes_on_disk(spark, tmp_path):
    corpus.write_note(str(tmp_path), "EN/a.md", "# A\n\n[[Home]]\ntext")
    corpus.write_note(str(tmp_path), "EN/a.md", "more", mode="append")
    corpus.write_mirror(str(tmp_path), "EN/a.md", "UA/a.md")
    (tmp_path / "PDF").mkdir()
    (tmp_path / "PDF" / "x.md").write_text("no")
    got = {r.path: r.text for r in files.notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"EN/a.md", "UA/a.md"}
    assert got["UA/a.md"].endswith("\n🇬🇧 [[EN/a.md|English]]\n")
    assert got["EN/a.md"].endswith("more\n")
    assert corpus.read_note(str(tmp_path), "EN/a.md") == {"path": "EN/a.md", "language_branch": "EN", "title": "A", "content": got["EN/a.md"]}
    for bad in ("", "/x.md", "../x.md", "x.txt", "PDF/x.md"):
        with pytest.raises(ValueError, match="note"):
            corpus.note_path(str(tmp_path), bad)


def test_pdf_backends(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"junk")

    def good(content):
        if not content.startswith(b"%PDF"):
            raise ValueError
        return content.decode().split("\x0c")

    def bad(content):
        raise RuntimeError

    got = files.pages(files.pdf_files(spark, str(tmp_path)), {"bad": bad, "good": good}).collect()
    assert sorted((r.page or 0, r.parser or "") for r in got) == [(0, ""), (1, "good"), (2, "good")]


def test_fetch(spark, tmp_path):
    found = corpus.linked_pdfs(spark.createDataFrame([("n.md", "https://a.org/p https://b.org/q.pdf https://c.org/z")], "path string, text string"))
    folder = str(tmp_path)

    def get(url):
        if url.startswith("https://c"):
            raise OSError
        if url.endswith(".pdf"):
            return b"%PDF-1", "application/pdf", ""
        return b'<a href="/real.pdf">x</a>', "text/html", ""

    assert {r.url: r.status for r in corpus.fetch(found, get, folder).collect()} == {"https://a.org/p": "downloaded", "https://b.org/q.pdf": "downloaded", "https://c.org/z": "failed"}
    assert {r.status: r["count"] for r in corpus.status_counts(corpus.fetch(found, get, folder)).collect()} == {"exists": 2, "failed": 1}


def test_jobs(spark, tmp_path):
    root = str(tmp_path)
    corpus.save_job(root, "j1", label="a", created_at="2025-01-01T00:00:00Z")
    corpus.save_job(root, "j1", status="succeeded", returncode=0)
    corpus.save_job(root, "j2", label="b", created_at="2025-01-02T00:00:00Z")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "job.json").write_text("no json")
    assert [(r.job_id, r.status) for r in corpus.jobs(spark, root).collect()] == [("j2", "queued"), ("j1", "succeeded")]


def test_records(spark, tmp_path):
    corpus.save_job(str(tmp_path), "j", label="a")
    (tmp_path / "j" / "stdout.log").write_text("said")
    assert corpus.job(str(tmp_path), "j")["stdout"] == "said"
    fetched = spark.createDataFrame([("u", "failed", 2), ("v", "exists", 0)], "url string, status string, attempts int")
    assert corpus.write_fetch_manifest(fetched, str(tmp_path / "m" / "fetch.json"))["counts"] == {"failed": 1, "exists": 1}


def test_latest_is_the_same_row_each_time(spark):
    rows = spark.createDataFrame([("a", x) for x in "pqrs"], "id string, text string").withColumn("indexed_at", F.lit("2025-01-01").cast("timestamp"))
    assert len({corpus.latest(rows.repartition(n)).first().text for n in (1, 2, 3)}) == 1


def test_base_scores(spark):
    df = spark.createDataFrame([(0.5, 3.0, 1), (None, 3.0, 2), (None, None, 4)], "score double, distance double, rank int")
    assert [r[0] for r in df.select(retrieval.base_score(df, 4)).collect()] == [0.5, 0.25, 0.25]


def test_bundle(docs):
    got = corpus.bundle("q", {"notes": lambda: docs.limit(2), "bad": lambda: docs.select(F.raise_error(F.lit("x")))})
    assert got["summary"] == "2 notes, 0 bad"
    assert len(got["warnings"]) == 1
    assert json.dumps(got, default=str)


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "id string, text string, indexed_at timestamp"
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write = lambda rows: spark.createDataFrame(rows, "id string, text string, t string").select("id", "text", F.to_timestamp("t").alias("indexed_at")).coalesce(1).write.mode("append").parquet(source)
    frame = spark.createDataFrame([], schema).schema
    write([("a", "old", "2025-01-01"), ("b", "x", "2025-01-01")])
    reindex.follow(spark, source, frame, target, mark, parts=3).awaitTermination(120)
    write([("a", "new", "2025-02-01"), ("c", "y", "2025-01-01"), ("b", "late", "2024-01-01")])
    reindex.follow(spark, source, frame, target, mark, parts=3).awaitTermination(120)
    assert {r.id: r.text for r in spark.read.parquet(target).collect()} == {"a": "new", "b": "x", "c": "y"}
