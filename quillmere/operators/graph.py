"""A typed property graph over notes: building, scored search, expansion from seeds, weighted paths.

Nodes and edges are two tables. Notes of one top-level domain are all linked to each other; these links are never
written out pair by pair but kept as membership in the domain, from which searches take sums and pairs are counted. So are
mentions in `parts`, the graph that searches work on.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.session import cut

#: What an edge adds in a search, in an expansion, and what it costs on a path.
SEARCH_BONUS = {"mirror_of": 1.5, "links_to": 1.2, "defines_entity": 1.15, "mentions_entity": 1.0, "has_section": 1.0, "has_tag": 0.9, "cites_doi": 0.9, "same_top_level_domain": 0.4}
EXPANSION_BONUS = {"mirror_of": 1.4, "links_to": 1.1, "defines_entity": 1.05, "mentions_entity": 0.95, "has_tag": 0.8, "cites_doi": 0.8, "has_section": 0.5, "same_top_level_domain": 0.25}
PATH_COST = {"mirror_of": 0.8, "links_to": 1.0, "defines_entity": 0.7, "mentions_entity": 0.9, "has_tag": 1.2, "cites_doi": 1.3, "same_top_level_domain": 2.6, "has_section": 4.0}


def weight(values: dict[str, float], otherwise: float, kind: str = "edge_type") -> Column:
    out = F.lit(otherwise)
    for name, v in values.items():
        out = F.when(F.col(kind) == name, v).otherwise(out)
    return out


def note_nodes(notes: DataFrame) -> DataFrame:
    """Notes (path, title, branch, tags, links, doi, text) as nodes."""
    return notes.select(F.concat(F.lit("note::"), "path").alias("id"), F.lit("note").alias("node_type"), F.col("path").alias("source_path"), "title", F.col("branch").alias("language_branch"), F.nullif(X.numeric_id(F.col("path")), F.lit("")).alias("numeric_id"), F.nullif(X.domain(F.col("path")), F.lit("")).alias("top_level_domain"), F.lower(F.concat_ws("\n", "title", "path", F.array_join("tags", " "))).alias("search_text"))


def entities(notes: DataFrame) -> DataFrame:
    """Entities: numeric_id, label (an EN note's title if there is one), aliases (of all its notes)."""
    rows = notes.select("path", "branch", "title", X.numeric_id(F.col("path")).alias("numeric_id"), X.title_aliases(F.col("title")).alias("aliases")).filter("numeric_id != ''")
    label = F.max_by(F.element_at("aliases", 1), F.struct(F.when(F.col("branch") == "EN", 1).otherwise(0), "path"))
    return rows.filter(F.size("aliases") > 0).groupBy("numeric_id").agg(label.alias("label"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def _aliases(known: DataFrame) -> DataFrame:
    return known.select("numeric_id", F.explode("aliases").alias("alias"))


def said(texts: DataFrame, aliases: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """Which of some aliases (alias, distinct) notes (path, text) say: path, alias; whole words, outside front matter and fences.
    Aliases meet the notes' words by their first two words; those that are not one plain word are then looked up in the texts
    of the notes they met. Aliases without a word are said nowhere."""
    own = aliases.select("alias", X.words(F.col("alias")).alias("a")).filter(F.size("a") > 0)
    keyed = own.select("alias", F.array_join(F.slice("a", 1, 2), " ").alias("key"), (F.lower("alias") == F.element_at("a", 1)).alias("plain"))
    body = F.regexp_replace(X.without_frontmatter(F.col("text")), r"(?s)```.*?```", "")
    bodies = texts.filter("text IS NOT NULL").select("path", body.alias("body"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    keys = bodies.select("path", X.words(F.col("body")).alias("w")).select("path", F.explode(F.concat(F.array_distinct("w"), pairs)).alias("key"))
    met = cut(keys.join(_sent(cut(keyed), most_broadcast), "key").select("path", "alias", "plain").distinct())
    plain, open_ = met.filter("plain").select("path", "alias"), met.filter("NOT plain").select("path", "alias")
    # no letter, digit or underscore may stand beside the alias, whose signs are quoted
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace("alias", r"(?U)([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    return plain.unionByName(bodies.join(_sent(open_, most_broadcast), "path").filter(F.rlike("body", pattern)).select("path", "alias").distinct())


def _sent(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows that are there already, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def mentions(notes: DataFrame, known: DataFrame) -> DataFrame:
    """Notes that mention another note's entity: path, numeric_id, alias (the first that matches)."""
    called = _aliases(known)
    met = said(notes, called.select("alias").distinct()).join(called, "alias").filter(X.numeric_id(F.col("path")) != F.col("numeric_id"))
    return met.groupBy("path", "numeric_id").agg(F.min("alias").alias("alias"))


def mirrors(notes: DataFrame) -> DataFrame:
    """Pairs of notes of the same number where exactly two have it: numeric_id, a, b (a < b)."""
    rows = notes.select("path", X.numeric_id(F.col("path")).alias("numeric_id")).filter("numeric_id != ''")
    return rows.groupBy("numeric_id").agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).filter("n = 2").drop("n")


def resolved_links(notes: DataFrame) -> DataFrame:
    """Links to known notes: path, target (as written, else with `.md`)."""
    out = notes.select("path", F.explode("links").alias("link"))
    paths = notes.select(F.col("path").alias("target")).distinct()
    exact = out.join(paths, F.col("link") == F.col("target"), "left_semi").select("path", F.col("link").alias("target"))
    longer = out.join(paths, F.col("link") == F.col("target"), "left_anti").withColumn("target", F.concat("link", F.lit(".md"))).join(paths, "target", "left_semi").select("path", "target")
    return exact.unionByName(longer).distinct()


class Rows:
    """Edges as a table (src, dst, edge_type), as steps ask for them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def of(self, kind: str) -> DataFrame:
        return self.rows.filter(F.col("edge_type") == kind).select("src", "dst")

    def between_notes(self) -> DataFrame:
        return self.rows.filter(F.col("src").startswith("note::") & F.col("dst").startswith("note::") & (F.col("src") != F.col("dst")))

    def near(self, front: DataFrame, to_notes: bool = False) -> DataFrame:
        """The edges from the rows of a frontier (column `at`): its columns, dst, edge_type; `to_notes` only those to notes."""
        out = front.join(self.rows.withColumnRenamed("src", "at"), "at").select(*front.columns, "dst", "edge_type")
        return out.filter(F.col("dst").startswith("note::")) if to_notes else out

    def sums(self, values: DataFrame) -> DataFrame:
        """What nodes (id, value) that are no notes give the notes around them together: id, base; a node and note count once."""
        pairs = self.rows.select(F.col("src").alias("id"), "dst").distinct()
        return values.join(pairs, "id").filter(F.col("dst").startswith("note::")).groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("base"))

    def counts(self) -> DataFrame:
        return self.rows.groupBy("edge_type").count()


class Families(Rows):
    """Edges by type, each read only by the steps that need it. Mentions are never written out pair by pair, as they grow with
    the square of the notes: they are kept as what notes say (src, alias) and what entities are called (alias, dst)."""

    def __init__(self, both: dict[str, DataFrame], one_way: dict[str, DataFrame], texts: DataFrame, called: DataFrame):
        self.both, self.one_way, self.texts, self.called = both, one_way, texts, called

    @cached_property
    def said(self) -> DataFrame:
        return cut(said(self.texts, self.called.select("alias").distinct()).select(F.concat(F.lit("note::"), "path").alias("src"), "alias"))

    @cached_property
    def rows(self) -> DataFrame:
        mentioned = self.said.join(self.called, "alias").filter(_other("src", "dst")).select("src", "dst").distinct()
        both = self.both | {"mentions_entity": mentioned}
        every = [d.select("src", "dst", F.lit(t).alias("edge_type")) for t, d in (both | self.one_way).items()]
        return reduce(DataFrame.unionByName, every + [d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(t).alias("edge_type")) for t, d in both.items()])

    def of(self, kind: str) -> DataFrame:
        """The edges of a type, from notes only where it has both directions."""
        return (self.both | self.one_way)[kind].select("src", "dst") if kind in self.both or kind in self.one_way else super().of(kind)

    def between_notes(self) -> DataFrame:
        pairs, linked = self.both["mirror_of"], self.one_way["links_to"]
        turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return pairs.unionByName(turned).withColumn("edge_type", F.lit("mirror_of")).unionByName(linked.withColumn("edge_type", F.lit("links_to"))).filter("src != dst")

    def near(self, front: DataFrame, to_notes: bool = False) -> DataFrame:
        front = cut(front)
        sent, own = _sent(front), front.columns
        kept = [*own, "dst", "edge_type"]
        out = [self.between_notes_from(sent).select(kept)]
        for kind, d in self.both.items():
            if kind != "mirror_of":
                turned = sent.join(d.select(F.col("dst").alias("at"), F.col("src").alias("dst")), "at")
                out += [x.withColumn("edge_type", F.lit(kind)).select(kept) for x in ([turned] if to_notes else [turned, sent.join(d.withColumnRenamed("src", "at"), "at")])]
        if not to_notes and "has_section" in self.one_way:
            out.append(sent.join(self.one_way["has_section"].withColumnRenamed("src", "at"), "at").withColumn("edge_type", F.lit("has_section")).select(kept))
        known = front.filter(F.col("at").startswith("entity::"))
        if known.limit(1).count():
            named = cut(known.join(self.called.withColumnRenamed("dst", "at"), "at"))
            met = self.said.withColumnRenamed("src", "dst").join(_sent(named), "alias").filter(_other("dst", "at"))
            out.append(met.select(*own, "dst").distinct().withColumn("edge_type", F.lit("mentions_entity")).select(kept))
        if not to_notes:
            heard = cut(self.said.withColumnRenamed("src", "at").join(sent, "at"))
            out.append(self.called.join(_sent(heard), "alias").filter(_other("at", "dst")).select(*own, "dst").distinct().withColumn("edge_type", F.lit("mentions_entity")).select(kept))
        return reduce(DataFrame.unionByName, out)

    def between_notes_from(self, front: DataFrame) -> DataFrame:
        pairs, linked = self.both["mirror_of"], self.one_way["links_to"]
        ways = [(pairs.withColumnRenamed("src", "at"), "mirror_of"), (pairs.select(F.col("dst").alias("at"), F.col("src").alias("dst")), "mirror_of"), (linked.withColumnRenamed("src", "at"), "links_to")]
        return reduce(DataFrame.unionByName, [front.join(d, "at").withColumn("edge_type", F.lit(t)) for d, t in ways])

    def sums(self, values: DataFrame) -> DataFrame:
        around = [values.join(d.select("src", F.col("dst").alias("id")).distinct(), "id").select("src", "value") for kind, d in self.both.items() if kind != "mirror_of"]
        every = reduce(DataFrame.unionByName, [*around, self.mentioned(values)])
        return every.groupBy(F.col("src").alias("id")).agg(F.sum("value").alias("base")).filter("base > 0")

    def mentioned(self, values: DataFrame) -> DataFrame:
        """What entities (id, value) give the notes that mention them, in parts to be summed: src, value. Each alias that a note
        says gives the sum of its entities; those that two of their aliases gave twice, and the note's own, are taken off again."""
        named = cut(self.called.join(values.select(F.col("id").alias("dst"), "value"), "dst"))
        if not named.limit(1).count():
            return named.select(F.col("dst").alias("src"), "value")
        totals = named.groupBy("alias").agg(F.sum("value").alias("value"))
        given = self.said.join(totals, "alias").select("src", "value")
        own = self.both["defines_entity"].distinct().join(named, "dst").join(self.said, ["src", "alias"]).select("src", (-F.col("value")).alias("value"))
        other = named.select("dst", F.col("alias").alias("other"))
        twice = named.join(other, "dst").filter("alias < other")
        heard = self.said.join(twice.select("alias").union(twice.select("other")).distinct(), "alias", "left_semi")
        heard = heard.join(heard.select("src", F.col("alias").alias("other")), "src").filter("alias < other")
        again = heard.join(twice, ["alias", "other"]).filter(_other("src", "dst")).select("src", "alias", "dst", "value").distinct().select("src", (-F.col("value")).alias("value"))
        return given.unionByName(own).unionByName(again)

    def counts(self) -> DataFrame:
        both = [d.select(F.lit(t).alias("edge_type"), F.lit(2).cast("bigint").alias("n")) for t, d in self.both.items()]
        one = [d.select(F.lit(t).alias("edge_type"), F.lit(1).cast("bigint").alias("n")) for t, d in self.one_way.items()]
        entities = self.called.select(F.col("dst").alias("id"), F.lit(2).cast("bigint").alias("value")).distinct()
        said_of = self.mentioned(entities).select(F.lit("mentions_entity").alias("edge_type"), F.col("value").alias("n"))
        return reduce(DataFrame.unionByName, [*both, *one, said_of]).groupBy("edge_type").agg(F.sum("n").alias("count")).filter("count > 0")


def _other(note: str, entity: str) -> Column:
    """Whether an entity is not the note's own."""
    return F.concat(F.lit("entity::"), X.numeric_id(F.regexp_replace(note, "^note::", ""))) != F.col(entity)


def _steps_of(edges: DataFrame | Rows) -> Rows:
    return edges if isinstance(edges, Rows) else Rows(edges)


def build(notes: DataFrame, sections: DataFrame | None = None, special: tuple[tuple[str, str], ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph whose edges (src, dst, edge_type) are a table, with a row for each mention: to be kept. See `parts`."""
    nodes, edges, domains = parts(notes, sections, special)
    return nodes, edges.rows, domains


def parts(notes: DataFrame, sections: DataFrame | None = None, special: tuple[tuple[str, str], ...] = (), texts: DataFrame | None = None) -> tuple[DataFrame, Families, DataFrame]:
    """nodes (id, node_type, ...), edges by type and domains (id, domain) of notes with path, title, branch,
    tags, links, dois and text; sections: path, seq, section, section_path. `special` are paths of pages that mirror one another
    without a number; `texts` are the notes' path and text, if `notes` lack it. Edges of both directions are kept once."""
    nodes = note_nodes(notes)
    note = lambda c: F.concat(F.lit("note::"), c)
    known = entities(notes)
    tags = notes.select(note("path").alias("src"), F.explode("tags").alias("x")).select("src", F.concat(F.lit("tag::"), "x").alias("dst"))
    dois = notes.select(note("path").alias("src"), F.explode("dois").alias("x")).select("src", F.concat(F.lit("doi::"), F.lower("x")).alias("dst"))
    own = notes.select(note("path").alias("src"), X.numeric_id(F.col("path")).alias("numeric_id")).join(known.select("numeric_id"), "numeric_id").select("src", F.concat(F.lit("entity::"), "numeric_id").alias("dst"))
    called = _aliases(known).select("alias", F.concat(F.lit("entity::"), "numeric_id").alias("dst"))
    pairs = mirrors(notes).select(note("a").alias("src"), note("b").alias("dst"))
    if special:
        there = notes.select("path").distinct()
        named = notes.sparkSession.createDataFrame(list(special), "a string, b string")
        pairs = pairs.unionByName(named.join(there.withColumnRenamed("path", "a"), "a").join(there.withColumnRenamed("path", "b"), "b").select(note("a").alias("src"), note("b").alias("dst")))
    linked = resolved_links(notes).select(note("path").alias("src"), note("target").alias("dst"))
    both = {"has_tag": tags, "cites_doi": dois, "defines_entity": own, "mirror_of": pairs}
    one_way = {"links_to": linked}
    extra = [tags.select(F.col("dst").alias("id"), F.lit("tag").alias("node_type")), dois.select(F.col("dst").alias("id"), F.lit("doi").alias("node_type")), known.select(F.concat(F.lit("entity::"), "numeric_id").alias("id"), F.lit("entity").alias("node_type"), F.lower(F.array_join("aliases", "\n")).alias("search_text"))]
    if sections is not None:
        at = sections.join(notes.select("path", "title"), "path").select(note("path").alias("src"), F.concat(F.lit("section::"), "path", F.lit("::"), "section_path").alias("dst"), "path", "title", "section", "section_path", "seq")
        one_way["has_section"] = at.select("src", "dst")
        extra.append(at.groupBy(F.col("dst").alias("id")).agg(F.lit("section").alias("node_type"), F.min("path").alias("source_path"), F.min("title").alias("title"), F.min_by("section", "seq").alias("section"), F.min("seq").alias("seq"), F.lower(F.concat_ws(" ", F.min("path"), F.min("title"), F.min_by("section", "seq"), F.min("section_path"))).alias("search_text")))
    for e in extra:
        named = e if "search_text" in e.columns else e.withColumn("search_text", F.lower(F.regexp_replace("id", "^[a-z]+::", "")))
        nodes = nodes.unionByName(named.distinct(), allowMissingColumns=True)
    domains = nodes.filter("node_type = 'note' AND top_level_domain IS NOT NULL").select("id", F.col("top_level_domain").alias("domain"))
    return nodes, Families(both, one_way, notes if texts is None else texts, called), domains


def edge_counts(edges: DataFrame | Rows, domains: DataFrame) -> DataFrame:
    """Edges by type; those within a domain are counted from its size."""
    pairs = domains.groupBy("domain").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).cast("bigint").alias("count")).select(F.lit("same_top_level_domain").alias("edge_type"), "count")
    return _steps_of(edges).counts().unionByName(pairs.filter("count > 0"))


def match(nodes: DataFrame, query: str) -> DataFrame:
    """How well nodes match a query: id, node_type, score (> 0)."""
    low = query.strip().lower()
    tokens = nodes.sparkSession.range(1).select(X.graph_tokens(F.lit(query)).alias("t")).first().t
    title, path = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("source_path", F.lit("")))
    score = F.when((title == low) | (path == low) | (F.col("search_text") == low), 6.0).otherwise(0.0) + F.when(F.contains("search_text", F.lit(low)), 2.0).otherwise(0.0)
    for t in tokens:
        score = score + F.when(F.contains("search_text", F.lit(t)), 1.0).otherwise(0.0) + F.when(F.contains(title, F.lit(t)) | F.contains(path, F.lit(t)), 0.5).otherwise(0.0)
    return nodes.select("id", "node_type", score.alias("score")).filter("score > 0")


def starts(nodes: DataFrame, edges: DataFrame | Rows, hits: DataFrame, ids: DataFrame) -> DataFrame:
    """What a query's hits (`match`) give some notes (column `at`) by themselves: id, evidence; a row for each node that matches."""
    own = hits.filter("node_type = 'note'").join(ids.select(F.col("at").alias("id")), "id").select("id", F.concat(F.lit("matched note `"), F.regexp_replace("id", "^note::", ""), F.lit("`")).alias("evidence"))
    label = F.regexp_replace("dst", "^section::.*?::|^[a-z]+::", "")
    kind = F.when(F.col("node_type") == "section", "matched section `").otherwise("matched `")
    around = _steps_of(edges).near(ids).join(hits.filter("node_type != 'note'").select(F.col("id").alias("dst"), "node_type"), "dst")
    return own.unionByName(around.select(F.col("at").alias("id"), F.concat(kind, label, F.lit("`")).alias("evidence")).distinct())


def bases(edges: DataFrame | Rows, hits: DataFrame) -> DataFrame:
    """What a query's hits (`match`) give notes by themselves: id, base; a note's own match and those of the nodes around it."""
    edges = _steps_of(edges)
    base = hits.filter("node_type = 'note'").select("id", (F.col("score") + 3).alias("base"))
    inside = hits.filter("node_type = 'section'")
    parts = inside.join(edges.of("has_section").select("src", F.col("dst").alias("id")).distinct(), "id").select(F.col("src").alias("id"), (F.col("score") + 2).alias("base")) if inside.limit(1).count() else base.limit(0)
    marks = edges.sums(hits.filter("node_type NOT IN ('note', 'section')").select("id", (F.col("score") + 1.5).alias("value")))
    return base.unionByName(parts).unionByName(marks).groupBy("id").agg(F.sum("base").alias("base"))


def search(nodes: DataFrame, edges: DataFrame | Rows, domains: DataFrame, query: str, k: int = 5, hops: int = 1) -> DataFrame:
    """Notes ranked by their own match and that of their sections, tags, DOIs, entities and of neighbours up to `hops` edges
    between notes away: source_path, score, rank. A neighbour gives its base, times the best bonus among the edges of the last
    step, divided by the number of steps; each note is reached once from each start, by the best of its shortest ways."""
    if k <= 0 or hops < 0:
        raise ValueError("k must be positive and hops not negative")
    return _ranked(nodes, edges, domains, cut(bases(edges, cut(match(nodes, query)))), k, hops)


def _ranked(nodes: DataFrame, edges: DataFrame | Rows, domains: DataFrame, start: DataFrame, k: int, hops: int) -> DataFrame:
    """What `search` gives, from the bases of the notes that match (id, base)."""
    direct = _steps_of(edges).between_notes().groupBy("src", "dst").agg(F.max(weight(SEARCH_BONUS, 0.3)).alias("bonus"))
    gains = [start.select("id", "base")]
    if hops:
        passed = start.select(F.col("id").alias("src"), "base").join(direct, "src")
        better = F.greatest("bonus", F.when(F.col("d0") == F.col("d1"), SEARCH_BONUS["same_top_level_domain"]))
        ends = [domains.select(F.col("id").alias(c), F.col("domain").alias(d)) for c, d in (("src", "d0"), ("dst", "d1"))]
        linked = passed.join(ends[0], "src", "left").join(ends[1], "dst", "left")
        gains.append(linked.select(F.col("dst").alias("id"), (F.col("base") * better).alias("base")))
        # the rest of the domain, less those that an edge links
        sums = start.join(domains, "id").groupBy("domain").agg(F.sum("base").alias("all"))
        within = linked.filter("d0 = d1").groupBy(F.col("dst").alias("id")).agg(F.sum("base").alias("linked"))
        rest = domains.join(sums, "domain").join(start.select("id", F.col("base").alias("own")), "id", "left").join(within, "id", "left")
        gains.append(rest.select("id", ((F.col("all") - F.coalesce("own", F.lit(0.0)) - F.coalesce("linked", F.lit(0.0))) * SEARCH_BONUS["same_top_level_domain"]).alias("base")).filter("base > 1e-9"))
    if hops > 1:
        gains += _far(start, direct, domains, hops)
    total = reduce(DataFrame.unionByName, gains).groupBy("id").agg(F.sum("base").alias("score"))
    order = [F.desc(F.round("score", 9)), F.asc("source_path")]
    out = total.join(nodes.filter("node_type = 'note'").select("id", "source_path"), "id").orderBy(*order).limit(k)
    return out.select("source_path", F.round("score", 3).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _far(start: DataFrame, direct: DataFrame, domains: DataFrame, hops: int) -> list[DataFrame]:
    """What starts (id, base) give notes of two steps away and more: id, base. A start enters each domain once: from then on it
    has seen all its notes. Notes go by numbers, as each start has hundreds of rows."""
    every = start.select("id").union(direct.select("src")).union(direct.select("dst")).union(domains.select("id")).distinct()
    number = cut(every.select("id", F.monotonically_increasing_id().alias("no")))
    as_number = lambda df, c, name: df.withColumnRenamed(c, "key").join(number.select(F.col("id").alias("key"), F.col("no").alias(name)), "key").drop("key")
    ways = cut(as_number(as_number(direct, "src", "at"), "dst", "dst").select("at", "dst", F.col("bonus").alias("value")))
    members = cut(as_number(domains, "id", "at").select("at", "domain"))
    begun = cut(as_number(start.select("id", "base"), "id", "start"))
    front = begun.select("start", F.col("start").alias("at"), "base")
    seen, entered, gains = front.select("start", "at"), None, []
    for n in range(1, hops + 1):
        opened = front.join(members, "at").select("start", "base", "domain").distinct()
        if entered is not None:
            opened = opened.join(entered, ["start", "domain"], "left_anti")
        opened = cut(opened)
        entered = opened.select("start", "domain") if entered is None else entered.unionByName(opened.select("start", "domain"))
        inside = opened.join(members.withColumnRenamed("at", "dst"), "domain").select("start", "base", "dst", F.lit(SEARCH_BONUS["same_top_level_domain"]).alias("value"))
        step = front.join(ways, "at").select("start", "base", "dst", "value").unionByName(inside).groupBy("start", "base", "dst").agg(F.max("value").alias("value"))
        front = step.withColumnRenamed("dst", "at").join(seen, ["start", "at"], "left_anti")
        if n > 1:
            gains.append(front.select("at", (F.col("base") * F.col("value") / n).alias("base")).groupBy("at").agg(F.sum("base").alias("base")))
        if n < hops:
            # the first step's notes gain elsewhere: only where they are is kept, at some hundred rows a start
            front = cut(front) if n > 1 else cut(front.select("start", "at")).join(begun.select("start", "base"), "start")
            seen = seen.unionByName(front.select("start", "at"))
        front = front.select("start", "at", "base")
    return [g.join(number.withColumnRenamed("no", "at"), "at").select("id", "base") for g in gains]


def results(nodes: DataFrame, edges: DataFrame | Rows, domains: DataFrame, query: str, k: int = 5) -> DataFrame:
    """A search's notes as users read them: source_path, title, language_branch, score, rank, snippet (title, up to four tags,
    three sections), evidence (the first five kinds: its own matches, then the edges over which matching neighbours give)."""
    edges, hits = _steps_of(edges), cut(match(nodes, query))
    start = cut(bases(edges, hits))
    top = cut(_ranked(nodes, edges, domains, start, k, 1).withColumn("id", F.concat(F.lit("note::"), "source_path")))  # k rows
    notes = nodes.filter("node_type = 'note'")
    ids = F.broadcast(top.select("id"))
    shown = notes.select("id", "title", "language_branch").join(F.broadcast(top), "id")
    own = starts(nodes, edges, hits, top.select(F.col("id").alias("at"))).select("id", F.lit(0).alias("step"), "evidence")
    near = edges.between_notes().filter("edge_type IN ('mirror_of', 'links_to')").join(ids.withColumnRenamed("id", "dst"), "dst").join(start.select(F.col("id").alias("src")), "src").groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("edge_type")), ", ").alias("t"))
    passed = near.select(F.col("dst").alias("id"), F.lit(1).alias("step"), F.concat(F.lit("expanded via "), "t", F.lit(" from `"), F.regexp_replace("src", "^note::", ""), F.lit("`")).alias("evidence"))
    first = own.unionByName(passed).distinct().withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("step", "evidence"))).filter("n <= 5").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    of = lambda kind, name, most, order: edges.of(kind).join(ids.withColumnRenamed("id", "src"), "src").join(nodes.select(F.col("id").alias("dst"), *order), "dst").select("src", *order, "dst").distinct().withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(*order, "dst"))).filter(F.col("n") <= most).groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.regexp_replace("dst", "^tag::", "").alias("x") if kind == "has_tag" else F.col("section").alias("x")))), lambda v: v["x"]).alias(name))
    tagged = of("has_tag", "tags", 4, ["search_text"])
    out = shown.join(first, "id", "left").join(tagged, "id", "left")
    said = F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", ")))
    parts = [F.col("title"), said]
    if "section" in nodes.columns:
        out = out.join(of("has_section", "sections", 3, ["seq", "section"]), "id", "left")
        parts.append(F.when(F.size("sections") > 0, F.concat(F.lit("sections: "), F.array_join("sections", ", "))))
    return out.select("source_path", "title", "language_branch", "score", "rank", X.snippet(F.concat_ws(" | ", *parts), 220).alias("snippet"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")).orderBy("rank")


def resolve(nodes: DataFrame, query: str) -> tuple[str, list[str]]:
    """The note that a name means: its id and warnings. Ids, paths and titles meet it without case, the smallest path first;
    else the best match does, with a warning that says whether it was one of several. ValueError if none matches."""
    low = query.strip().lower()
    notes = nodes.filter("node_type = 'note'")
    same = notes.filter((F.lower("id") == low) | (F.lower("source_path") == low) | (F.lower("title") == low)).orderBy("source_path").select("id").first()
    if same:
        return same.id, []
    best = match(notes, query).join(notes.select("id", "source_path"), "id").orderBy(F.desc("score"), "source_path").limit(2).collect()
    if not best:
        raise ValueError(f"no note matches {query!r}")
    tied = len(best) > 1 and best[0].score == best[1].score
    return best[0].id, [f"{query!r} taken for {best[0].source_path!r} by a {'tied ' if tied else ''}fuzzy match"]


def label(kind: str = "node_type") -> Column:
    """What a node is called: a note's title, a section's path, `tag:x`, `doi:x`, an entity's first alias, else its id."""
    bare = F.regexp_replace("id", "^[a-z]+::", "")
    return F.when(F.col(kind) == "note", F.coalesce("title", "source_path", "id")).when(F.col(kind) == "section", F.regexp_replace(bare, "^.*?::", "")).when(F.col(kind).isin("tag", "doi"), F.concat(F.col(kind), F.lit(":"), bare)).when(F.col(kind) == "entity", F.element_at(F.split("search_text", "\n"), 1)).otherwise(F.col("id"))


def save(graph: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Keep a graph: nodes, edges by type and clustered by their source, domains."""
    nodes, edges, domains = graph
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("edge_type", F.pmod(F.xxhash64("src"), F.lit(32))).sortWithinPartitions("src").write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
    domains.sort("domain").write.mode("overwrite").parquet(f"{path}/domains")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph that was kept: nodes, edges, domains. Searches read the types of edges and the sources they ask for."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select("src", "dst", "edge_type"), spark.read.parquet(f"{path}/domains")


def paths_between(edges: DataFrame, domains: DataFrame, source: str, targets: list[str], hops: int = 2) -> DataFrame:
    """The lightest way from a note to each of some others (few: a search's hits): target, path, cost, n_edges."""
    out = [explain(edges, domains, source, t, hops, 1).withColumn("target", F.lit(t)) for t in dict.fromkeys(targets) if t != source]
    return reduce(DataFrame.unionByName, out) if out else edges.sparkSession.createDataFrame([], "path array<string>, cost double, n_edges int, target string")


def related(nodes: DataFrame, edges: DataFrame, domains: DataFrame, source: str, hits: DataFrame, k: int = 5, hops: int = 2) -> DataFrame:
    """Hits (source_path, score, rank) around a note: without itself and of its branch, each with the way to it: source_path,
    score, rank, path (labels), n_edges; null where there is none within `hops`."""
    branch = X.branch(F.lit(source))
    kept = hits.filter((F.col("source_path") != source) & (X.branch(F.col("source_path")) == branch)).orderBy("rank").limit(k)
    ways = paths_between(edges, domains, source, [r.source_path for r in kept.select("source_path").collect()], hops)  # k rows
    steps = ways.select("target", "n_edges", F.posexplode("path").alias("at", "id")).join(nodes.select("id", label().alias("label")), "id")
    named = steps.groupBy("target", "n_edges").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("path"))
    return kept.join(named.withColumnRenamed("target", "source_path"), "source_path", "left").select("source_path", "score", F.row_number().over(Window.orderBy("rank")).alias("rank"), "path", "n_edges")


def _steps(frontier: DataFrame, edges: DataFrame | Rows, domains: DataFrame, values: dict[str, float], best: str, to_notes: bool = False) -> DataFrame:
    """One step from the rows of a frontier (column `at`): its columns, dst, and the best value of the edges there;
    `to_notes` only those to notes. Domains are entered from the frontier only."""
    value = weight(values, 0.3 if best == "max" else 3.0)
    near = _steps_of(edges).near(frontier, to_notes).select(*frontier.columns, "dst", value.alias("value"))
    inside = frontier.join(domains.select(F.col("id").alias("at"), "domain"), "at").join(domains.select(F.col("id").alias("dst"), "domain"), "domain").drop("domain").filter("at != dst").withColumn("value", F.lit(values["same_top_level_domain"]))
    rows = near.unionByName(inside.select(*near.columns))
    return rows.groupBy(*frontier.columns, "dst").agg((F.max if best == "max" else F.min)("value").alias("value"))


def expand(edges: DataFrame | Rows, domains: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 20) -> DataFrame:
    """Notes around seed notes (column `id`): source_path, score. From each seed a weight of 1 spreads over all edges,
    times their bonus, less 0.7 for each hop; a node is reached once at each depth, by the greatest weight."""
    seeds = cut(seeds.select("id"))
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), F.lit(1.0).alias("carried"))
    gains = None
    for n in range(1, hops + 1):
        # behind the last step only notes count
        step = _steps(frontier, edges, domains, EXPANSION_BONUS, "max", n == hops).withColumn("gain", F.col("carried") * F.col("value"))
        reached = step.filter("dst != seed").groupBy("seed", "dst").agg(F.max("gain").alias("gain"))
        if n < hops:
            reached = cut(reached)
        part = reached.filter(F.col("dst").startswith("note::")).select("dst", "gain")
        gains = part if gains is None else gains.unionByName(part)
        frontier = reached.select("seed", F.col("dst").alias("at"), (F.col("gain") * 0.7).alias("carried"))
    out = gains.groupBy("dst").agg(F.sum("gain").alias("score"))
    return out.join(_sent(seeds.select(F.col("id").alias("dst"))), "dst", "left_anti").select(F.regexp_replace("dst", "^note::", "").alias("source_path"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "source_path").limit(limit)


def explain(edges: DataFrame, domains: DataFrame, source: str, target: str, hops: int = 3, limit: int = 1) -> DataFrame:
    """The lightest simple paths of at most `hops` edges between two notes: path (ids), cost, n_edges. Edges count in
    both directions; ties go to the shorter path, then to the smaller ids. The last step looks from the target's side."""
    spark = edges.sparkSession
    either = edges.select("src", "dst", "edge_type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))
    start, goal = f"note::{source}", f"note::{target}"
    front = spark.range(1).select(F.lit(start).alias("at"), F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("cost"))
    last = _steps(spark.range(1).select(F.lit(goal).alias("at")), either, domains, PATH_COST, "min").select(F.col("dst").alias("at"), F.col("value").alias("last"))
    found = None
    for n in range(1, hops + 1):
        done = front.join(last, "at").filter(~F.array_contains("path", goal)).select(F.concat("path", F.array(F.lit(goal))).alias("path"), (F.col("cost") + F.col("last")).alias("cost"), F.lit(n).alias("n_edges"))
        found = done if found is None else found.unionByName(done)
        if n < hops:
            step = _steps(front, either, domains, PATH_COST, "min").filter(~F.array_contains("path", F.col("dst")) & (F.col("dst") != goal))
            front = step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("value")).alias("cost"))
    return found.orderBy(F.round("cost", 9), "n_edges", F.array_join("path", " ")).limit(limit)


def merge(hits: DataFrame, boosts: DataFrame, k: int) -> DataFrame:
    """Text hits (source_path, score, rank) and notes that the graph adds (source_path, score): hits gain their note's
    score, other notes enter with 0.6 of theirs. source_path, combined, origin, rank, and the hits' other columns."""
    extra = [c for c in hits.columns if c not in ("source_path", "score", "rank")]
    gained = hits.join(boosts.select("source_path", F.col("score").alias("boost")), "source_path", "left").select("source_path", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("combined"), F.lit("text").alias("origin"), F.col("rank").alias("was"), *extra)
    added = boosts.join(hits.select("source_path"), "source_path", "left_anti").select("source_path", (0.6 * F.col("score")).alias("combined"), F.lit("graph").alias("origin"), F.lit(None).cast("int").alias("was"))
    order = [F.desc("combined"), F.desc(F.col("origin")), F.asc_nulls_last("was"), F.asc("source_path")]
    out = gained.unionByName(added, allowMissingColumns=True).orderBy(*order).limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("was")
