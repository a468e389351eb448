"""Queries of text structure: normalising, ids, statistics, lines and blocks of pages, sections and chunks of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as X
from quillmere.operators import chunking, corpus, structure
from quillmere.session import table
from quillmere.streaming import reindex


def normalize_snippet(spark: SparkSession, base: str) -> DataFrame:
    text = X.normalize(F.col("text"))
    return table(spark, base, "documents").select("doc_id", F.length(text).alias("n_chars"), F.sha1(text).alias("sha"), X.snippet(F.col("text"), 120).alias("snippet"))


def chunk_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "indexing_chunks").select("vec_id", X.chunk_id(F.col("source_path"), F.col("page"), F.col("chunk_index"), F.col("text")).alias("chunk_id")).distinct()


def chunk_stats(spark: SparkSession, base: str) -> DataFrame:
    return corpus.statistics(corpus.latest(table(spark, base, "indexing_chunks").select("vec_id", "source_path", "char_count", "word_count", "indexed_at"), "vec_id"))


def kind_counts(spark: SparkSession, base: str) -> DataFrame:
    return corpus.kinds(table(spark, base, "indexing_chunks"), "chunk_kind", "block_kind", "parser")


def index_projection(spark: SparkSession, base: str) -> DataFrame:
    """What a search returns of a chunk: no vector is read."""
    rows = table(spark, base, "indexing_chunks")
    return corpus.latest(rows.select(*corpus.PDF_COLUMNS, "indexed_at")).select("id", "source_path", "page", "year", "section_path", "chunk_index")


def repeated_lines(spark: SparkSession, base: str) -> DataFrame:
    return structure.repeated_lines(table(spark, base, "indexing_pages"))


def trimmed_pages(spark: SparkSession, base: str) -> DataFrame:
    return structure.trimmed_pages(table(spark, base, "indexing_pages")).select("page_id", "n_removed", F.length("text").alias("n_chars"))


def heading_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "indexing_pages").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    level = X.heading_level(F.col("line"))
    return lines.select("page_id", "line_no", level.alias("level"), X.is_figure_caption(F.col("line")).alias("caption")).filter("level IS NOT NULL OR caption")


def page_years(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "indexing_pages").select("page_id", X.first_year(F.col("text")).alias("year"))


def paper_heads(spark: SparkSession, base: str) -> DataFrame:
    """Title and authors as the first pages give them."""
    pages = table(spark, base, "indexing_pages").filter("page = 1").select("page_id", "source_file", X.text_lines(F.col("text")).alias("lines"))
    title = X.first_title(F.col("lines"), F.col("source_file"))
    return pages.withColumn("title", title).select("page_id", "title", F.array_join(X.first_authors(F.col("lines"), F.col("title")), "|").alias("authors"))


def page_blocks(spark: SparkSession, base: str) -> DataFrame:
    return structure.page_blocks(table(spark, base, "indexing_pages")).select("file", "page", "block_index", "kind", "section", "section_level", F.length("text").alias("n_chars"))


def section_rows(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return structure.sections(docs)


def packed_chunks(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunking.note_chunks(docs).select("path", "chunk_index", "chunk_kind", "block_count", "char_count", "word_count")


def pdf_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Pages, trimmed, as chunks of papers."""
    pages = table(spark, base, "indexing_pages")
    trimmed = structure.trimmed_pages(pages).join(pages.select("page_id", "source_path", "source_file", "page"), "page_id")
    return structure.paper_chunks(trimmed).select("path", "chunk_index", "page", "block_kind", "chunk_kind", "block_count", "char_count", "word_count")


def recursive_split(spark: SparkSession, base: str) -> DataFrame:
    return chunking.split_documents(table(spark, base, "documents"), "doc_id", "text", 400, 50).select("doc_id", "piece", F.length("text").alias("n_chars"))


def note_validation(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").filter(F.col("source_path").endswith(".md"))
    return corpus.note_issues(docs.select(F.concat_ws("#", "source_path", "doc_id").alias("path"), "text"))


def note_fields(spark: SparkSession, base: str) -> DataFrame:
    """Fields of notes: tags, links, numbers and branches from texts and paths."""
    docs = table(spark, base, "documents").filter("source_path IS NOT NULL")
    p = F.col("source_path")
    return docs.select("doc_id", F.array_join(X.tags(F.col("text")), ",").alias("tags"), F.array_join(X.links(F.col("text")), ",").alias("links"), X.branch(p).alias("branch"), X.numeric_id(p).alias("numeric_id"), X.slug(F.col("title"), "note").alias("slug"), X.needs_rich_parser(F.col("text")).alias("rich"))


def notes_filter_list(spark: SparkSession, base: str) -> DataFrame:
    notes = table(spark, base, "search_notes").filter("source_path IS NOT NULL").select(F.col("source_path").alias("path"), "title").distinct()
    return corpus.listed_notes(notes, "EN", "bex", 50)


def url_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Addresses of every form, one text a document."""
    n = F.col("doc_id").cast("string")
    form = [F.concat(F.lit("see https://arxiv.org/abs/"), n, F.lit("v2, too.")), F.concat(F.lit("(https://doi.org/10.48550/arXiv."), n, F.lit(").")), F.concat(F.lit("[a](https://example.org/paper_("), n, F.lit(").pdf) and more")), F.concat(F.lit("https://openreview.net/forum?id=r"), n, F.lit("&x=1"))]
    text = F.when(F.col("doc_id") % 4 == 0, form[0]).when(F.col("doc_id") % 4 == 1, form[1]).when(F.col("doc_id") % 4 == 2, form[2]).otherwise(form[3])
    found = corpus.linked_pdfs(table(spark, base, "documents").select(n.alias("path"), F.concat(text, F.lit("\n"), "text").alias("text")))
    return found.select("url", F.array_join("candidates", " ").alias("candidates"), F.array_join("notes", ",").alias("notes"), "file_name")


def events_by_hour(spark: SparkSession, base: str) -> DataFrame:
    return reindex.activity(table(spark, base, "events")).select("started", "event_type", "n", F.round("value", 4).alias("value"))


def event_sessions(spark: SparkSession, base: str) -> DataFrame:
    return reindex.sessions(table(spark, base, "events"))


QUERIES = {f.__name__: f for f in (normalize_snippet, chunk_ids, chunk_stats, kind_counts, index_projection, repeated_lines, trimmed_pages, heading_lines, page_years, paper_heads, page_blocks, section_rows, packed_chunks, pdf_chunks, recursive_split, note_validation, note_fields, notes_filter_list, url_candidates, events_by_hour, event_sessions)}

#: White space as Spark's engine knows it, for DuckDB's.
_S = r"[\s\x0b\x{85}\p{Z}]"


def _normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '{_S}+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_normal('x')}), lambda x: x <> '')"
def _explicit(x: str) -> str:
    """The level of a line that says it is a heading."""
    number = rf"regexp_extract({x}, '^(\d+(?:\.\d+)*)\s+\S', 1)"
    return rf"""CASE WHEN regexp_matches({x}, '^#{{1,6}}\s+\S') THEN length(regexp_extract({x}, '^(#{{1,6}})\s+\S', 1)) WHEN {number} <> '' AND length({x}) <= 120 THEN length({number}) - length(replace({number}, '.', '')) + 1
      WHEN lower({x}) IN ('references', 'bibliography', 'works cited', 'literature cited', 'abstract') THEN 1 END"""


_LATEST = "indexing_chunks QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY indexed_at DESC NULLS LAST) = 1"
_REPEATED = f"""WITH l AS (SELECT source_path AS file, {_LINES} AS ls FROM indexing_pages WHERE text IS NOT NULL),
 e AS (SELECT file, 'top' AS place, lower(unnest(ls[1:3])) AS line FROM l UNION ALL SELECT file, 'bottom', lower(unnest(ls[-3:])) FROM l),
 s AS (SELECT file, count(*) AS pages FROM l GROUP BY file),
 c AS (SELECT file, place, line, count(*) AS n FROM e GROUP BY ALL),
 rep AS (SELECT file, place, line, n FROM c JOIN s USING (file) WHERE pages > 1 AND n >= CASE WHEN pages <= 3 THEN pages ELSE ceil(pages / 2.0) END)"""

SQL = {
    "normalize_snippet": rf"""
WITH n AS (SELECT doc_id, {_normal("text")} AS t, regexp_replace(regexp_replace(text, '{_S}+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g') AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha1(t) AS sha, CASE WHEN length(f) > 120 THEN regexp_replace(f[1:117], '{_S}+$', '') || '...' ELSE f END AS snippet FROM n""",
    "chunk_ids": "SELECT DISTINCT vec_id, sha1(concat_ws(':', source_path, page::VARCHAR, chunk_index::VARCHAR, text)) AS chunk_id FROM indexing_chunks",
    "chunk_stats": f"""
SELECT count(*) AS chunk_count, count(DISTINCT source_path) AS file_count, round(avg(char_count), 2) AS avg_char_count, min(char_count) AS min_char_count, max(char_count) AS max_char_count,
  round(avg(word_count), 2) AS avg_word_count, min(word_count) AS min_word_count, max(word_count) AS max_word_count FROM (SELECT * FROM {_LATEST.format("vec_id")})""",
    "kind_counts": """
SELECT what, value, count(*) AS count FROM (SELECT 'chunk_kind' AS what, coalesce(chunk_kind, 'none') AS value FROM indexing_chunks
  UNION ALL SELECT 'block_kind', coalesce(block_kind, 'none') FROM indexing_chunks UNION ALL SELECT 'parser', coalesce(parser, 'none') FROM indexing_chunks) GROUP BY ALL""",
    "index_projection": f"SELECT id, source_path, page, year, section_path, chunk_index FROM {_LATEST.format('id')}",
    "repeated_lines": f"{_REPEATED} SELECT file, place, line, n FROM rep",
    "trimmed_pages": f"""{_REPEATED}, k AS (SELECT file, list(line) FILTER (place = 'top') AS tops, list(line) FILTER (place = 'bottom') AS bottoms FROM rep GROUP BY file),
 p AS (SELECT page_id, lower(coalesce(page_label, '')) AS label, coalesce(tops, []) AS tops, coalesce(bottoms, []) AS bottoms, {_LINES} AS ls FROM indexing_pages LEFT JOIN k ON source_path = file WHERE text IS NOT NULL),
 m AS (SELECT page_id, ls, list_transform(ls, lambda x: regexp_full_match(x, '[0-9]{{1,4}}') OR label <> '' AND (lower(x) = label OR regexp_replace(lower(x), '^(page|p\\.)\\s*', '') = label AND regexp_matches(lower(x), '^(page|p\\.)'))) AS num, tops, bottoms FROM p),
 i AS (SELECT page_id, ls, list_filter(range(1, len(ls) + 1), lambda j: NOT (num[j] OR list_contains(tops, lower(ls[j]))))[1] AS a, list_filter(range(1, len(ls) + 1), lambda j: NOT (num[j] OR list_contains(bottoms, lower(ls[j]))))[-1] AS z FROM m)
SELECT page_id, len(ls) - (z - a + 1) AS n_removed, length(array_to_string(ls[a:z], chr(10))) AS n_chars FROM i WHERE z >= a""",
    "heading_lines": rf"""
WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM indexing_pages),
 h AS (SELECT page_id, line_no, line, {_explicit("line")} AS said, list_filter(regexp_split_to_array(line, '{_S}+'), lambda w: w <> '') AS ws,
   length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS caps FROM l),
 k AS (SELECT *, length(line) <= 100 AND NOT regexp_matches(line, '[.!?;:]$') AND len(ws) BETWEEN 1 AND 12 AND (caps >= greatest(4, length(line) // 3) OR len(list_filter(ws[1:5], lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0) AS looks FROM h)
SELECT page_id, line_no, level, caption FROM (SELECT page_id, line_no, coalesce(said, CASE WHEN looks THEN 1 END) AS level, regexp_matches(line, '(?i)^(figure|fig\.)\s*\d+[a-z0-9.-]*[:.]?\s+') AS caption FROM k) WHERE level IS NOT NULL OR caption""",
    "paper_heads": rf"""
WITH p AS (SELECT page_id, source_file, {_LINES} AS ls FROM indexing_pages WHERE page = 1),
 t AS (SELECT *, coalesce(list_filter(ls[1:8], lambda x: ({_explicit("x")}) IS NULL AND length(x) <= 160 AND len(regexp_split_to_array(x, '{_S}+')) >= 3)[1],
   replace(replace(regexp_replace(coalesce(source_file, 'document'), '\.[^.]*$', ''), '_', ' '), '-', ' ')) AS title FROM p),
 a AS (SELECT *, ls[coalesce(list_position(ls, title), 0) + 1:coalesce(list_position(ls, title), 0) + 3] AS after FROM t),
 e AS (SELECT *, list_position(list_transform(after, lambda x: ({_explicit("x")}) IS NOT NULL), true) AS stop FROM a),
 n AS (SELECT page_id, title, list_filter(CASE WHEN stop > 0 THEN after[1:stop - 1] ELSE after END, lambda x: (contains(x, ',') OR contains(lower(x), ' and ')) AND NOT regexp_matches(x, '\d') AND length(x) <= 120 AND len(regexp_split_to_array(x, '{_S}+')) <= 20)[1] AS l FROM e)
SELECT page_id, title, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(l, ',| and '), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS authors FROM n""",
    "page_years": r"SELECT page_id, regexp_extract(text, '\b((?:19|20)\d{2})\b', 1) AS year FROM indexing_pages",
    "note_fields": r"""
WITH d AS (SELECT *, CASE WHEN starts_with(text, '---' || chr(10)) AND strpos(text, chr(10) || '---' || chr(10)) > 0 THEN substr(text, 5, greatest(0, strpos(text, chr(10) || '---' || chr(10)) - 4)) ELSE '' END AS fm,
  regexp_extract(source_path, '([^/]*)$', 1) AS fn, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM documents WHERE source_path IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(fm, '(?m)^tags:[ \t]*\[([^\]\n]*)\]', 1), ','), lambda t: regexp_replace(trim(t), '^["'' ]+|["'' ]+$', '', 'g')), lambda t: t <> ''))), ',') AS tags,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '\[\[([^\]\[]+)\]\]', 1), lambda t: trim(regexp_replace(replace(regexp_replace(t, '[#|].*$', '', 'g'), '\', '/'), '$^', ''))), lambda t: t <> ''))), ',') AS links,
  CASE WHEN starts_with(source_path, 'UA/') THEN 'UA' WHEN starts_with(source_path, 'EN/') THEN 'EN' ELSE 'root' END AS branch,
  regexp_extract(fn, '^(\d+(?:\.\d+)*)\.', 1) AS numeric_id,
  CASE WHEN length(regexp_replace(substr(sl, 1, 40), '^-+|-+$', '', 'g')) > 0 THEN regexp_replace(substr(sl, 1, 40), '^-+|-+$', '', 'g') ELSE 'note' END AS slug,
  regexp_matches(text, '(?m)^\s*\|.*\|\s*\n\s*\|?\s*:?-{2,}') OR regexp_matches(text, '\$\$|\\begin\{(?:equation|align|gather|multline)\*?\}|\\(?:frac|sum|int|alpha|beta|gamma|nabla|partial)\b')
    OR regexp_matches(text, '(?m)^\s*(?:```|~~~)\s*(?:mermaid|plantuml|puml|dot|graphviz|math|latex|tex|katex)\b') OR regexp_matches(text, '!\[[^\]]*\]\(|!\[\[') AS rich FROM d""",
    "notes_filter_list": """
SELECT path, title, 'EN' AS branch FROM (SELECT DISTINCT source_path AS path, title FROM search_notes WHERE source_path IS NOT NULL)
WHERE starts_with(path, 'EN/') AND contains(lower(concat_ws(chr(10), path, title)), 'bex') ORDER BY string_split(path, '/') LIMIT 50""",
    "note_validation": r"""
WITH d AS (SELECT concat_ws('#', source_path, doc_id::VARCHAR) AS path, text, starts_with(text, '---' || chr(10)) AND strpos(text, chr(10) || '---' || chr(10)) > 0 AS closed, strpos(text, chr(10) || '---' || chr(10)) AS e
           FROM documents WHERE source_path LIKE '%.md'),
 f AS (SELECT *, CASE WHEN closed THEN substr(text, 5, greatest(0, e - 4)) ELSE '' END AS fm, CASE WHEN closed THEN substr(text, e + 5) ELSE text END AS body FROM d),
 g AS (SELECT *, coalesce(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')[2], '') AS second, CASE WHEN starts_with(path, 'UA/') THEN 'UA' WHEN starts_with(path, 'EN/') THEN 'EN' ELSE 'root' END AS br, starts_with(text, '---' || chr(10)) AS opened FROM f)
SELECT path, unnest(list_filter([CASE WHEN NOT opened THEN 'missing_frontmatter' END, CASE WHEN opened AND NOT regexp_matches(fm, '(?m)^cssclasses\s*:') THEN 'missing_frontmatter_cssclasses' END,
  CASE WHEN opened AND NOT regexp_matches(fm, '(?m)^tags\s*:') THEN 'missing_frontmatter_tags' END, CASE WHEN NOT regexp_matches(body, '(?m)^#\s+\S') THEN 'missing_title' END,
  CASE WHEN br = 'EN' AND NOT contains(second, '[[Home') OR br = 'UA' AND NOT contains(second, '[[UA/Головна') OR br = 'root' AND NOT contains(second, '[[Home') AND NOT contains(second, '[[UA/Головна') THEN 'missing_breadcrumb' END,
  CASE WHEN br = 'EN' AND NOT contains(text, '🇺🇦 [[') OR br = 'UA' AND NOT contains(text, '🇬🇧 [[') THEN 'missing_counterpart_link' END], lambda x: x IS NOT NULL)) AS issue FROM g""",
    "url_candidates": r"""
WITH d AS (SELECT doc_id::VARCHAR AS n, doc_id % 4 AS f FROM documents),
 u AS (SELECT n, f, CASE f WHEN 0 THEN 'https://arxiv.org/abs/' || n || 'v2' WHEN 1 THEN 'https://doi.org/10.48550/arXiv.' || n WHEN 2 THEN 'https://example.org/paper_(' || n || ').pdf' ELSE 'https://openreview.net/forum?id=r' || n || '&x=1' END AS url FROM d)
SELECT url, CASE f WHEN 0 THEN url || ' ' || replace(url, '/abs/', '/pdf/') || '.pdf' WHEN 1 THEN 'https://arxiv.org/abs/' || n || ' https://arxiv.org/pdf/' || n || '.pdf ' || url
    WHEN 3 THEN replace(replace(url, 'forum', 'pdf'), '&x=1', '') || ' ' || url ELSE url END AS candidates, n AS notes,
  regexp_replace(regexp_replace(CASE WHEN f = 3 THEN 'forum' ELSE CASE WHEN position('.' IN regexp_extract(url, '([^/]*)$', 1)) > 0 THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') ELSE regexp_extract(url, '([^/]*)$', 1) END END, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') || '.pdf' AS file_name
FROM u""",
    "events_by_hour": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "event_sessions": """
WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""",
}
