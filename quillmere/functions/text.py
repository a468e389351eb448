"""Column expressions over text: normalising, snippets, ids, markdown and page structure, links, routing.

All are built-in expressions that stay inside generated code; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
#: What a scanned page's or note's sections are called when they list references.
REFERENCE_TITLES = ("references", "bibliography", "works cited", "literature cited")
#: Languages of fenced blocks that hold a diagram or a formula.
DIAGRAM_FENCES = ("mermaid", "plantuml", "puml", "dot", "graphviz")
FORMULA_FENCES = ("math", "latex", "tex", "katex")
#: Words that ask for a relation.
RELATION_WORDS = r"(?i)\b(?:related|relationship|connect(?:ed|ion)?|path|depends?|compare|versus|vs|shared|common|bridge|difference between)\b|\bbetween\b.+\band\b|\bhow .* relate"
#: What reads like an exact term or a path.
EXACT_FORMS = r"""\[\[[^\]]+\]\]|\b[^\s/]+\.(?:md|pdf)\b|(?:^|[\s(])(?:UA|EN)/\S+|"[^"]+"|'[^']+'|`[^`]+`"""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """White space before line ends goes with them (blank lines too), runs of blanks become one, ends are stripped."""
    c = F.regexp_replace(c, "\0", " ")
    c = F.regexp_replace(c, rf"{SPACE}+\n", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(c)


def snippet(c: Column, n: int) -> Column:
    """At most n characters on one line, the cut marked by three dots."""
    flat = strip(F.regexp_replace(c, rf"{SPACE}+", " "))
    return F.when(F.length(flat) > n, F.concat(F.regexp_replace(F.substring(flat, 1, n - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(flat)


def chunk_id(path: Column, page: Column, index: Column, text: Column) -> Column:
    """A chunk's identity: the SHA-1 of where it stands and what it says."""
    return F.sha1(F.concat_ws(":", path, page.cast("string"), index.cast("string"), text))


def slug(c: Column, fallback: str, n: int = 40) -> Column:
    s = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n), "^-+|-+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(fallback))


def branch(path: Column) -> Column:
    return F.when(path.startswith("UA/"), "UA").when(path.startswith("EN/"), "EN").otherwise("root")


def without_frontmatter(c: Column) -> Column:
    end = F.instr(c, "\n---\n")
    return F.when(c.startswith("---\n") & (end > 0), F.substring(c, end + F.lit(5), F.length(c))).otherwise(c)


def frontmatter(c: Column) -> Column:
    end = F.instr(c, "\n---\n")
    return F.when(c.startswith("---\n") & (end > 0), F.substring(c, F.lit(5), F.greatest(F.lit(0), end - F.lit(4)))).otherwise("")


def tags(c: Column) -> Column:
    """The sorted tags of an inline list in the front matter."""
    inside = F.regexp_extract(frontmatter(c), r"(?m)^tags:[ \t]*\[([^\]\n]*)\]", 1)
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.split(inside, ","), lambda t: F.regexp_replace(F.trim(t), "^[\"' ]+|[\"' ]+$", "")), lambda t: t != "")))


def links(c: Column) -> Column:
    """Targets of wiki-links outside fenced code, without anchor and alias, sorted."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"(?s)```.*?```", ""), F.lit(r"\[\[([^\]\[]+)\]\]"), 1)
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"[#|].*$", ""), r"\\", "/"))), lambda t: t != "")))


def dois(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(10\.\d{4,9}/[^\s\"<>\]]+)"), 1)
    return F.sort_array(F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[).,;]+$", ""))))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def numeric_id(path: Column) -> Column:
    """The number a note's file name begins with, or an empty string."""
    return F.regexp_extract(file_name(path), r"^(\d+(?:\.\d+)*)\.", 1)


def domain(path: Column) -> Column:
    return F.split(numeric_id(path), r"\.")[0]


def title_aliases(title: Column) -> Column:
    """A title and its parts around dashes and colons, without leading number, of three characters or more, sorted."""
    bare = F.trim(F.regexp_replace(title, r"^\d+(?:\.\d+)*\.?\s*", ""))
    parts = F.transform(F.split(bare, r"\s*—\s*| - |:"), lambda p: F.trim(p))
    return F.sort_array(F.array_distinct(F.filter(F.concat(F.array(bare), parts), lambda p: F.length(p) >= 3)))


def graph_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_.-]+"), 0), lambda t: F.length(t) >= 2)


def memory_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{3,}"), 0))


def words(c: Column) -> Column:
    """The terms of the full-text index."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def urls(c: Column) -> Column:
    """Web addresses in order of appearance, without trailing punctuation and unbalanced closing brackets."""
    found = F.regexp_extract_all(c, F.lit(r"""(https?://[^\s<>\]"']+)"""), 1)
    bare = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    number = lambda u, x: F.length(u) - F.length(F.replace(u, F.lit(x), F.lit("")))
    extra = lambda u: F.greatest(F.lit(0), F.least(F.length(F.regexp_extract(u, r"(\)*)$", 1)), number(u, ")") - number(u, "(")))
    return F.array_distinct(F.transform(bare, lambda u: F.substring(u, F.lit(1), F.length(u) - extra(u))))


def pdf_candidates(url: Column) -> Column:
    """Addresses where the PDF behind an address may lie, best first; the address itself last."""
    arxiv = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?arxiv\.org/abs/([^?#]+)", 1)
    doi = F.regexp_extract(url, r"(?i)^https?://(?:dx\.)?doi\.org/+10\.48550/arxiv\.([^?#]+)", 1)
    forum = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?openreview\.net/forum\?(?:[^#]*&)?id=([^&#]+)", 1)
    paper = F.when(arxiv != "", arxiv).when(doi != "", doi)
    abstract, pdf = F.concat(F.lit("https://arxiv.org/abs/"), paper), F.concat(F.lit("https://arxiv.org/pdf/"), paper, F.lit(".pdf"))
    review = F.when(forum != "", F.concat(F.lit("https://openreview.net/pdf?id="), forum))
    return F.array_distinct(F.array_compact(F.array(abstract, pdf, review, url)))


def is_pdf_response(content_type: Column, disposition: Column, url: Column) -> Column:
    kind = F.trim(F.regexp_replace(F.lower(F.coalesce(content_type, F.lit(""))), ";.*$", ""))
    path = F.regexp_replace(F.lower(url), "[?#].*$", "")
    return kind.isin("application/pdf", "application/x-pdf") | F.contains(F.lower(F.coalesce(disposition, F.lit(""))), F.lit(".pdf")) | path.endswith(".pdf")


def pdf_file_name(disposition: Column, url: Column, source: Column | None = None) -> Column:
    """A safe file name: that of the response's header, else the last part of the final address or of the first one."""
    header = F.coalesce(disposition, F.lit(""))
    encoded = F.regexp_extract(header, r"(?i)filename\*=UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1)
    last = lambda u: F.regexp_extract(F.regexp_replace(F.regexp_replace(u, r"^[a-zA-Z]+://[^/?#]*", ""), "[?#].*$", ""), r"([^/]*)/*$", 1)
    named = F.try_url_decode(F.when(encoded != "", encoded).otherwise(plain))
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in (named, last(url), *([last(source)] if source is not None else []))], F.lit("download"))
    stem = F.regexp_replace(F.regexp_extract(raw, r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.substring(F.when(safe != "", safe).otherwise("download"), 1, 160), F.lit(".pdf"))


def explicit_level(line: Column) -> Column:
    """The level of a page's line that says it is a heading: by signs, by a number, or by the name of a section."""
    hashes = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\s+\S", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    named = F.lower(line).isin(*REFERENCE_TITLES, "abstract")
    return F.when(hashes > 0, hashes).when((number != "") & (F.length(line) <= 120), dots + 1).when(named, 1)


def heading_level(line: Column) -> Column:
    """The level of a page's line that is a heading: one that says so, or one that looks like it (level 1); else null."""
    return F.coalesce(explicit_level(line), F.when(looks_like_heading(line), 1))


def heading_title(line: Column) -> Column:
    """A heading's words, without signs and number."""
    bare = F.regexp_replace(line, r"^#{1,6}\s+", "")
    number = F.when((bare == line) & (F.length(line) <= 120), F.regexp_replace(line, r"^\d+(?:\.\d+)*\s+(?=\S)", "")).otherwise(bare)
    return F.when(F.lower(number) == "abstract", "Abstract").otherwise(strip(number))


def looks_like_heading(line: Column) -> Column:
    """Up to 100 characters and 12 words, no end punctuation, and a third in capitals (four at least) or a capital at the
    head of each of the first five words."""
    parts = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    heads = F.forall(F.slice(parts, 1, 5), lambda w: w.rlike(r"^\p{Lu}"))
    return (F.length(line) <= 100) & ~line.rlike(r"[.!?;:]$") & F.size(parts).between(1, 12) & ((capitals >= F.greatest(F.lit(4), F.floor(F.length(line) / 3))) | heads)


def is_figure_caption(line: Column) -> Column:
    return line.rlike(r"(?i)^(?:figure|fig\.)\s*\d+[A-Za-z0-9.-]*[:.]?\s+")


def looks_like_formula(text: Column) -> Column:
    """Six characters or more, an operator among them, and more signs of any kind than letters, of which there are few."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    signs = F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", ""))
    return (F.length(text) >= 6) & text.rlike(r"[=+\-/^∇∂]") & (signs > letters) & (letters < F.greatest(F.lit(12), F.floor(F.length(text) / 3)))


#: Fixed value: one source of a citation by name and year.
CITED = r"[A-Z][A-Za-z'`-]+(?: et al\.)?,?\s+\d{4}[a-z]?"


def clean_block(text: Column) -> Column:
    """A block of page text: words broken at line ends joined at their hyphen, citations and double blanks dropped."""
    t = normalize(F.regexp_replace(text, "- ", "-"))
    t = F.regexp_replace(t, r"\[\d+(?:\s*,\s*\d+)*(?:\s*-\s*\d+)?\]", "")
    t = F.regexp_replace(t, rf"\({CITED}(?:;\s*{CITED})*\)", "")
    t = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    return F.when(looks_like_formula(t), "[FORMULA]").otherwise(F.regexp_replace(t, "^[ ,;]+|[ ,;]+$", ""))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)


def text_lines(text: Column) -> Column:
    """The normalised non-blank lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: normalize(x)), lambda x: x != "")


def first_title(lines: Column, file: Column) -> Column:
    """A paper's title: the first of its first eight lines of three words or more and at most 160 characters that does not
    say it is a heading, else the words of its file's name."""
    fits = F.filter(F.slice(lines, 1, 8), lambda x: explicit_level(x).isNull() & (F.length(x) <= 160) & (F.size(F.split(x, r"(?U)\s+")) >= 3))
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(file, F.lit("document")), r"\.[^.]*$", ""), "[_-]", " ")
    return F.coalesce(F.try_element_at(fits, F.lit(1)), normalize(stem))


def first_authors(lines: Column, title: Column) -> Column:
    """A paper's authors: of the three lines after its title, up to a heading, the first of at most 120 characters and 20 words
    that lists names and has no digit."""
    after = F.slice(lines, F.coalesce(F.array_position(lines, title), F.lit(0)).cast("int") + 1, 3)
    heads = F.transform(after, lambda x: explicit_level(x).isNotNull())
    until = F.array_position(heads, True).cast("int")
    open_ = F.when(until > 0, F.slice(after, 1, until - 1)).otherwise(after)
    names = F.filter(open_, lambda x: (F.contains(x, F.lit(",")) | F.contains(F.lower(x), F.lit(" and "))) & ~x.rlike(r"\d") & (F.length(x) <= 120) & (F.size(F.split(x, r"(?U)\s+")) <= 20))
    parts = F.split(F.try_element_at(names, F.lit(1)), ",| and ")
    return F.coalesce(F.filter(F.transform(parts, lambda p: normalize(p)), lambda p: p != ""), F.array().cast("array<string>"))


def route(query: Column) -> Column:
    """The mode that `auto` takes for a query: fts, hybrid-graph or hybrid."""
    q = F.trim(query)
    short = (F.size(F.split(q, r"\s+")) <= 3) & q.rlike(r"\b[A-Z0-9_-]{4,}\b")
    return F.when(q == "", "hybrid").when(q.rlike(EXACT_FORMS), "fts").when(q.rlike(RELATION_WORDS), "hybrid-graph").when(short, "fts").otherwise("hybrid")


def reply_score(reply: Column) -> Column:
    """The score in a model's reply: its first whole number, held between 0 and 100, as a share; 0 without one."""
    number = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(-?\d+)", 1)
    return F.when(number == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number.cast("double"))) / 100)


def needs_rich_parser(text: Column) -> Column:
    """Whether a note has tables, formulas, diagrams or images that a plain parser would lose."""
    table = text.rlike(r"(?m)^\s*\|.*\|\s*\n\s*\|?\s*:?-{2,}")
    formula = text.rlike(r"\$\$|\\begin\{(?:equation|align|gather|multline)\*?\}|\\(?:frac|sum|int|alpha|beta|gamma|nabla|partial)\b")
    fence = text.rlike(r"(?m)^\s*(?:```|~~~)\s*(?:" + "|".join((*DIAGRAM_FENCES, *FORMULA_FENCES)) + r")\b")
    return table | formula | fence | text.rlike(r"!\[[^\]]*\]\(|!\[\[")
