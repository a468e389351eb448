"""Problem 3: scanned pages repaired into continuous paragraphs.

Method, all in SQL: running lines are found by masking digits in the outer lines of pages; a mask that returns on
pages of the same file is furniture, and so are lines within two edits of one, lines that only give a page number,
and lines whose mask, names masked too, is furniture in several other files. Words broken at line ends are joined
with the next line of body text, over page ends too, and keep their hyphen if the text has the compound more often
than the joined word. Misread characters are found by skeletons: glyphs that scanners confuse share a class, words
with the same classes form a group, and a rare word of a group gives way to a frequent one that the words beside
it support. Windows over lines and pages then reflow the body into paragraphs.

Sums over files go by page first, so that a file that holds a large part of all pages is not one task's work.

Defined results: null or empty texts have no lines; a page that is null takes its number from its label, else from
its forerunner by id; pages extracted again are each repaired, and paragraphs take each page's first extraction;
pages without source_path form no file: only page numbers are furniture there; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.session import cut, table

#: Glyphs that scanners confuse, each mapped to the representative of its class.
LATIN = {"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "9": "g", "@": "a", "f": "t", "c": "e", "6": "u", "8": "u", "b": "u", "h": "u"}
LATIN_PAIRS = (("rl", "n"), ("rn", "m"), ("ll", "u"), ("tl", "u"), ("el", "d"), ("vv", "w"))
CYRILLIC = {"a": "а", "@": "а", "e": "е", "c": "е", "с": "е", "i": "і", "!": "і", "1": "і", "0": "о", "o": "о", "3": "з", "6": "б", "m": "т", "p": "р", "x": "х", "y": "у", "ї": "і", "й": "и", "щ": "ш", "н": "п", "ц": "п", "л": "п", "k": "к"}
#: How a line that only gives a page number reads once its digits are masked.
PAGE_NUMBER = r"^(?:[\[(]? ?#+ ?[\])]?|[-–—] ?# ?[-–—]|(?:p|pp|page|s|seite|str|с|ст|стор|стр|сторінка)\.? ?#(?: ?(?:of|/|von|de|z|з|із) ?#)?|# ?/ ?#|[ivxlc]{1,7})$"
HYPHEN = "-‐‑¬­"
LETTER = r"[\p{L}\p{N}@!$|'’ʼ]"


def digits_masked(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#"), r"\s+", " ")


def names_masked(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(line), r"\d+", "#"), r"\p{Lu}[\p{L}']+", "N"), r"\s+", " ")


def skeleton(word: Column) -> Column:
    """The classes of a lower-case word's glyphs; those of Cyrillic script if any of its letters is."""
    latin = F.translate(word, "".join(LATIN), "".join(LATIN.values()))
    for pair, one in LATIN_PAIRS:
        latin = F.regexp_replace(latin, pair, one)
    cyrillic = F.translate(word, "".join(CYRILLIC), "".join(CYRILLIC.values()))
    return F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def odd(word: Column) -> Column:
    """Whether a word mixes scripts or has a digit or sign between its letters: surely misread."""
    return word.rlike(r"\p{L}[\p{N}@!$|]|[\p{N}@!$|]\p{L}") | (word.rlike(r"\p{IsCyrillic}") & word.rlike("[a-z]"))


def lines_of(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Non-blank lines: page_id, file, page_no, line_no, top and bottom (places from either end of the page), opens
    (a paragraph: after a blank line or indented), line."""
    order = Window.partitionBy("source_path").orderBy("page_id")
    known = F.coalesce(F.col("page"), F.expr("try_cast(page_label AS int)"))
    numbers = pages.select("page_id", "source_path", known.alias("known")).withColumn("page_no", F.coalesce("known", F.last("known", ignorenulls=True).over(order) + 1, F.lit(1)))
    numbers = numbers.filter("source_path IS NOT NULL").select("page_id", F.col("page_no").cast("int"))
    kept = F.filter(
        F.transform(F.split(text_col, "\n"), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))),
        lambda x: x["line"].rlike(r"\S"),
    )
    rows = pages.filter(F.length(text_col) > 0).select("page_id", F.col("source_path").alias("file"), kept.alias("kept"))
    # the neighbours' numbers go into the array, as lines that carried the array would square a long page
    cells = F.expr("transform(kept, (x, i) -> struct(int(i) AS top, size(kept) - 1 - int(i) AS bottom, x.line_no AS line_no, x.line AS line, CASE WHEN i > 0 THEN kept[i - 1].line_no END AS before))")
    rows = rows.select("page_id", "file", F.explode(cells).alias("x")).select("page_id", "file", "x.top", "x.bottom", "x.line_no", F.regexp_replace("x.line", "[\r ]", " ").alias("line"), "x.before")
    opens = F.col("line").rlike(r"^(?:\t| {2,})\S") | (F.coalesce("before", F.col("line_no") - 1) < F.col("line_no") - 1)
    return rows.withColumn("opens", opens).drop("before").join(numbers, "page_id", "left").fillna(1, ["page_no"])


def furniture(lines: DataFrame, outer: int = 2, share: float = 0.2, least_files: int = 3) -> DataFrame:
    """Running headers and footers and page numbers: page_id, line_no. Only the `outer` first and last lines of a page
    are looked at; a mask must return on `share` of a file's pages (and two at least), or in `least_files` files."""
    edge = lines.filter((F.col("top") < outer) | (F.col("bottom") < outer)).select("page_id", "file", "page_no", "line_no", "line", digits_masked(F.col("line")).alias("mask"), names_masked(F.col("line")).alias("names"), F.when(F.col("bottom") < outer, "bottom").otherwise("top").alias("side"))
    edge = cut(edge)
    number = F.col("mask").rlike(PAGE_NUMBER)
    headings = lines.filter(F.col("line").rlike(r"^\s*\d+(?:\.\d+)*\.?\s+\p{L}")).select(F.regexp_replace(digits_masked(F.col("line")), r"^#(?:\.#)*\.? ", "").alias("mask")).distinct()
    plausible = ~F.col("mask").rlike(r"^(?:# )+#$|^#(?:\.#)*\. |^[^\p{L}]*$") & ~F.trim("line").rlike(r"^\p{Ll}") & (F.length("mask") >= 4) & F.col("mask").contains(" ")
    worded = edge.filter(plausible & ~number & F.col("file").isNotNull()).join(headings, "mask", "left_anti")
    sizes = lines.groupBy("file").agg(F.count_distinct("page_no").alias("pages"))
    returning = worded.groupBy("file", "side", "mask").agg(F.count_distinct("page_no").alias("n")).join(sizes, "file").filter((F.col("n") >= 2) & (F.col("n") >= share * F.col("pages"))).select("file", "side", "mask")
    exact = worded.join(returning, ["file", "side", "mask"]).select("page_id", "line_no", "names", "file", "mask")
    # at most outer / share masks a side for each file
    near = worded.join(returning.withColumnRenamed("mask", "known"), ["file", "side"]).filter((F.abs(F.length("mask") - F.length("known")) <= 2) & F.levenshtein("mask", "known", 2).between(0, F.when(F.length("known") >= 10, 2).otherwise(1))).select("page_id", "line_no")
    common = exact.filter(F.col("names").contains(" ")).groupBy("names").agg(F.count_distinct("file").alias("n")).filter(F.col("n") >= least_files).select("names")
    elsewhere = worded.join(common, "names", "left_semi").select("page_id", "line_no")
    numbered = edge.filter(number).select("page_id", "line_no")
    close = edge.filter(~number & F.col("file").isNotNull() & (F.length("mask") <= 14)).join(edge.filter(number & F.col("file").isNotNull() & (F.length("mask") >= 3) & ~F.col("mask").rlike("^[ivxlc]+$")).groupBy("file", "side", F.col("mask").alias("known")).agg(F.count_distinct("page_no").alias("n")).join(sizes, "file").filter((F.col("n") >= 2) & (F.col("n") >= share * F.col("pages"))), ["file", "side"]).filter((F.levenshtein("mask", "known") <= 1) & ~F.col("mask").rlike(r"\p{L}{3,}\.?$|^# #") & F.col("mask").contains("#")).select("page_id", "line_no")
    return exact.select("page_id", "line_no").unionByName(near).unionByName(elsewhere).unionByName(numbered).unionByName(close).distinct()


def body_of(lines: DataFrame, running: DataFrame) -> DataFrame:
    """Body lines with `after`, the next line of body text, and `before`, the one before; over page ends, too."""
    body = lines.join(running.withColumn("running", F.lit(True)), ["page_id", "line_no"], "left").filter("running IS NULL").drop("running")
    inner = Window.partitionBy("page_id").orderBy("line_no")
    seen = body.withColumn("after", F.lead("line").over(inner)).withColumn("before", F.lag("line").over(inner))
    ends = body.filter("file IS NOT NULL").groupBy("file", "page_no", "page_id").agg(F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))
    one = ends.groupBy("file", "page_no").agg(F.min_by("first", "page_id").alias("first"), F.min_by("last", "page_id").alias("last"))
    places = Window.partitionBy("file").orderBy("page_no")
    beside = one.select("file", "page_no", F.lead("first").over(places).alias("next_first"), F.lag("last").over(places).alias("prior_last"))
    out = seen.join(ends.select("page_id", "file", "page_no").join(beside, ["file", "page_no"]).select("page_id", "next_first", "prior_last"), "page_id", "left")
    return out.withColumn("after", F.coalesce("after", "next_first")).withColumn("before", F.coalesce("before", "prior_last")).drop("next_first", "prior_last")


def _broken(line: Column, after: Column) -> Column:
    """Whether a line's last word goes on in the line after."""
    return F.coalesce(line.rlike(rf"\p{{L}}[{HYPHEN}]\s*$") & after.rlike(rf"^\s*(?:\p{{Ll}}|[0-9@!]\p{{Ll}})|^\s*\p{{Lu}}{{2}}") & ~after.rlike(rf"^\s*\p{{Lu}}{{2}}-\d"), F.lit(False))


def words_of(body: DataFrame) -> DataFrame:
    """The words of body lines in lower case, without punctuation around them: page_id, line_no, place, word, prior,
    next, and for a word broken at the line's end its `left` and `right` parts; then `word` is the two joined."""
    broken, goes_on = _broken(F.col("line"), F.col("after")), _broken(F.col("before"), F.col("line"))
    # possessive and anchored at a kept sign, so that a long run of signs inside a word is passed once
    bare = r"^[^\p{L}\p{N}@$|]++|(?<![^\p{L}\p{N}@$|])[^\p{L}\p{N}@$|]++$"
    parts = F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(F.lower(x), bare, ""))
    rows = body.select("page_id", "line_no", broken.alias("broken"), goes_on.alias("goes_on"), parts.alias("parts"), F.lower(F.regexp_extract("after", rf"^\s*({LETTER}+)", 1)).alias("right"), F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(F.trim("line"), r"\s+"), -1)), rf"[{HYPHEN}]$", ""), r"^[^\p{L}\p{N}@$|]+", "").alias("left"))
    cells = F.expr("""transform(parts, (x, i) -> struct(
        int(i) AS place,
        CASE WHEN broken AND i = size(parts) - 1 THEN concat(left, right) ELSE x END AS word,
        CASE WHEN i > 0 THEN parts[i - 1] END AS prior,
        CASE WHEN i < size(parts) - 1 THEN parts[i + 1] END AS next,
        broken AND i = size(parts) - 1 AS joined))""")
    out = rows.select("page_id", "line_no", "goes_on", "left", "right", F.explode(cells).alias("c")).filter(~(F.col("goes_on") & (F.col("c.place") == 0)) | F.col("c.joined"))
    shape = lambda c: F.regexp_replace(c, r"\d+", "#")
    return out.select("page_id", "line_no", "c.place", "c.word", shape(F.col("c.prior")).alias("prior"), shape(F.col("c.next")).alias("next"), F.when(F.col("c.joined"), F.col("left")).alias("left"), F.when(F.col("c.joined"), F.col("right")).alias("right")).filter(F.col("word").rlike(r"\p{L}"))


def corrections(words: DataFrame, ratio: float = 0.05, least: int = 3) -> DataFrame:
    """Words that may be misread: word, form (a more frequent word of the same skeleton), n_form. For words that are surely
    misread any form will do, others must be rare beside it."""
    counts = words.filter((F.length("word") >= 2) & ~F.col("word").rlike(r"^\p{L}{1,3}-?\d+$")).groupBy("word").agg(F.count("*").alias("n")).withColumn("skeleton", skeleton(F.col("word"))).withColumn("odd", odd(F.col("word")))
    clean = counts.filter(~F.col("odd"))
    forms = clean.select("skeleton", F.col("word").alias("form"), F.col("n").alias("n_form"))
    pairs = counts.join(forms, "skeleton").filter(F.col("word") != F.col("form"))
    return pairs.filter(F.col("odd") | ((F.col("n") <= ratio * F.col("n_form")) & (F.col("n_form") >= least)) | ((F.col("n") == 1) & (F.col("n_form") >= 4))).select("word", "odd", "form", "n_form")


def misread(words: DataFrame) -> DataFrame:
    """Words with a wrongly recognised character: page_id, line_no, place, form (the right word)."""
    fixes = corrections(words)
    suspects = words.join(fixes, "word").select("page_id", "line_no", "place", "word", "prior", "next", "odd", "form", "n_form")
    # pairs of neighbouring words are counted by a hash, in one pass; a collision could only lend a pair false support
    before = lambda word: F.when(F.col("prior").isNotNull(), F.xxhash64("prior", word))
    after = lambda word: F.when(F.col("next").isNotNull(), F.xxhash64(word, "next", F.lit(1)))
    pairs = words.select(F.explode(F.array(before("word"), after("word"))).alias("pair")).filter("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("n"))
    keyed = suspects.withColumn("before", before("form")).withColumn("after", after("form"))
    seen = keyed.join(pairs.select(F.col("pair").alias("before"), F.col("n").alias("n_before")), "before", "left").join(pairs.select(F.col("pair").alias("after"), F.col("n").alias("n_after")), "after", "left").fillna(0, ["n_before", "n_after"])
    support = F.greatest("n_before", "n_after")
    best = seen.filter(F.col("odd") | (support >= 2)).withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "line_no", "place").orderBy(F.desc(support), F.desc("n_form"), "form")))
    return best.filter(F.col("rank") == 1).select("page_id", "line_no", "place", "word", "form")


def repairs(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Body lines, furniture, and for words to repair: broken (page_id, line_no, place, whole) and misread ones."""
    lines = lines_of(pages)
    running = cut(furniture(lines))
    body = body_of(lines, running)
    words = cut(words_of(body))
    wrong = cut(misread(words))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    halves = words.filter("left IS NOT NULL").join(wrong.select("page_id", "line_no", "place", "form"), ["page_id", "line_no", "place"], "left")
    joined = halves.withColumn("whole", F.coalesce("form", "word")).withColumn("hyphened", F.concat("left", F.lit("-"), "right"))
    vote = joined.join(counts.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(counts.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened")), "hyphened", "left")
    broken = vote.select("page_id", "line_no", "place", F.when(F.coalesce("n_hyphened", F.lit(0)) > F.coalesce("n_whole", F.lit(0)), F.col("hyphened")).otherwise(F.col("whole")).alias("whole"))
    return body, running, broken, wrong


def faults(pages: DataFrame) -> DataFrame:
    """page_id, line_no, fault (furniture, hyphen, misread), word (the right or whole one)."""
    _, running, broken, wrong = repairs(pages)
    a = running.select("page_id", "line_no", F.lit("furniture").alias("fault"), F.lit("").alias("word"))
    b = broken.select("page_id", "line_no", F.lit("hyphen").alias("fault"), F.col("whole").alias("word"))
    c = wrong.select("page_id", "line_no", F.lit("misread").alias("fault"), F.col("form").alias("word"))
    return a.unionByName(b).unionByName(c).select("page_id", F.col("line_no").cast("int").alias("line_no"), "fault", "word").distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """The repaired text of each file: source_path, paragraph (from 1), first_page, text."""
    body, _, broken, wrong = repairs(pages)
    first = body.filter("file IS NOT NULL").groupBy("file", "page_no").agg(F.min("page_id").alias("page_id")).select("page_id")
    kept = body.filter("file IS NOT NULL").join(first, "page_id", "left_semi")
    heading = F.col("line").rlike(r"^\s*\d+(?:\.\d+)*\.?\s+\p{Lu}") & (F.length("line") < 60)
    starts = (F.col("opens") & (F.col("top") > 0)) | heading | F.coalesce(F.col("before").rlike(r"^\s*\d+(?:\.\d+)*\.?\s+\p{Lu}") & (F.length("before") < 60), F.lit(False))
    marked = kept.withColumn("starts", F.when(starts | F.col("before").isNull(), 1).otherwise(0))
    per_page = marked.groupBy("file", "page_no").agg(F.sum("starts").alias("n"))
    earlier = per_page.select("file", "page_no", (F.sum("n").over(Window.partitionBy("file").orderBy("page_no")) - F.col("n")).alias("earlier"))
    here = marked.withColumn("here", F.sum("starts").over(Window.partitionBy("file", "page_no").orderBy("line_no")))
    numbered = here.join(earlier, ["file", "page_no"]).withColumn("paragraph", (F.col("here") + F.col("earlier")).cast("int"))
    goes_on = _broken(F.col("before"), F.col("line"))
    tokens = numbered.select("page_id", "file", "paragraph", "page_no", "line_no", goes_on.alias("goes_on"), F.posexplode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("place", "token"))
    fixes = wrong.select("page_id", "line_no", "place", F.col("word").alias("from"), F.col("form").alias("to")).join(broken, ["page_id", "line_no", "place"], "full")
    fixed = tokens.filter(~(F.col("goes_on") & (F.col("place") == 0))).join(fixes, ["page_id", "line_no", "place"], "left")
    bare = r"[^\p{L}\p{N}@$|]+$"
    lead = F.regexp_extract("token", r"^[^\p{L}\p{N}@$|]*", 0)
    tail = F.when(F.col("whole").isNull(), F.regexp_extract("token", bare, 0)).otherwise("")
    word = F.coalesce("whole", "to")
    cased = F.when(F.regexp_replace("token", r"^[^\p{L}]+", "").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.expr("substring(coalesce(whole, `to`), 2)"))).otherwise(word)
    text = F.when(word.isNotNull(), F.concat(lead, cased, tail)).otherwise(F.col("token"))
    listed = fixed.groupBy("file", "paragraph").agg(F.min("page_no").alias("first_page"), F.array_sort(F.collect_list(F.struct("page_no", "line_no", "place", text.alias("t")))).alias("w"))
    return listed.select(F.col("file").alias("source_path"), "paragraph", "first_page", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return faults(table(spark, base, "indexing_pages"))


def p3_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    return paragraphs(table(spark, base, "indexing_pages"))


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs}
