"""Problem 7: passages of held-out test items inside training documents.

Method: a broadcast hash set of the normalised word n-grams of the test items. Each worker slides a window over
the words of its documents, looks every n-gram up in the set, verifies the documents that hit, and reports which
item leaked into which document, how much of it, and where; documents can then be dropped or their spans cut out.

Normalising: entities resolved, footnote marks, soft hyphens and zero-width characters removed, words broken at
line ends joined, case, Latin accents and full-width forms folded; separators inside numbers are dropped, and all
that is no letter or digit parts words. An item's leading line does not count if it is an instruction: one that stands
before `shared_lines` or more different lines which are longer than it. Copies and items on one passage keep theirs.

Verifying: an item's words count as held where runs of three words match along one diagonal near n-gram hits;
up to two changed words between held ones are held too. A sentence of the item counts only if three quarters of
the held stretch and half of its own numbers, codes and rare words match, so that sentences of the same form with
other content don't. Every document that has one n-gram of an item is verified,
unless the item's runs of three words that stand anywhere in it can't suffice, sentence by sentence. A leak holds at least `least` of the item's words.

Equal items are looked for once and reported under each of their ids; n-grams that many items have keep all of them,
in lists that n-grams of one passage share.

Items are few beside documents; they are sent to the workers about `slice_items` or `slice_bytes` at a time, in a pass for each slice.

Defined results: null or empty texts hold nothing; texts of any length are scanned whole; repeated documents are
reported each, under their own ids; items with fewer than n words are matched by all of them; empty tables give
an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import MIX, mixed, sentences
from quillmere.session import table

DROP, MARK, DIGIT_GAP = 1, 2, 3
_FOOTNOTE = re.compile(r"\[\d{1,3}\]")
_BROKEN = re.compile(r"(?<=\w)[-‐‑¬­][ \t]*\r?\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
SCHEMA = "item_id bigint, doc_id bigint, held double, span_start int, span_end int"


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point of the basic plane: what it becomes (a folded letter or digit), or 0 (parts words),
    DROP (nothing), MARK (parts documents), DIGIT_GAP (nothing between digits, else parts words)."""
    out = np.zeros(0x10000, np.uint32)
    for code in range(1, 0x10000):
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Cf", "Me"):
            out[code] = DROP
            continue
        n = unicodedata.normalize("NFKC", c).lower()
        if code < 0x250 and (base := unicodedata.normalize("NFKD", n))[:1].isascii():
            n = base[:1] if base[:1].isalnum() else n
        if len(n) == 1 and n.isalnum() and ord(n) < 0x10000:
            out[code] = ord(n)
    for c in ".,   ":
        out[ord(c)] = DIGIT_GAP
    out[0] = MARK
    out[0x2BC] = 0
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, in order, and the number of the text it is in."""
    joined = "\0".join(texts) + "\0"
    if "&" in joined:
        joined = html.unescape(joined)
    joined = _BROKEN.sub("", _FOOTNOTE.sub("", joined))
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        joined = joined.replace(ligature, letters)
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = _classes()[np.where(a < 0x10000, a, 0x20)]
    a = a[a != DROP]
    gap = np.flatnonzero(a == DIGIT_GAP)
    inside = gap[(gap > 0) & (gap < len(a) - 1)]
    inside = inside[_digit(a[inside - 1]) & _digit(a[inside + 1])]
    keep = np.ones(len(a), bool)
    keep[inside] = False
    a = a[keep]
    letter = a > DIGIT_GAP
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    latest = np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(a)]])))
    value = np.where(letter, a.astype(np.uint64) * _powers()[(np.arange(len(a)) - latest) & 63], np.uint64(0))
    return mixed(np.add.reduceat(value, starts)), np.cumsum(a == MARK)[starts]


def _digit(a: np.ndarray) -> np.ndarray:
    return (a >= 48) & (a <= 57)


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * MIX + w[k : len(w) - n + 1 + k]
    return mixed(h)


class Items:
    """The test items as word hashes, and the set of their n-grams."""

    def __init__(self, rows: list[tuple[int, str | None]], shared: set[str], n: int = 6, most_items: int = 3):
        kept = [(i, _own_lines(t, shared)) for i, t in rows if i is not None and t]
        self.n, self.ids, self.words, self.sentence, self.rare = n, [], [], [], []
        known: dict[tuple[bytes, ...], int] = {}
        first: dict[bytes, int] = {}
        within: dict[int, set[int]] = defaultdict(set)
        for i, text in kept:
            parts = [words([s])[0] for s in sentences(text.replace("\n", " "))]
            parts = [p for p in parts if len(p)]
            if not parts:
                continue
            if (k := known.setdefault(tuple(p.tobytes() for p in parts), len(self.ids))) < len(self.ids):
                self.ids[k].append(i)
                continue
            self.ids.append([i])
            self.words.append(np.concatenate(parts))
            self.sentence.append(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            for p in parts:
                # a sentence that several items share counts as one item's
                at = first.setdefault(p.tobytes(), k)
                for x in p.tolist():
                    within[x].add(at)
        seen = {x: len(at) for x, at in within.items()}
        most_common = max(most_items, len(self.ids) // 100)
        self.rare = [np.array([seen[x] <= most_common for x in w.tolist()]) for w in self.words]
        pairs = [(h, k) for k, w in enumerate(self.words) for h in np.unique(grams(w, min(n, len(w)))).tolist()]
        owners: dict[int, list[int]] = defaultdict(list)
        for h, k in pairs:
            owners[h].append(k)
        lists: dict[tuple[int, ...], int] = {}
        self.unique = np.array(sorted(owners), np.uint64)
        self.list_of = np.array([lists.setdefault(tuple(owners[h]), len(lists)) for h in self.unique.tolist()], np.int64)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owners = np.array([k for x in lists for k in x], np.int64)
        # what bounds a leak, of all items one after another: runs of three words, sentences, rare words, words far from rare ones
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.run = flat([np.concatenate([grams(w, 3), np.zeros(min(2, len(w)), np.uint64)]) for w in self.words], np.uint64)
        self.part = flat([(s != np.roll(s, 1)) | (np.arange(len(s)) == 0) for s in self.sentence], bool)
        self.is_rare = flat(self.rare, bool)
        self.free = flat([_far(r, s) for r, s in zip(self.rare, self.sentence, strict=True)], bool)
        self.grams = [{k: grams(w, k) for k in {min(n, len(w)), min(3, len(w))}} for w in self.words]
        self.lengths = sorted({min(n, len(w)) for w in self.words})
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.unique & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `h` that are in the set, and for each the place of its hash among the unique ones."""
        at = np.flatnonzero(self.bloom[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        to = np.searchsorted(self.unique, h[at])
        ok = (to < len(self.unique)) & (self.unique[np.minimum(to, len(self.unique) - 1)] == h[at])
        return at[ok], to[ok]


def _own_lines(text: str, shared: set[str]) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    return "\n".join(lines[1:] if len(lines) > 1 and _plain(lines[0]) in shared else lines)


def _plain(line: str) -> str:
    return " ".join(line.split()).lower()


class Runs:
    """The n-grams of a text's words in order of their hashes, and their places."""

    def __init__(self, w: np.ndarray, n: int):
        h = grams(w, n)
        self.place = np.argsort(h, kind="stable")
        self.hash = h[self.place]

    def matches(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in h, place here) of equal n-grams."""
        low = np.searchsorted(self.hash, h)
        there = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == h) if len(self.hash) else np.zeros(0, np.int64)
        low = low[there]
        many = np.searchsorted(self.hash, h[there], "right") - low
        if (many == 1).all():
            return there, self.place[low]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(there, many), self.place[np.repeat(low, many) + nth]


def held(own: dict[int, np.ndarray], sentence: np.ndarray, rare: np.ndarray, runs: dict[int, Runs], n: int, least: float = 0.0, dense: float = 0.75) -> tuple[float, int, int]:
    """The share of an item's words that a document holds, and the first and last of the document's words that hold them.
    `own` and `runs`: the item's and the document's n-grams, by n. Shares below `least` may come out as none."""
    size = len(sentence)
    n = min(n, size)
    short = min(3, n)
    i, j = runs[n].matches(own[n])
    if not len(i):
        return 0.0, 0, 0
    diagonals = np.unique(j - i)
    cuts = np.flatnonzero(np.diff(diagonals) > 4)
    low, high = np.append(diagonals[:1], diagonals[cuts + 1]) - 4, np.append(diagonals[cuts], diagonals[-1:]) + 4
    i, j = runs[short].matches(own[short])
    order = np.argsort(j - i, kind="stable")
    first, last = np.searchsorted((j - i)[order], low, "left"), np.searchsorted((j - i)[order], high, "right")
    best = (0.0, 0, 0)
    # so few runs can't cover enough, even with a gap after each
    for cluster in np.flatnonzero((short + 2) * (last - first) - 2 >= least * size).tolist():
        near = np.sort(order[first[cluster] : last[cluster]])
        covered, to = np.zeros(size, bool), np.full(size, -1)
        for k in range(short):
            covered[i[near] + k] = True
            to[i[near] + k] = j[near] + k
        at = np.flatnonzero(covered)
        matched = covered.copy()
        gap = np.diff(at)
        for k in np.flatnonzero((gap > 1) & (gap <= 3) & (np.abs(np.diff(to[at]) - gap) <= 2)).tolist():
            covered[at[k] : at[k + 1]] = True
        if covered.mean() <= best[0] or covered.mean() < least:
            continue
        for s in np.unique(sentence[at]):
            here = np.flatnonzero((sentence == s) & covered)
            span = np.arange(here[0], here[-1] + 1)
            wide = np.arange(max(0, here[0] - 2), min(size, here[-1] + 3))
            marks = wide[rare[wide] & (sentence[wide] == s)]
            if matched[span].mean() < dense or len(marks) and matched[marks].mean() < 0.5:
                covered[here] = False
        where = to[covered & (to >= 0)]
        if len(where) and covered.mean() > best[0]:
            best = (float(covered.mean()), int(where.min()), int(where.max()))
    return best


def _far(rare: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The words that have no rare word of their sentence within two words."""
    near = rare.copy()
    for k in (1, 2):
        same = sentence[k:] == sentence[:-k]
        near[k:] |= rare[:-k] & same
        near[:-k] |= rare[k:] & same
    return ~near


def possible(items: Items, w: np.ndarray, owner: np.ndarray, pairs: np.ndarray, least: float, most: int = 2_000_000) -> np.ndarray:
    """Which of the pairs (document, item) may be leaks. `held` counts words that runs of three cover, and gaps of up to two
    between such; in sentences of which no rare word is covered only those far from rare words. No leak is lost: here runs
    count wherever they stand in the document, and runs that only look alike by their hash count, too."""
    bits = np.uint64((1 << 24) - 1)
    key = lambda runs, docs: ((runs + docs.astype(np.uint64) * MIX) * MIX >> np.uint64(40)) & bits
    table = np.zeros(1 << 24, bool)
    runs = grams(w, 3)
    table[key(runs, owner[: len(runs)]).astype(np.int64)] = True
    out = np.ones(len(pairs), bool)
    sizes = items.size[pairs[:, 1]]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(pairs):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        n, own = sizes[begin:end], pairs[begin:end]
        first = np.cumsum(n) - n
        at = np.repeat(items.start[own[:, 1]] - first, n) + np.arange(n.sum())
        left = np.repeat(first + n, n) - np.arange(len(at))
        hit = table[key(items.run[at], np.repeat(own[:, 0], n)).astype(np.int64)] & (left >= 3)
        covered = hit.copy()
        for k in (1, 2):
            covered[k:] |= hit[:-k]
        filled = covered.copy()
        filled[1:-1] |= covered[:-2] & covered[2:]
        filled[1:-2] |= covered[:-3] & covered[3:]
        filled[2:-1] |= covered[:-3] & covered[3:]
        sentence = np.cumsum(items.part[at]) - 1
        touched = np.bincount(sentence, covered & items.is_rare[at])[sentence] > 0
        counted = np.add.reduceat((filled & (touched | items.free[at])).astype(np.int64), first)
        out[begin:end] = (counted >= least * n - 1e-9) | (n < 3)
        begin = end
    return out


def scan(items: Items, ids: list[int], texts: list[str], least: float, spans: bool = True) -> list[tuple]:
    """The leaks in a batch of documents; without `spans` where they stand is left open (null)."""
    out: list[tuple] = []
    w, owner = words(texts)
    if not len(w) or not len(items.ids):
        return out
    seen = []
    for n in items.lengths:
        h = grams(w, n)
        at, to = items.hits(h)
        ok = owner[at] == owner[at + n - 1]
        at, to = at[ok], to[ok]
        seen.append(np.stack([owner[at], items.list_of[to], to], 1))
    found = np.unique(np.concatenate(seen), axis=0)
    if not len(found):
        return out
    # documents with n-grams of lists of owners, then of owners
    of = np.unique(found[:, :2], axis=0)
    reps = items.sizes[of[:, 1]]
    nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    each = np.stack([np.repeat(of[:, 0], reps), items.owners[np.repeat(items.first[of[:, 1]], reps) + nth]], 1)
    pairs = np.unique(each, axis=0)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    last, runs = -1, {}
    for d, k in pairs[possible(items, w, owner, pairs, least)].tolist():
        if d != last:
            last, runs = d, {}
        own = items.grams[k]
        for x in own.keys() - runs.keys():
            runs[x] = Runs(w[begin[d] : begin[d + 1]], x)
        share, a, b = held(own, items.sentence[k], items.rare[k], runs, items.n, least)
        if share >= least:
            start, end = _span(texts[d], w[begin[d] : begin[d + 1]][a : b + 1]) if spans else (None, None)
            out += [(i, ids[d], share, start, end) for i in items.ids[k]]
    return out


def _span(text: str, stretch: np.ndarray) -> tuple[int, int]:
    """Where a stretch of words stands in the text as it is: from the first to the last place where three of
    its words stand in a row (entities, footnotes and broken words may shift the ends by a word or two)."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    hashes, owner = words([text[a:b] for a, b in places])
    raw = np.zeros(len(places), np.uint64)
    raw[owner[::-1]] = hashes[::-1]
    n = min(3, len(stretch))
    i, j = Runs(raw, n).matches(grams(stretch, n))
    if not len(i):
        return 0, len(text)
    # the shift (or those up to 12 from it) that most have
    named, count = np.unique(j - i, return_counts=True)
    sums = np.concatenate([[0], np.cumsum(count)])
    most = (sums[np.searchsorted(named, named + 12, "right")] - sums[np.searchsorted(named, named - 12)]).argmax()
    j = j[np.abs(j - i - named[most]) <= 12]
    return places[int(j.min())][0], places[min(len(places) - 1, int(j.max()) + 2)][1]


def instructions(items: DataFrame, item_text: str, shared_lines: int) -> set[str]:
    """Leading lines that `shared_lines` or more different and longer lines follow, as `_plain` writes them. A passage is
    none: copies have one line after it, and questions on it are shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [[_plain(x) for x in t.split("\n") if x.strip()][:2] for t in batch["t"]]
            yield pd.DataFrame([x for x in texts if len(x) == 2 and x[0].count(" ") < x[1].count(" ")], columns=["x", "y"])

    heads = items.select(F.col(item_text).cast("string").alias("t")).filter(F.length("t") > 0).mapInPandas(run, "x string, y string")
    return {r.x for r in heads.groupBy("x").agg(F.count_distinct("y").alias("n")).filter(F.col("n") >= shared_lines).select("x").collect()}


def leaks(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", least: float = 1 / 3, n: int = 6, shared_lines: int = 3, slice_items: int = 50_000, slice_bytes: int = 32 << 20, spans: bool = True) -> DataFrame:
    """The test items found in documents: item_id, doc_id, held (share of the item's words), span_start, span_end (null without `spans`)."""
    shared = instructions(items, item_text, shared_lines)
    pool = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter(F.length("t") > 0)
    size = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size.n // slice_items), -(-size.b // slice_bytes))
    read = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).cast("string").alias("t")).filter(F.length("t") > 0)
    out = None
    for k in range(passes):
        part = pool if passes == 1 else pool.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        known = docs.sparkSession.sparkContext.broadcast(Items([(r.i, r.t) for r in part.collect()], shared, n))

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    piece = batch.iloc[at : at + 1000]
                    yield pd.DataFrame(scan(known.value, piece["d"].tolist(), piece["t"].tolist(), least, spans), columns=["item_id", "doc_id", "held", "span_start", "span_end"]).astype({"span_start": "Int32", "span_end": "Int32"})

        found = read.mapInPandas(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no test item was found."""
    return docs.join(found.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks(table(spark, base, "eval_items"), table(spark, base, "documents"), spans=False).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, base: str) -> DataFrame:
    return leaks(table(spark, base, "eval_items"), table(spark, base, "documents")).withColumn("held", F.round("held", 6))


def p7_clean_documents(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    return without_leaks(docs, leaks(table(spark, base, "eval_items"), docs, spans=False)).select("doc_id", F.length("text").alias("n_chars"))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_clean_documents": p7_clean_documents}
