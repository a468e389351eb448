"""Problem 5: pairs of sentences of mirrored notes that translate one another.

Method: cross-lingual term vectors from a singular value decomposition of paired documents' terms. The paired
documents are sentences of mirrored notes that share marks (codes, numbers or names) which are unique on either side;
the association of their terms, decomposed, gives both languages' terms vectors in one space. A sentence's vector is
the weighted sum of its terms'. Within a pair of mirrored notes windows of one and of two neighbouring sentences are
scored against each other by the cosine of their vectors, which pairs need at least `least_cosine` of. Marks that both
have add a share, so that sentences of the same words about other things part: names compare by their consonants, so
that transliterated ones meet. A score counts against its margin, the mean of the best scores of either side. Mutual
neighbours pair up wherever they stand; a sentence that another side's merged sentence covers in part pairs with it, too.

Notes are mirrored if their file names begin with the same number. The side of a row is the script of its text, as
rows may lie in the other branch's folder. A row without path takes that of the rows with its title and time of change.

A note of up to `block_rows` sentences is parsed, packed into one row and matched there: its texts are shuffled once.
Larger notes are parsed sentence by sentence and compared in blocks, and their best candidates are put together afterwards;
so no task holds a note of any size whole. Blocks are stretches of neighbouring sentences with one more at either end,
so that each window stands whole in a block. Either way gives the same pairs. Equal sentences of a side of a note are compared
once. The decomposition is fitted on all mirrored notes and all terms that their paired sentences have three times or more.

Defined results: null and empty texts and texts of one line have no sentences; rows without number, path or twin have
no pairs; repeated rows pair each; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.llm.common import FOLD, sentences
from quillmere.llm.splitting import numbered
from quillmere.session import cut, table

_CODE = re.compile(r"\b[A-Z]{2,3}-\d+\b")
_NUMBER = re.compile(r"\d[\d.,   ]*\d|\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_CYRILLIC, _LETTER = re.compile("[Ѐ-ӿ]"), re.compile(r"[^\W\d_]")
#: Cyrillic letters as Latin consonants (vowels and signs have none).
CONSONANTS = {"б": "b", "в": "v", "г": "", "ґ": "g", "д": "d", "ж": "z", "з": "z", "й": "", "к": "k", "л": "l", "м": "m", "н": "n", "п": "p", "р": "r", "с": "s", "т": "t", "ф": "f", "х": "", "ц": "k", "ч": "k", "ш": "s", "щ": "s"}
_LATIN = {"c": "k", "q": "k", "x": "ks", "w": "v", "h": "", "j": "", "y": "", **dict.fromkeys("aeiou", "")}


#: Scores: the least of a pair, the marks' part of it, and the cosine without which there is none.
LEAST, WEIGHT, LEAST_COSINE = 0.4, 0.4, 0.2


@lru_cache(1 << 16)
def consonants(name: str) -> str:
    """A name's consonants, the same for a Latin name and its transliteration."""
    low = re.sub(r"qu(?=[aeiouy])", "kv", name.lower().translate(FOLD))
    out = "".join(CONSONANTS.get(c, "") if "Ѐ" <= c <= "ӿ" else _LATIN.get(c, c) for c in low)
    return re.sub(r"(.)\1+", r"\1", out)


def is_cyrillic(text: str) -> bool:
    return 2 * len(_CYRILLIC.findall(text)) > len(_LETTER.findall(text))


def analysed(sentence: str, common: frozenset[str] = frozenset()) -> tuple[list[str], dict[str, float]]:
    """A sentence's terms and its marks with their weights."""
    marks: dict[str, float] = {}
    for m in _CODE.finditer(sentence):
        marks[m.group().lower()] = 3.0
    rest = _CODE.sub(" ", sentence)
    for m in _NUMBER.finditer(rest):
        digits = re.sub(r"\D", "", m.group())
        marks[digits] = 1.0 if len(digits) < 3 else 1.5
    terms = []
    cyrillic = is_cyrillic(sentence)
    shouted = rest.upper() == rest
    for k, m in enumerate(_WORD.finditer(rest)):
        w = m.group()
        low = w.lower().replace("’", "'").replace("ʼ", "'")
        latin = not "Ѐ" <= low[0] <= "ӿ"
        if len(low) >= 5 and low not in common and ((cyrillic and latin) or (w[0].isupper() and (k > 0 and not shouted or low not in common))):
            name = consonants(low)
            if len(name) >= 3:
                marks[f"@{name}"] = 2.0
        terms.append(low)
    return terms, marks


@lru_cache(1 << 16)
def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Space:
    """The vectors of both sides' terms, weighted; a term's number is its place in `names`, from 1."""

    def __init__(self, names: list[str], matrix: np.ndarray):
        self.names, self.matrix = names, matrix

    def vector(self, term: str) -> np.ndarray:
        return self.matrix[self.names.index(term) + 1]

    def embed(self, terms: list[Iterable[int]]) -> np.ndarray:
        """The vectors of some sentences' terms."""
        sizes = np.array([len(t) for t in terms])
        flat = np.array([x for t in terms for x in t], np.int64)
        out = np.zeros((len(terms), self.matrix.shape[1]), np.float32)
        np.add.at(out, np.repeat(np.arange(len(terms)), sizes), self.matrix[flat])
        return out


def _per_batch(count: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from count(batch)

    return run


def _small_words(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Words behind the first of a sentence: w, in how many sentences small (n) and in how many with a capital (big)."""
    small, big = Counter(), Counter()
    for text in batch["text"]:
        for s in sentences(text.partition("\n")[2]):
            words = _WORD.findall(s)[1:]
            small.update({w.lower() for w in words if w[0].islower()})
            if s.upper() != s:
                big.update({w.lower() for w in words if w[0].isupper()})
    yield pd.DataFrame([(w, small[w], big[w]) for w in small.keys() | big.keys()], columns=["w", "n", "big"])


def vocabulary(texts: DataFrame, least: int = 3, share: float = 0.2) -> list[str]:
    """The words that are terms and no names, sorted: written small in `least` sentences and in `share` of those they stand in.
    The number alone would do away with names as tables grow, since slips write any name small now and then."""
    counts = texts.mapInPandas(_per_batch(_small_words), "w string, n bigint, big bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("big").alias("big"))
    return sorted(r.w for r in counts.filter((F.col("n") >= least) & (F.col("n") >= share * (F.col("n") + F.col("big")))).select("w").collect())


def parsed(row: int, text: str, number: dict[str, int]) -> Iterator[tuple]:
    """A row's sentences: side, row, sent, h, terms' numbers, marks' hashes, marks' weights."""
    body = text.partition("\n")[2]
    side = int(is_cyrillic(body))
    for n, s in enumerate(sentences(body), 1):
        flat = " ".join(s.split())
        terms, marks = analysed(flat, number.keys())
        yield side, row, n, hashed(flat), [number[t] for t in terms if t in number], [hashed(m) for m in marks], list(marks.values())


def _together(batch: pd.DataFrame, width: int = 1 << 31, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """How often terms (numbers from 1) stand together in pairs of sentences; 0 stands for any."""
    held, size = [], 0

    def counted() -> pd.DataFrame:
        both, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"i": both // width, "j": both % width, "n": n})

    for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
        x, y = (np.append(0, np.unique(np.asarray(t, np.int64))) for t in (ta, tb))
        step = max(1, most // len(y))
        for at in range(0, len(x), step):
            held.append((x[at : at + step, None] * width + y).ravel())
            if (size := size + len(held[-1])) >= most:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


#: Marks of at least this weight are unlikely to meet by chance: codes, names and numbers of three digits.
ANCHOR = 1.5


def anchored(sides: tuple[list[tuple], list[tuple]], votes: int) -> list[tuple[list[int], list[int]]]:
    """The terms of the pairs of sentences (row, sent, h, terms, marks, weights) that share `votes` marks, each unique on either side."""
    unique: list[dict[int, int]] = []
    for side in sides:
        where: dict[int, set[int]] = defaultdict(set)
        for k, x in enumerate(side):
            for m, w in zip(x[4], x[5], strict=True):
                if w >= ANCHOR:
                    where[m].add(k)
        unique.append({m: min(at) for m, at in where.items() if len(at) == 1})
    shared = Counter((k, unique[1][m]) for m, k in unique[0].items() if m in unique[1])
    return [(sides[0][i][3], sides[1][j][3]) for (i, j), n in shared.items() if n >= votes]


def _pairs_of_large(rows: DataFrame, votes: int) -> DataFrame:
    """What `anchored` gives, of notes of any size: ta, tb."""
    marks = F.explode(F.arrays_zip("marks", "weights")).alias("m")
    unique = rows.select("key", "side", "h", marks).filter(F.col("m.weights") >= ANCHOR).groupBy("key", F.col("m.marks").alias("m"), "side").agg(F.min("h").alias("h"), F.max("h").alias("other")).filter("h = other")
    one, other = (unique.filter(F.col("side") == k).select("key", "m", F.col("h").alias(name)) for k, name in enumerate(("ha", "hb")))
    met = one.join(other, ["key", "m"]).groupBy("key", "ha", "hb").count().filter(F.col("count") >= votes)
    sided = [rows.filter(F.col("side") == k).groupBy("key", F.col("h").alias(h)).agg(F.first("terms").alias(t)) for k, (h, t) in enumerate((("ha", "ta"), ("hb", "tb")))]
    return met.join(sided[0], ["key", "ha"]).join(sided[1], ["key", "hb"]).select("ta", "tb")


def fit(packed: DataFrame, large: DataFrame | None, names: list[str], dim: int = 96, least: int = 3, votes: int = 2) -> Space:
    """Learn a space from all mirrored notes' sentences, of packed notes and of large ones. Counts of terms are taken on
    the workers, and only the matrix of terms, which grows with the vocabulary, comes to the driver."""

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [x for body in batch["body"] for x in anchored(pickle.loads(body)[0], votes)]
            yield from _together(pd.DataFrame(pairs, columns=["ta", "tb"]))

    counted = packed.select("body").mapInPandas(together, "i bigint, j bigint, n bigint")
    if large is not None:
        counted = counted.unionByName(_pairs_of_large(large, votes).mapInPandas(_per_batch(_together), "i bigint, j bigint, n bigint"))
    table = counted.groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas().sort_values(["i", "j"])
    i, j, n = (table[c].to_numpy(np.int64) for c in ("i", "j", "n"))
    return _decomposed(i, j, n, names, dim, least)


def _decomposed(i: np.ndarray, j: np.ndarray, n: np.ndarray, names: list[str], dim: int, least: int) -> Space:
    """The space of the counts n of terms i and j (numbers from 1) together; counts with 0 are the terms' own."""
    total = int(n[(i == 0) & (j == 0)].sum())
    own = [np.zeros(len(names) + 1, np.float32) for _ in (0, 1)]
    own[0][i[j == 0]], own[1][j[i == 0]] = n[j == 0], n[i == 0]
    own[0][0] = own[1][0] = 0
    terms = [np.flatnonzero(c >= least) for c in own]
    if not len(terms[0]) or not len(terms[1]):
        return Space(names, np.zeros((len(names) + 1, dim), np.float32))
    df = [c[t] for c, t in zip(own, terms, strict=True)]
    keep = (own[0][i] >= least) & (own[1][j] >= least)
    i, j, n = np.searchsorted(terms[0], i[keep]), np.searchsorted(terms[1], j[keep]), n[keep]
    value = np.log(n * total / (df[0][i].astype(np.float64) * df[1][j])).astype(np.float32)
    i, j, value = i[value > 0], j[value > 0], value[value > 0]
    shape = (len(terms[0]), len(terms[1]))
    order = np.lexsort((i, j))
    down = lambda q: _times(i, j, value, shape[0], q)
    up = lambda q: _times(j[order], i[order], value[order], shape[1], q)
    rank = min(dim, *shape)
    rng = np.random.default_rng(3)
    q = np.linalg.qr(down(rng.standard_normal((shape[1], min(rank + 16, *shape))).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(down(up(q)))[0]
    u, s, vt = np.linalg.svd(up(q).T, full_matrices=False)
    sides = ((q @ u)[:, :rank] * np.sqrt(s[:rank]), vt[:rank].T * np.sqrt(s[:rank]))
    matrix = np.zeros((len(names) + 1, dim), np.float32)
    for k, side in enumerate(sides):
        norm = np.maximum(np.linalg.norm(side, axis=1), 1e-6)
        matrix[terms[k], :rank] = side / norm[:, None] * np.log(1 + total / df[k])[:, None]
    return Space(names, matrix)


def _times(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_rows: int, q: np.ndarray, step: int = 50_000) -> np.ndarray:
    """A sparse matrix, its entries in order of rows, times a dense one."""
    out = np.zeros((n_rows, q.shape[1]), np.float32)
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[starts]] += np.add.reduceat(values[at : at + step, None] * q[cols[at : at + step]], starts)
    return out


class Side:
    """One side's sentences as arrays: vectors, and the weights of the marks that either side has."""

    def __init__(self, vectors: np.ndarray, marks: np.ndarray):
        self.vectors, self.marks = vectors, marks

    def merged(self, pairs: list[tuple[int, int]]) -> Side:
        i, j = np.array(pairs).T
        return Side(self.vectors[i] + self.vectors[j], np.maximum(self.marks[i], self.marks[j]))


def sides(space: Space, a: list[tuple], b: list[tuple]) -> tuple[Side, Side]:
    """Two sides' sentences (row, sent, h, terms, marks, weights) as arrays."""
    number: dict[int, int] = {}
    for x in (*a, *b):
        for m in x[4]:
            number.setdefault(m, len(number))
    out = []
    for side in (a, b):
        w = np.zeros((len(side), len(number)), np.float32)
        for i, x in enumerate(side):
            w[i, [number[m] for m in x[4]]] = x[5]
        out.append(Side(space.embed([x[3] for x in side]), w))
    return out[0], out[1]


def scores(a: Side, b: Side, weight: float, least_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of sentences of two sides: the score, the share of the lighter one's marks that both have, and the
    weight of the marks that both have. `weight` is the marks' part of a score; pairs below `least_cosine` have none."""
    unit = [x.vectors / np.maximum(np.linalg.norm(x.vectors, axis=1), 1e-6)[:, None] for x in (a, b)]
    cosine = unit[0] @ unit[1].T
    shared = np.sqrt(a.marks) @ np.sqrt(b.marks).T
    total = [x.marks.sum(1) for x in (a, b)]
    lighter, heavier = np.minimum.outer(total[0], total[1]), np.maximum.outer(total[0], total[1])
    inside, alike = shared / np.maximum(lighter, 1), shared / np.maximum(heavier, 1)
    bare = (lighter == 0) & (heavier < 2)
    mark = np.where(bare, cosine > 0.6, 0.5 * inside + 0.5 * alike)
    score = np.where(cosine >= least_cosine, (1 - weight) * cosine + weight * mark, 0)
    return score, np.where(bare, 1.0, inside), np.where(bare, np.where(cosine > 0.6, 2.0, 0.0), shared)


def candidates(space: Space, a: list[tuple], b: list[tuple], keep: int, weight: float, least_cosine: float) -> list[tuple]:
    """The best candidates of each sentence (row, sent, h, terms, marks, weights, core) of either side: ha, hb, score, inside,
    shared. Where a window of two neighbouring sentences fits better than either of them alone, the pair takes the window's
    score. Sentences that are not core only take part in windows. Ties go by h, not by place, so that blocks agree."""
    one, other = sides(space, a, b)
    s, inside, shared = scores(one, other, weight, least_cosine)
    best = s.copy()
    for rows, own, opposite, flip in ((a, one, other, False), (b, other, one, True)):
        if not (pairs := _following(rows)):
            continue
        m = scores(own.merged(pairs), opposite, weight, least_cosine)[0]
        single, view, ins, sh = (s.T, best.T, inside.T, shared.T) if flip else (s, best, inside, shared)
        i, j = np.array(pairs).T
        better = m > np.maximum(single[i], single[j]) + 0.02
        for x in (i, j):  # each of the two gains where it has a share in the window's fit
            np.maximum.at(view, x, np.where(better & (ins[x] >= 0.6) & (sh[x] >= 1), m, 0))
    ka, kb = (np.array(sorted((k for k, x in enumerate(rows) if x[6]), key=lambda k: rows[k][2]), np.int64) for rows in (a, b))
    best = np.round(best.astype(np.float64), 5)
    core = best[np.ix_(ka, kb)]
    top = [np.argsort(-core, axis=1, kind="stable")[:, :keep], np.argsort(-core, axis=0, kind="stable")[:keep].T]
    out = {(int(ka[i]), int(kb[j])) for i, js in enumerate(top[0]) for j in js} | {(int(ka[i]), int(kb[j])) for j, is_ in enumerate(top[1]) for i in is_}
    return [(a[i][2], b[j][2], float(best[i, j]), float(inside[i, j]), float(shared[i, j])) for i, j in sorted(out)]


def chosen(found: list[tuple], keep: int, least: float) -> list[tuple[int, int, float]]:
    """The candidates (ha, hb, score, inside, shared) of one note that pair up: ha, hb, score."""
    ranks: list[dict[tuple, int]] = []
    seconds: list[dict[int, float]] = []
    for side in (0, 1):
        by: dict[int, list[tuple]] = defaultdict(list)
        for x in found:
            by[x[side]].append(x)
        rank: dict[tuple, int] = {}
        second: dict[int, float] = {}
        for h, own in by.items():
            own.sort(key=lambda x: (-x[2], x[0], x[1]))
            rank |= {x[:2]: n for n, x in enumerate(own, 1)}
            rest = [x[2] for x in own[1:keep]]
            second[h] = sum(rest) / len(rest) if rest else 0.0
        ranks.append(rank)
        seconds.append(second)
    out = []
    for ha, hb, score, inside, shared in found:
        firsts = [r[ha, hb] == 1 for r in ranks]
        margin = score - (seconds[0][ha] + seconds[1][hb]) / 2
        mutual = all(firsts) and margin >= 0.05
        partly = any(firsts) and inside >= 0.6 and shared >= 1.5 and (margin >= 0.05 or inside >= 0.8)
        if score >= least and (mutual or partly):
            out.append((ha, hb, score))
    return out


def matched(space: Space, sides_: tuple[list[tuple], list[tuple]], places: tuple[dict, dict], keep: int, least: float, weight: float, least_cosine: float) -> Iterator[tuple]:
    """The pairs of a packed note: row_a, sent_a, row_b, sent_b, score."""
    a, b = ([(*x, True) for x in side] for side in sides_)
    for ha, hb, score in chosen(candidates(space, a, b, keep, weight, least_cosine), keep, least):
        for p in places[0][ha]:
            for q in places[1][hb]:
                yield (*min(p, q), *max(p, q), score)


def _following(rows: list[tuple]) -> list[tuple[int, int]]:
    place = {(x[0], x[1]): k for k, x in enumerate(rows)}
    return [(k, place[r, n + 1]) for (r, n), k in place.items() if (r, n + 1) in place]


def mirror_key(path: Column) -> Column:
    """The number with which a note's file name begins."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    found = F.regexp_extract(name, r"^\s*(\d+(?:\.\d+)+)\.", 1)
    return F.when(found == "", None).otherwise(found)


def keyed_rows(notes: DataFrame) -> DataFrame:
    """The rows of notes with a number: key, row, text, n (no fewer than its sentences)."""
    known = notes.select(F.col("note_row").alias("row"), "text", "title", "modified_at", mirror_key(F.col("source_path")).alias("own"))
    named = known.filter("own IS NOT NULL AND title IS NOT NULL AND modified_at IS NOT NULL").groupBy("title", "modified_at").agg(F.min("own").alias("by_title"), F.max("own").alias("other")).filter("by_title = other")
    lost = known.filter("own IS NULL AND title IS NOT NULL").join(named, ["title", "modified_at"]).select("row", "text", F.col("by_title").alias("key"))
    keyed = known.filter("own IS NOT NULL").select("row", "text", F.col("own").alias("key")).unionByName(lost).filter("text IS NOT NULL")
    return keyed.withColumn("n", F.regexp_count("text", F.lit(r"(?U)[.!?]\s")) + 1)


def align(notes: DataFrame, block_rows: int = 1500, least: float = LEAST, keep: int = 4, weight: float = WEIGHT, least_cosine: float = LEAST_COSINE, most_broadcast: int = 100_000) -> DataFrame:
    """Pairs of sentences that say the same: row_a, sent_a, row_b, sent_b (row_a < row_b), score."""
    sc = notes.sparkSession.sparkContext
    keyed = cut(keyed_rows(notes))
    names = vocabulary(keyed.select("text"))
    number = sc.broadcast({w: k for k, w in enumerate(names, 1)})
    sizes = keyed.groupBy("key").agg(F.sum("n").alias("n"))
    heavy = cut(sizes.filter(F.col("n") > block_rows).select("key"))
    many = heavy.count()
    sent = F.broadcast(heavy) if many <= most_broadcast else heavy

    def packed_note(rows: list[tuple[int, str]]) -> bytes | None:
        own: tuple[dict, dict] = ({}, {})
        places: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for row, text in rows:
            for side, r, n, h, *rest in parsed(row, text, number.value):
                own[side].setdefault(h, (r, n, h, *rest))
                places[side][h].append((r, n))
        return pickle.dumps(((list(own[0].values()), list(own[1].values())), places)) if own[0] and own[1] else None

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a note's rows follow one another
        last, held = None, []
        for batch in batches:
            out = []
            for key, row, text in batch.itertuples(index=False):
                if key != last and held:
                    out.append(packed_note(held))
                    held = []
                last = key
                held.append((row, text))
            yield pd.DataFrame({"body": [x for x in out if x]})
        yield pd.DataFrame({"body": [x for x in [packed_note(held)] if x]})

    light = keyed.join(sent, "key", "left_anti") if many else keyed
    packed = cut(light.select("key", "row", "text").repartition("key").sortWithinPartitions("key", "row").mapInPandas(pack, "body binary"))
    rows = cut(_large_rows(keyed.join(sent, "key", "left_semi"), number)) if many else None
    space = sc.broadcast(fit(packed, rows, names))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for body in batch["body"] for x in matched(space.value, *pickle.loads(body), keep, least, weight, least_cosine)]
            yield pd.DataFrame(out, columns=["row_a", "sent_a", "row_b", "sent_b", "score"])

    out = packed.mapInPandas(match, PAIRS)
    return out if rows is None else out.unionByName(_large_pairs(rows, space, block_rows, keep, least, weight, least_cosine))


PAIRS = "row_a bigint, sent_a int, row_b bigint, sent_b int, score double"


def _large_rows(keyed: DataFrame, number) -> DataFrame:
    """The parsed sentences of large notes: key, side, row, sent, h, terms, marks, weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, *x) for key, row, text in batch.itertuples(index=False) for x in parsed(row, text, number.value)]
            yield pd.DataFrame(out, columns=["key", "side", "row", "sent", "h", "terms", "marks", "weights"])

    return keyed.select("key", "row", "text").mapInPandas(run, "key string, side int, row bigint, sent int, h bigint, terms array<int>, marks array<bigint>, weights array<float>")


def _large_pairs(rows: DataFrame, space, block_rows: int, keep: int, least: float, weight: float, least_cosine: float) -> DataFrame:
    """The pairs of large notes, block by block."""
    # one copy of a sentence that a side of a note has several times, the earliest
    first = rows.groupBy("key", "side", "h").agg(F.min_by(F.struct("row", "sent", "terms", "marks", "weights"), F.struct("row", "sent")).alias("u")).select("key", "side", "h", "u.*")
    units = cut(numbered(first, ["key", "side"], ["row", "sent"], [F.floor(F.col("row") / 1000)], "at"))
    sized = units.groupBy("key").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("m0"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("m1")).filter("m0 IS NOT NULL AND m1 IS NOT NULL")
    parts_of = lambda c: (F.floor(F.col(c) / block_rows) + 1).cast("int")
    placed = units.join(sized.select("key", parts_of("m0").alias("parts0"), parts_of("m1").alias("parts1")), "key")
    block, parts = F.floor(F.col("at") / block_rows).cast("int"), F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1"))
    place = lambda x, core: F.struct(x.alias("own"), F.lit(core).alias("core"))
    before = F.when((F.col("at") % block_rows == 0) & (block > 0), place(block - 1, False))
    after = F.when((F.col("at") % block_rows == block_rows - 1) & (block + 1 < parts), place(block + 1, False))
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1)
    wide = placed.withColumn("in", F.explode(F.array_compact(F.array(place(block, True), before, after)))).withColumn("other", F.explode(others))
    own, other = F.col("in.own"), F.col("other")
    spread = wide.select("key", "side", "row", "sent", "h", "terms", "marks", "weights", F.col("in.core").alias("core"), F.when(F.col("side") == 0, own).otherwise(other).alias("part0"), F.when(F.col("side") == 0, other).otherwise(own).alias("part1"))
    columns = ["row", "sent", "h", "terms", "marks", "weights", "core"]

    def match(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (sorted(group.loc[group["side"] == side, columns].itertuples(index=False, name=None), key=lambda x: x[:2]) for side in (0, 1))
        found = candidates(space.value, a, b, keep, weight, least_cosine) if a and b else []
        return pd.DataFrame([(group["key"].iat[0], *x) for x in found], columns=["key", "ha", "hb", "score", "inside", "shared"])

    found = spread.groupBy("key", "part0", "part1").applyInPandas(match, "key string, ha bigint, hb bigint, score double, inside double, shared double")
    wa, wb = Window.partitionBy("key", "ha"), Window.partitionBy("key", "hb")
    top = lambda w: F.row_number().over(w.orderBy(F.desc("score"), "ha", "hb"))
    ranked = found.withColumn("ra", top(wa)).withColumn("rb", top(wb)).withColumn("second_a", F.avg(F.when(F.col("ra").between(2, keep), F.col("score"))).over(wa)).withColumn("second_b", F.avg(F.when(F.col("rb").between(2, keep), F.col("score"))).over(wb))
    margin = F.col("score") - (F.coalesce("second_a", F.lit(0.0)) + F.coalesce("second_b", F.lit(0.0))) / 2
    mutual = (F.col("ra") == 1) & (F.col("rb") == 1) & (F.col("score") >= least) & (margin >= 0.05)
    # one-sided: the rest of a merged sentence, or the merged sentence of a part
    partly = ((F.col("ra") == 1) | (F.col("rb") == 1)) & (F.col("score") >= least) & (F.col("inside") >= 0.6) & (F.col("shared") >= 1.5) & ((margin >= 0.05) | (F.col("inside") >= 0.8))
    paired = ranked.filter(mutual | partly).select("key", "ha", "hb", "score")
    a = rows.filter("side = 0").select("key", F.col("h").alias("ha"), F.col("row").alias("r0"), F.col("sent").alias("s0"))
    b = rows.filter("side = 1").select("key", F.col("h").alias("hb"), F.col("row").alias("r1"), F.col("sent").alias("s1"))
    both = paired.join(a, ["key", "ha"]).join(b, ["key", "hb"])
    first_ = F.col("r0") < F.col("r1")
    pick = lambda x, y: F.when(first_, F.col(x)).otherwise(F.col(y))
    return both.select(pick("r0", "r1").alias("row_a"), pick("s0", "s1").alias("sent_a"), pick("r1", "r0").alias("row_b"), pick("s1", "s0").alias("sent_b"), "score")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return align(table(spark, base, "search_notes")).select("row_a", "sent_a", "row_b", "sent_b").distinct()


def p5_scored(spark: SparkSession, base: str) -> DataFrame:
    return align(table(spark, base, "search_notes")).withColumn("score", F.round("score", 4))


QUERIES = {"p5_found": p5_found, "p5_scored": p5_scored}
