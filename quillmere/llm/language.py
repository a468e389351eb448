"""Problem 1: the language of each row and of each stretch in one language.

Method: language-bitmask n-gram filters. A bit-sliced Bloom filter holds, for each slot, one bit for
each language; the AND of an n-gram's slots is the set of all languages that contain it. A sentence's
hits are counted by language, corrected for the filter's false positives, and the counts decide.

Training takes no labels: sentences that hold more of one language's function words than of any other's
(Cyrillic script counts as Ukrainian) teach that language's n-grams. It reads at most `train_rows` rows of at most
`train_chars` characters, those with the smallest hashes; every row, whole, is then scored.

A text without prose (no sentence of three words) is one stretch, its heading and body together, with a confidence that
its few n-grams lower; where none of them is known, script decides, with a confidence of 0.

Defined results: a null or empty text, or one without any word (numbers, codes, links only), has no stretch; a text of any
length is scored whole; repeated rows give a result each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import FOLD, LANGUAGES, codes, gram_hashes, language_label, sentences

#: Frequent function words, Latin letters folded to ASCII.
FUNCTION_WORDS = {
    "en": "the of and is to in that for with was are this from by be which it at only when if into than not has but or an its more after before between what".split(),
    "de": "der die das und ist nicht mit den von zu ein eine auf fur im dem des auch nach bei wird oder wie noch am aus sich einen zeigt bis nur als".split(),
    "fr": "le les des est et une dans que pour pas sur du au qui avec ne ce plus sans ou selon aux par apres n'est cette d'un l'on nous elle il".split(),
    "pl": "jest nie sie w z do ze to jak po od oraz ktory przez dla tylko juz lub czy niz jeszcze podczas gdy na przy tego ich sa byl staje".split(),
    "es": "el los las de que y en un una por con no se del es para su al lo segun como mas tras pero sin muestra desde aun entre este".split(),
}
_LINK = re.compile(r"\[\[.*?\]\]|https?://\S+|www\.\S+|\S+@\S+\.\w+|`[^`\n]*`")
_CODED = re.compile(r"\b\w*\d[\w.,:/-]*|\b[A-Z]{2,}-\d+\b")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_WORD = re.compile(r"[^\W\d_]{2,}")
SIZES = (3, 4, 5)
FIT_COLUMNS = "`{id}` bigint, stretch int, lang string, confidence double, n_sentences int, n_stretches int, first_sentence int, prose boolean"


def plain(text: str) -> str:
    """Letters only: links, codes and numbers cut out, case and Latin accents folded."""
    text = _CODED.sub(" ", _LINK.sub(" ", text))
    return " ".join(_NOT_LETTER.sub(" ", text.lower().translate(FOLD).replace("'", "").replace("’", "")).split())


def seed_language(clean: str) -> str | None:
    """The language whose function words a cleaned sentence holds most of, if there is one."""
    letters = len(clean)
    if letters and len(_CYRILLIC.findall(clean)) * 2 > letters:
        return "uk"
    words = clean.split()
    hits = {lang: sum(w in known for w in words) for lang, known in _KNOWN.items()}
    ordered = sorted(hits.items(), key=lambda x: -x[1])
    return ordered[0][0] if ordered[0][1] >= 2 and ordered[0][1] > ordered[1][1] else None


_KNOWN = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}


class Filter:
    """A bit-sliced Bloom filter: for each slot a byte, a bit of it for each language."""

    def __init__(self, bits: int = 20, hashes: int = 2):
        self.bits, self.hashes = bits, hashes
        self.slots = np.zeros(1 << bits, np.uint8)

    def _at(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(k * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def add(self, h: np.ndarray, language: int) -> None:
        for k in range(self.hashes):
            self.slots[self._at(h, k)] |= np.uint8(1 << language)

    def languages(self, h: np.ndarray) -> np.ndarray:
        """For each hash, the bits of all languages that contain it."""
        out = self.slots[self._at(h, 0)]
        for k in range(1, self.hashes):
            out = out & self.slots[self._at(h, k)]
        return out

    def false_positives(self) -> np.ndarray:
        """For each language, the chance that an n-gram it lacks is found all the same."""
        filled = [(self.slots >> b & 1).mean() for b in range(len(LANGUAGES))]
        return np.asarray(filled) ** self.hashes


def train(texts: list[str], least: int = 2, share: float = 0.15) -> Filter:
    """Fill a filter. An n-gram counts for a language if it is there `least` times and at least
    `share` times as often, by its rate, as in the language that has it most."""
    by = {lang: [*FUNCTION_WORDS.get(lang, ())] * least for lang in LANGUAGES}
    for text in texts:
        for s in sentences(text.partition("\n")[2] or text):
            clean = plain(s)
            if lang := seed_language(clean):
                by[lang].append(clean)
    grams, counts, langs = [], [], []
    for k, lang in enumerate(LANGUAGES):
        points = codes("\0".join(f" {s} " for s in by[lang]))
        hashes = [gram_hashes(points, n)[_inside(points, n)] for n in SIZES]
        h, c = np.unique(np.concatenate(hashes), return_counts=True)
        h, c = h[c >= least], c[c >= least]
        grams.append(h)
        counts.append(c / max(1, sum(map(len, hashes))))
        langs.append(np.full(len(h), k))
    h, rate, lang = map(np.concatenate, (grams, counts, langs))
    _, back = np.unique(h, return_inverse=True)
    most = np.zeros(back.max() + 1 if len(back) else 0)
    np.maximum.at(most, back, rate)
    keep = rate >= share * most[back]
    out = Filter()
    for k in range(len(LANGUAGES)):
        out.add(h[keep & (lang == k)], k)
    return out


def _inside(points: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram from each position on lies within one sentence."""
    ends = np.concatenate([[0], np.cumsum(points == 0)])
    return ends[n:] == ends[: len(ends) - n]


def score(filter_: Filter, clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hits by sentence and language, corrected for false positives, and the number of n-grams."""
    total, hits = np.zeros(len(clean)), np.zeros((len(clean), len(LANGUAGES)))
    points = codes("\0".join(f" {s} " for s in clean))
    owner = np.cumsum(points == 0)
    for n in SIZES:
        inside = _inside(points, n)
        found = filter_.languages(gram_hashes(points, n)[inside])
        at = owner[: len(inside)][inside]
        total += np.bincount(at, minlength=len(clean))[: len(clean)]
        for b in range(len(LANGUAGES)):
            hits[:, b] += np.bincount(at, weights=found >> b & 1, minlength=len(clean))[: len(clean)]
    false = filter_.false_positives()
    return np.maximum(0, hits - total[:, None] * false) / (1 - false), total


def stretches(text: str | None) -> tuple[list[str], bool]:
    """The cleaned sentences of a text and whether they are prose; the first line is left out where prose follows it.
    A text without prose is one sentence, one without words none."""
    if not text:
        return [], False
    head, _, body = text.partition("\n")
    parts = sentences(body)
    clean = [plain(s) for s in parts]
    if any(len(_WORD.findall(c)) >= 3 for c in clean):
        return clean, True
    whole = plain(text)
    return [whole] if _WORD.search(whole) else [], not body.strip() and len(_WORD.findall(plain(head))) >= 4


def score_batch(filter_: Filter, batch: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The stretches of a batch of rows: id, text and what else goes with them."""
    rows, clean, prose = [], [], []
    for k, text in enumerate(batch.iloc[:, 1]):
        c, p = stretches(text)
        clean += c
        prose.append(p)
        rows += [k] * len(c)
    out: list[tuple] = []
    if clean:
        hits, total = score(filter_, clean)
        order = np.argsort(-hits, axis=1)
        best, second = (np.take_along_axis(hits, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        margin = (best - second) / np.maximum(1, total)
        sure = (margin >= 0.08) & (total >= 12)
        start = 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end] == rows[start]:
                continue
            k = rows[start]
            value = (batch.iat[k, 0], *batch.iloc[k, 2:])
            if prose[k]:
                out += [(*value, *x, True) for x in _runs(start, end, order[:, 0], sure, best, second)]
            elif best[start] > 0:
                share = best[start] / (best[start] + second[start]) * total[start] / (total[start] + 30)
                out.append((*value, 1, LANGUAGES[order[start, 0]], float(share), 1, 1, 1, False))
            else:
                script = "uk" if _CYRILLIC.search(clean[start]) else LANGUAGES[0]
                out.append((*value, 1, script, 0.0, 1, 1, 1, False))
            start = end
    return pd.DataFrame(out, columns=columns)


def _runs(start, end, top, sure, best, second) -> list[tuple]:
    """One row's stretches. A sentence that can't be told takes its forerunner's language, else its successor's."""
    lang: list[int | None] = [int(top[i]) if sure[i] else None for i in range(start, end)]
    if not any(x is not None for x in lang):
        i = max(range(start, end), key=lambda i: best[i] - second[i])
        lang[i - start] = int(top[i])
    for i in range(1, len(lang)):
        if lang[i] is None:
            lang[i] = lang[i - 1]
    for i in range(len(lang) - 2, -1, -1):
        if lang[i] is None:
            lang[i] = lang[i + 1]
    runs: list[list] = []
    for i, x in enumerate(lang):
        if not runs or runs[-1][0] != x:
            runs.append([x, i, 0.0, 0.0, 0])
        runs[-1][2] += best[start + i] if top[start + i] == x else second[start + i]
        runs[-1][3] += second[start + i] if top[start + i] == x else best[start + i]
        runs[-1][4] += 1
    return [(k, LANGUAGES[x], float(min(1.0, max(0.0, a / (a + b) if a + b else 0.0))), n, len(runs), i + 1) for k, (x, i, a, b, n) in enumerate(runs, 1)]


def identify(df: DataFrame, id_col: str, text_col: str, train_rows: int = 6_000, train_chars: int = 10_000, label: Column | None = None) -> DataFrame:
    """For each text its stretches in one language: id, stretch, lang, confidence (the language's share of
    its and its strongest rival's hits), n_sentences, n_stretches, first_sentence (1-based), prose; `named`, if a label is given."""
    sample = df.filter(F.length(text_col).between(1, train_chars)).select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h")).orderBy("h").limit(train_rows)
    trained = df.sparkSession.sparkContext.broadcast(train([r.t for r in sample.collect()]))

    schema = FIT_COLUMNS.format(id=id_col) if label is None else FIT_COLUMNS.format(id=id_col).replace("bigint,", "bigint, named string,", 1)
    columns = [id_col, *(["named"] if label is not None else []), "stretch", "lang", "confidence", "n_sentences", "n_stretches", "first_sentence", "prose"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                yield score_batch(trained.value, batch.iloc[at : at + 500], columns)

    own = [F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_text")]
    return df.select(*own, *([label.alias("named")] if label is not None else [])).filter(F.col(id_col).isNotNull()).mapInPandas(run, schema)


def mislabelled(df: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = 6_000) -> DataFrame:
    """The stretches of texts with prose whose label names no language or another than the text's, or with more than one language."""
    found = identify(df, id_col, text_col, train_rows, label=language_label(F.col(label_col)))
    return found.filter("prose").filter((F.col("n_stretches") > 1) | F.col("named").isNull() | (F.col("named") != F.col("lang"))).select(id_col, "stretch", "lang", "confidence").distinct()


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    from quillmere.session import table

    notes = table(spark, base, "search_notes")
    return mislabelled(notes, "note_row", "text", "language_branch").select("note_row", "stretch", "lang").distinct()


def p1_languages(spark: SparkSession, base: str) -> DataFrame:
    from quillmere.session import table

    notes = table(spark, base, "search_notes")
    return identify(notes, "note_row", "text").withColumn("confidence", F.round("confidence", 6))


QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages}
