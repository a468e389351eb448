"""Problem 9: the subjects of each document.

Method: averaged word and subword embeddings with independent logistic outputs, one for each subject. A word's
vector is its own embedding plus the mean of those of its character n-grams; a sentence's is the mean over its
words. Training goes in rounds: each partition takes the common parameters, follows the gradients over its own
sentences, and returns its change of them; the changes are averaged over the partitions that touched a row.

Sentences first take their document's labels. In later rounds they take what the model, their document's labels and
the document's other sentences say together, so that labels which are wrong, missing or meant for other sentences
lose their hold; documents without labels then join in. A subject is a document's if at least `least` of its
sentences are about it; each document gets its strongest subject if there is none such.

Training reads at most `train_docs` labelled and `more_docs` other documents of at most `train_chars` characters,
those with the smallest hashes; every document, whole, is scored.

Defined results: null or empty texts, or texts without words, get the most frequent subject of the labels; a label
that is null or names no subject of the list is left out, repeated ones by the same rater count once, spellings
differ in case and outer blanks only; without subjects or labels the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import UPPER
from quillmere.session import cut, table

WORDS, GRAMS, DIM = 1 << 15, 1 << 14, 16
_LINK = r"\[\[[^\]\n]*\]\]"
_LAYOUT = re.compile(rf"^[ \t]*(?:[#|].*|(?:[-*+>][ \t]*)?{_LINK}(?:[ \t|/,>→·•-]*{_LINK})*[ \t]*)$", re.M)
_SAID = re.compile(r"\[\[(?:[^\]|\n]*\||[^\]|\n]*/)?([^\]\n]*)\]\]")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_BROKEN = re.compile(r"(?<=\w)[-‐¬­]\s*\n\s*(?=\w)")
_SENTENCE = re.compile(rf"(?<=[.!?])(?:\s*\[\d+\])?[*_`]*\s+(?=[*_`]*[{UPPER}])|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence, without headings, tables, code and lines that are links only; other links stay as the
    words a reader sees. Sentences of fewer than three words count only where a text has no longer ones."""
    if "```" in text:
        text = _FENCE.sub("\n\n", text)
    text = _LAYOUT.sub("\n\n", text)
    if "[[" in text:
        text = _SAID.sub(r" \1 ", text)
    text = _BROKEN.sub("", text)
    if "&" in text:
        text = text.replace("&nbsp;", " ")
    found = [_WORD.findall(s.lower()) for s in _SENTENCE.split(text)]
    return [w for w in found if len(w) >= 3] or [w for w in found if w]


def features(word: str) -> np.ndarray:
    """Rows of the embedding table: the word's own, then those of its character n-grams."""
    padded = f"<{word}>"
    own = zlib.crc32(word.encode()) % WORDS
    grams = {WORDS + zlib.crc32(padded[i : i + n].encode()) % GRAMS for n in (4, 6) for i in range(len(padded) - n + 1)}
    return np.array([own, *sorted(grams)], np.int64)


class Model:
    def __init__(self, subjects: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.subjects = subjects
        self.rows = (rng.standard_normal((WORDS + GRAMS, DIM)) * 0.05).astype(np.float32)
        self.rows[:WORDS] = 0
        self.out = (rng.standard_normal((DIM, len(subjects))) * 0.5).astype(np.float32)
        self.bias = np.full(len(subjects), -2.0, np.float32)

    def vector(self, rows: np.ndarray) -> np.ndarray:
        return self.rows[rows[0]] + self.rows[rows[1:]].mean(0)


class Sentences:
    """Sentences as word numbers, and the feature rows of the words."""

    def __init__(self, docs: list[list[list[str]]]):
        number: dict[str, int] = {}
        self.doc = np.array([d for d, sents in enumerate(docs) for _ in sents], np.int64)
        flat = [[number.setdefault(w, len(number)) for w in s] for sents in docs for s in sents]
        self.sizes = np.array([len(s) for s in flat], np.int64)
        self.words = np.array([w for s in flat for w in s], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        rows = [features(w) for w in number]
        self.own = np.array([r[0] for r in rows], np.int64)
        self.n_grams = np.array([max(1, len(r) - 1) for r in rows], np.int64)
        self.grams = np.concatenate([r[1:] if len(r) > 1 else r[:1] for r in rows]) if rows else np.zeros(0, np.int64)
        self.gram_starts = np.cumsum(self.n_grams) - self.n_grams

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        """The embedding rows of the n-grams of some distinct words, one word's after another's."""
        n = self.n_grams[words]
        return self.grams[np.repeat(self.gram_starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def means(self, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean vectors of some sentences; their distinct words and the rows of these words' n-grams; for each
        place of the sentences which of the words stands there, and in which sentence."""
        sizes = self.sizes[which]
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(which)), sizes)
        words, back = np.unique(self.words[np.repeat(self.starts[which] - begin, sizes) + np.arange(len(owner))], return_inverse=True)
        grams, n = self.grams_of(words), self.n_grams[words]
        vectors = rows[self.own[words]] + np.add.reduceat(rows[grams], np.cumsum(n) - n) / n[:, None]
        return np.add.reduceat(vectors[back], begin) / sizes[:, None], words, grams, back, owner


def train_locally(model: Model, data: Sentences, target: np.ndarray, weight: np.ndarray, rate: float, epochs: int, rng: np.random.Generator, batch: int = 256) -> None:
    """Follow the gradients of the logistic loss over some sentences (Adagrad)."""
    used = np.flatnonzero(weight > 0)
    sums = [np.full(p.shape, 1e-6, np.float32) for p in (model.rows, model.out, model.bias)]
    for _ in range(epochs):
        rng.shuffle(used)
        for a in range(0, len(used), batch):
            which = used[a : a + batch]
            x, words, grams, back, owner = data.means(model.rows, which)
            p = 1 / (1 + np.exp(-(x @ model.out + model.bias)))
            g = (p - target[which]) * weight[which][:, None] / len(which)
            gx = (g @ model.out.T) / data.sizes[which][:, None]
            order = np.argsort(back, kind="stable")
            per_word = np.add.reduceat(gx[owner[order]], np.searchsorted(back[order], np.arange(len(words))))
            n = data.n_grams[words]
            keys = np.concatenate([data.own[words], grams])
            change = np.concatenate([per_word, np.repeat(per_word / n[:, None], n, 0)])
            order = np.argsort(keys, kind="stable")
            named, first = np.unique(keys[order], return_index=True)
            grad = np.add.reduceat(change[order], first).astype(np.float32)
            sums[0][named] += grad**2
            model.rows[named] -= rate * grad / np.sqrt(sums[0][named])
            for k, (p_, gr) in enumerate(((model.out, x.T @ g), (model.bias, g.sum(0))), 1):
                sums[k] += gr**2
                p_ -= rate * gr / np.sqrt(sums[k])


def sharpened(model: Model, data: Sentences, labels: np.ndarray, labelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New targets and weights of sentences: what the model says of them, of their document, and its labels say."""
    if not len(data.sizes):
        return np.zeros((0, len(model.subjects))), np.zeros(0)
    x = data.means(model.rows, np.arange(len(data.sizes)))[0]
    logit = x @ model.out + model.bias
    p = 1 / (1 + np.exp(-logit))
    n = np.bincount(data.doc, minlength=len(labels))
    share = np.stack([np.bincount(data.doc, weights=p[:, k], minlength=len(labels)) for k in range(p.shape[1])], 1) / np.maximum(1, n)[:, None]
    prior = 2.5 * (share[data.doc] - 0.25) + np.where(labelled[data.doc][:, None], 1.5 * np.minimum(1, labels[data.doc]) - 0.5, 0)
    q = 1 / (1 + np.exp(-(logit + prior)))
    best = q.argmax(1)
    target = np.zeros_like(q)
    target[np.arange(len(q)), best] = q.max(1) > 0.45
    sure = np.where(labelled[data.doc], 1.0, np.abs(q.max(1) - 0.45) * 2)
    return target, np.minimum(1, sure)


def fit(sample: DataFrame, subjects: list[str], rounds: int = 8, parts: int = 4, epochs: int = 2) -> Model:
    """Train on a sample: text, labels (an array of shares by subject, null for none)."""
    sc = sample.sparkSession.sparkContext
    model = Model(subjects)
    for k in range(rounds):
        common = sc.broadcast((model.rows, model.out, model.bias))

        def run(batches: Iterator[pd.DataFrame], k: int = k, common=common) -> Iterator[pd.DataFrame]:
            own = Model(subjects)
            own.rows, own.out, own.bias = (p.copy() for p in common.value)
            texts, labels = [], []
            for batch in batches:
                texts += batch["text"].tolist()
                labels += batch["labels"].tolist()
            has = np.array([x is not None for x in labels], bool)
            y = np.array([np.zeros(len(subjects)) if x is None else np.asarray(x) for x in labels]).reshape(len(labels), len(subjects))
            data = Sentences([sentence_words(t) for t in texts])
            if k < 3:
                target, weight = np.minimum(1, y)[data.doc], has[data.doc].astype(float)
            else:
                target, weight = sharpened(own, data, y, has)
            train_locally(own, data, target, weight, 0.5 if k < 3 else 0.3, epochs, np.random.default_rng(k))
            changed = np.flatnonzero((own.rows != common.value[0]).any(1)).astype(np.int32)
            yield pd.DataFrame({"n": [int(weight.sum())], "at": [changed.tobytes()], "rows": [(own.rows[changed] - common.value[0][changed]).astype(np.float16).tobytes()], "out": [(own.out - common.value[1]).tobytes()], "bias": [(own.bias - common.value[2]).tobytes()]})

        sums, times = np.zeros_like(model.rows), np.zeros(len(model.rows))
        got = [r for r in sample.mapInPandas(run, "n bigint, at binary, rows binary, out binary, bias binary").collect() if r.n]
        for r in got:
            at = np.frombuffer(r["at"], np.int32)
            sums[at] += np.frombuffer(r["rows"], np.float16).reshape(-1, DIM)
            times[at] += 1
            model.out += np.frombuffer(r["out"], np.float32).reshape(model.out.shape) / len(got)
            model.bias += np.frombuffer(r["bias"], np.float32) / len(got)
        model.rows += sums / np.maximum(1, times)[:, None]
        common.unpersist()
    return model


class Scorer:
    """A model with the outputs of all words seen so far."""

    def __init__(self, model: Model, most_words: int = 500_000):
        self.model, self.most, self.number, self.known = model, most_words, {}, []

    def logits(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence its document's number and its outputs."""
        if len(self.number) > self.most:
            self.number, self.known = {}, []
        number, fresh = self.number, []
        flat, sizes, owner = [], [], []
        for d, sents in enumerate(docs):
            for s in sents:
                owner.append(d)
                sizes.append(len(s))
                for w in s:
                    k = number.get(w)
                    if k is None:
                        k = number[w] = len(number)
                        fresh.append(w)
                    flat.append(k)
        if fresh:
            self.known.append(np.array([self.model.vector(features(w)) @ self.model.out for w in fresh]))
            self.known = [np.concatenate(self.known)]
        if not sizes:
            return np.zeros(0, np.int64), np.zeros((0, len(self.model.subjects)))
        n = np.array(sizes)
        return np.array(owner), np.add.reduceat(self.known[0][np.array(flat)], np.cumsum(n) - n) / n[:, None] + self.model.bias


def assign(scorer: Scorer, texts: list[str | None], least: float, fallback: int) -> list[list[tuple[int, float]]]:
    """The subjects of each text, each with the share of sentences that are about it."""
    owner, logit = scorer.logits([sentence_words(t) if t else [] for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    p = 1 / (1 + np.exp(-logit))
    best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
    about = np.zeros((len(texts), len(scorer.model.subjects)))
    sure = p.max(1) >= 0.4 if len(p) else np.zeros(0, bool)
    np.add.at(about, (owner[sure], best[sure]), 1)
    weak = np.zeros_like(about)
    np.add.at(weak, owner, p)
    share = about / np.maximum(1, n)[:, None]
    out = []
    for d in range(len(texts)):
        own = [(k, float(share[d, k])) for k in np.flatnonzero(share[d] >= least)]
        if not own:
            k = int((about[d] + weak[d] / 1000).argmax()) if n[d] else fallback
            own = [(k, float(share[d, k]))]
        out.append(own)
    return out


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.25, train_docs: int = 3000, more_docs: int = 1500, train_chars: int = 20_000, parts: int = 4) -> DataFrame:
    """The subjects of every document: id, subject, share (of its sentences)."""
    spark = docs.sparkSession
    name = lambda c: F.lower(F.trim(c))
    names = sorted({r.s for r in areas.select(name("subject").alias("s")).filter("s IS NOT NULL AND s != ''").limit(1000).collect()})
    schema = f"`{id_col}` bigint, subject string, share double"
    known = labels.select(F.col("doc_id").cast("bigint").alias("d"), name("subject").alias("subject"), F.coalesce("rater", F.lit("")).alias("rater")).filter(F.col("subject").isin(names) & F.col("d").isNotNull()).distinct()
    votes = known.groupBy("d").pivot("subject", names).agg(F.count("rater")).na.fill(0) if names else None
    if not names or known.isEmpty():
        return spark.createDataFrame([], schema)
    most = F.greatest(*[F.col(f"`{s}`") for s in names], F.lit(1)) if len(names) > 1 else F.greatest(F.col(f"`{names[0]}`"), F.lit(1))
    shares = votes.select("d", F.array(*[(F.col(f"`{s}`") / most).cast("double") for s in names]).alias("labels"))
    fallback = names.index(known.groupBy("subject").count().orderBy(F.desc("count"), "subject").first()["subject"])
    fit_for = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("text")).filter(F.length("text").between(1, train_chars) & F.col("d").isNotNull())
    order = F.xxhash64("d")
    # only ids are sorted; the chosen ones, at most train_docs + more_docs, fetch their texts
    ids = fit_for.select("d")
    chosen = shares.join(ids, "d", "left_semi").orderBy(order).limit(train_docs).unionByName(ids.join(shares.select("d"), "d", "left_anti").orderBy(order).limit(more_docs).withColumn("labels", F.lit(None).cast("array<double>")))
    sample = cut(fit_for.join(F.broadcast(chosen), "d").repartition(parts, F.xxhash64("d")))
    scorer_of = spark.sparkContext.broadcast(fit(sample, names, parts=parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(scorer_of.value)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                found = assign(scorer, part["text"].tolist(), least, fallback)
                yield pd.DataFrame([(d, names[k], s) for d, own in zip(part["d"], found, strict=True) for k, s in own], columns=[id_col, "subject", "share"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("text")).filter(F.col("d").isNotNull())
    return rows.mapInPandas(run, schema)


def composition(found: DataFrame) -> DataFrame:
    """Documents and mean share by subject."""
    return found.groupBy("subject").agg(F.count("*").alias("n_documents"), F.round(F.avg("share"), 4).alias("mean_share"))


def p9_subjects(spark: SparkSession, base: str) -> DataFrame:
    return subjects_of(*(table(spark, base, t) for t in ("documents", "subject_labels", "subject_areas")))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return p9_subjects(spark, base).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, base: str) -> DataFrame:
    return composition(p9_subjects(spark, base))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
