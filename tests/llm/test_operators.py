"""Operators against brute force, round trips and known answers on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmere.llm import alignment, common, language, leaks, mixing, neighbours, pages, splitting, subjects, tokens

EN = "The value of the matrix comes from the table and not from the list. It remains open whether this is the case for all of them."
DE = "Es ist nicht klar, ob die Liste den Fehler erklärt. Die Fachleute prüfen die Proben, weil der Wert dort nicht stimmt."
UK = "Поки невідомо, чи ця таблиця є причиною помилки. Журнал фіксує відмови кожної перевірки."


# --- 1


def _languages(spark, rows, **kw):
    df = spark.createDataFrame(rows, "note_row bigint, text string")
    return language.identify(df, "note_row", "text", **kw).orderBy("note_row", "stretch").collect()


def test_language_stretches(spark):
    rows = [(i, f"Title\n{t}") for i, t in enumerate([EN, DE, UK] * 5)] + [(99, f"KT-1\n{EN} {UK}"), (100, "KT-2\n[[AB-1/CD-2]]\n12.5 77"), (101, None), (102, "")]
    found = _languages(spark, rows)
    by = {}
    for r in found:
        by.setdefault(r.note_row, []).append(r.lang)
    assert [by[i] for i in range(3)] == [["en"], ["de"], ["uk"]]
    assert by[99] == ["en", "uk"]
    assert not {100, 101, 102} & by.keys()
    assert all(0 <= r.confidence <= 1 for r in found)


def test_every_row_with_a_word_gets_a_language(spark):
    rows = [(i, f"Title\n{t}") for i, t in enumerate([EN, DE, UK] * 5)] + [(50, "Короткий заголовок про журнал і таблицю помилки\nok then."), (51, "Короткий текст тут"), (52, "Щшщ"), (53, "12 [[a]]")]
    found = {r.note_row: r for r in _languages(spark, rows)}
    assert [found[i].lang for i in (50, 51, 52)] == ["uk"] * 3
    assert not any(found[i].prose for i in (50, 51, 52))
    assert found[52].confidence == 0 < found[51].confidence < 1
    assert 53 not in found


def test_language_filter_has_no_false_negatives():
    f = language.Filter(bits=12)
    h = common.gram_hashes(common.codes("some text to hash"), 3)
    f.add(h, 2)
    assert ((f.languages(h) >> 2) & 1).all()
    assert (f.false_positives() < 0.01).all()


@pytest.mark.parametrize(("label", "want"), [("EN-GB", "en"), (" ukr", "uk"), ("German", "de"), ("root", None), ("", None), (None, None), ("UA", "uk")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(common.language_label(F.col("x"))).first()[0] == want


def test_mislabelled_only(spark):
    rows = [(1, f"T\n{EN}", "EN"), (2, f"T\n{EN}", "DE"), (3, f"T\n{EN}", None), (4, f"T\n{EN} {DE}", "EN"), (5, f"T\n{DE}", "de")] * 2
    df = spark.createDataFrame(rows, "note_row bigint, text string, language_branch string")
    got = {(r.note_row, r.stretch, r.lang) for r in language.mislabelled(df, "note_row", "text", "language_branch").collect()}
    assert got == {(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de")}


# --- 2


def _brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in np.argsort(-s[i])[:k]}


@pytest.mark.parametrize("part_rows", [400_000, 150])
def test_neighbours_against_brute_force(spark, part_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    x = (centres[np.arange(600) % 60] + 0.25 * rng.standard_normal((600, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = {(r.id, r.other) for r in neighbours.neighbours(df, "id", "v", part_rows=part_rows).collect()}
    want = _brute(np.arange(600), x, 5)
    assert len(want & got) / len(want) >= 0.97


def test_neighbours_of_copies_and_unusable(spark):
    v = np.eye(64)[0].tolist()
    rows = [(i, v) for i in range(50)] + [(100, None), (101, [0.0] * 64), (102, [1.0] * 63), (103, [float("nan")] * 64), (104, [None] * 64), (1, v)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v").collect()
    assert {r.id for r in got} == set(range(50))
    assert all(r.similarity == pytest.approx(1, abs=1e-4) and r.id != r.other for r in got)
    assert pd.Series([r.id for r in got]).value_counts().eq(5).all()


def _tight(n, dim, spread, seed=5):
    """Vectors around a few centres, as close to each other as `spread`."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    return (centres[np.arange(n) % 4] + spread * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("part_rows", [400_000, 100])
def test_neighbours_in_tight_clusters(spark, part_rows):
    x = _tight(800, 64, 0.001)
    rows = neighbours.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>"), "id", "v", part_rows=part_rows).collect()
    want = _brute(np.arange(800), x.astype(np.float64), 5)
    assert len(want & {(r.id, r.other) for r in rows}) / len(want) >= 0.95
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert max(abs(float(unit[r.id] @ unit[r.other]) - r.similarity) for r in rows) < 1e-6


def test_vectors_that_no_code_is_near_are_compared_with_all(spark):
    """Each vector gets k neighbours, the right ones, even if none lies within the radius."""
    x = np.random.default_rng(3).standard_normal((150, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = {(r.id, r.other) for r in neighbours.neighbours(df, "id", "v", radius=0.0, block_rows=60).collect()}
    assert got == _brute(np.arange(150), x, 5)


def test_copies_of_a_vector_share_neighbours_and_ids_their_vectors(spark):
    e = np.eye(64)
    near = e[0] * 0.9 + e[1] * 0.1
    rows = [(1, e[0]), (2, e[0]), (3, e[0]), (10, near), (10, e[9]), (11, e[9] * 2), (12, e[0] * 0.8 + e[1] * 0.3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id bigint, v array<double>")
    got = {}
    for r in neighbours.neighbours(df, "id", "v", k=3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert [o for _, o in sorted(got[2])] == [1, 3, 10]
    assert [o for _, o in sorted(got[11])][0] == 10
    assert [o for _, o in sorted(got[12])][0] == 10
    assert all(len(v) == 3 for v in got.values())


def test_parts_copy_each_vector_a_fixed_number_of_times():
    assert neighbours.stretches(24, 3) == [(0, 8), (8, 8), (16, 8)]
    assert sum(n for _, n in neighbours.stretches(29, 3)) == 29


# --- 3


def test_page_faults(spark):
    word = "the temperature of the sample stays the same in every run of the series"
    body = [f"{word}\n" * 6 for _ in range(4)]
    rows = [(i + 1, f"Proc. Studies {i}\n{b}well-known tempera-\nture of the samp1e is here\n{'' if i < 3 else 'x'}\nPage {i + 1} of 4", "f.pdf", i + 1, str(i + 1)) for i, b in enumerate(body)]
    df = spark.createDataFrame(rows, "page_id bigint, text string, source_path string, page int, page_label string")
    got = {(r.page_id, r.fault, r.word) for r in pages.faults(df).collect()}
    assert (1, "hyphen", "temperature") in got
    assert (2, "misread", "sample") in got
    assert sum(f == "furniture" for _, f, _ in got) == 4
    assert {r.line_no for r in pages.faults(df).filter("page_id = 1 AND fault = 'furniture'").collect()} == {1, 11}
    text = " ".join(r.text for r in pages.paragraphs(df).orderBy("paragraph").collect())
    assert "samp1e" not in text
    assert "tempera-" not in text
    assert "Page 2" not in text


# --- 4


def test_walk_equals_plain_merging():
    rng = random.Random(4)
    letters = "abcdeабв"
    for seed in range(15):
        pieces, merges = list(letters) + ["▁"], []
        for _ in range(40):
            a, b = rng.choice(pieces), rng.choice(pieces)
            merges.append((a, b))
            pieces.append(a + b)
        t = tokens.Tokenizer(merges)
        words = sorted({"▁" + "".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 14))) for _ in range(200)})
        assert list(t.walk(iter(words))) == [len(t.encode(w)) for w in words], seed


@pytest.mark.parametrize("most", [64 << 20, 130, 0])
def test_document_tokens(spark, most):
    docs = spark.createDataFrame([(1, "aa ab ab\n b"), (2, None), (3, ""), (4, "zz" * 500), (5, "ab")], "id int, text string")
    merges = spark.createDataFrame([(1, "a", "b"), (2, "▁", "ab"), (2, "▁", "ab"), (3, None, "x")], "merge_rank int, left_piece string, right_piece string")
    got = {r.id: r.n_tokens for r in tokens.count_tokens(docs, ["id"], "text", tokens.load_merges(merges), most).collect()}
    assert got == {1: 3 + 1 + 1 + 2, 2: 0, 3: 0, 4: 1001, 5: 1}


# --- 5


def test_sentences_pair_by_marks(spark):
    rows = []
    for k in range(40):
        en = [f"The log lists {100 + k} failures of part AB-{k}.", f"According to form CD-{k} the value rises to {700 + k} points.", f"Nothing is known of Velkoth{'ab'[k % 2]} yet."]
        uk = [f"За формою CD-{k} значення зростає до {700 + k} пунктів.", f"Журнал фіксує {100 + k} відмов частини AB-{k}."]
        rows += [(2 * k + 1, "Title\n" + " ".join(en), f"EN/1. M/1.{k}. Note.md", f"n{k}", "EN"), (2 * k + 2, "Заголовок\n" + " ".join(uk), f"UA/1. М/1.{k}. Нотатка.md", f"н{k}", "UA")]
    df = spark.createDataFrame(rows, "note_row bigint, text string, source_path string, title string, language_branch string").withColumn("modified_at", F.lit("2025-01-01").cast("timestamp"))
    got = {(r.row_a, r.sent_a, r.row_b, r.sent_b) for r in alignment.align(df).collect()}
    assert got == {x for k in range(40) for x in ((2 * k + 1, 1, 2 * k + 2, 2), (2 * k + 1, 2, 2 * k + 2, 1))}
    blocked = {(r.row_a, r.sent_a, r.row_b, r.sent_b) for r in alignment.align(df.withColumn("source_path", F.when(F.col("note_row") > 60, F.regexp_replace("source_path", r"/1\.\d+", "/1.99")).otherwise(F.col("source_path"))), block_rows=5).collect()}
    assert {x for x in got if x[0] < 60} <= blocked


@pytest.mark.parametrize(("a", "b"), [("Qordafyr", "Кордафир"), ("Hexvequin", "Гексвеквін"), ("Mirtshast", "Міртшаст"), ("Velkoth", "Велкот"), ("Fenmubex", "Фенмубекс")])
def test_names_meet(a, b):
    assert alignment.consonants(a) == alignment.consonants(b)


# --- 6


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word", "слово", "é́", "\n", "\n\n", ". ", ", ", "x" * 40]) + rng.choice(["", " "]) for _ in range(rng.randint(1, 900))) for _ in range(30)] + ["", "a" * 9000, None, "\n" * 700]
    df = spark.createDataFrame([(i, t, "paragraph" if i % 2 else None) for i, t in enumerate(texts)], "block_id bigint, text string, block_kind string")
    limits = {"default": (300, 40), "paragraph": (200, 0)}
    got = splitting.split_texts(df, "block_id", "text", "block_kind", limits, range_chars=700).toPandas().sort_values(["id", "range", "piece"])
    assert set(got["id"]) == {i for i, t in enumerate(texts) if t is not None}
    for i, g in got.groupby("id"):
        most, over = limits["paragraph" if i % 2 else "default"]
        assert g["start"].iloc[0] == 0
        assert g["end"].iloc[-1] == len(texts[i])
        assert (g["end"] - g["start"]).max() <= most
        assert ((g["end"].to_numpy()[:-1] - g["start"].to_numpy()[1:]) == over).all()
        assert all(texts[i][a:b] == t for a, b, t in zip(g["start"], g["end"], g["text"], strict=True))


def test_files_by_byte_ranges(spark, tmp_path):
    text = "".join(f"Речення номер {i} тут. Sentence {i} here, with more.\n" + ("\n" if i % 7 == 0 else "") for i in range(900))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "empty.txt").write_text("")
    got = splitting.split_files(spark, str(tmp_path), 200, 30, range_bytes=4096).toPandas().sort_values(["path", "chunk_index"])
    a = got[got["path"].str.endswith("a.txt")]
    raw = text.encode()
    assert all(raw[s:e].decode() == t for s, e, t in zip(a["start_byte"], a["end_byte"], a["text"], strict=True))
    assert a["text"].str.len().max() <= 200
    rebuilt = a["text"].iloc[0] + "".join(t[30:] for t in a["text"].iloc[1:])
    assert rebuilt == text
    assert a["chunk_index"].tolist() == list(range(len(a)))


def test_files_with_bytes_that_are_no_text(spark, tmp_path):
    """Offsets stay those of the file where bytes are no UTF-8."""
    raw = b"".join(b"Word %d here \xff\xfe and \xe2\x82 there.\n" % i for i in range(600))
    (tmp_path / "odd name.txt").write_bytes(raw)
    got = splitting.split_files(spark, str(tmp_path), 100, 10, range_bytes=2048).toPandas().sort_values("chunk_index")
    assert got["start_byte"].iloc[0] == 0 and got["end_byte"].iloc[-1] == len(raw)
    assert all(raw[s:e].decode("utf-8", "surrogateescape").translate(splitting._REPLACED) == t for s, e, t in zip(got["start_byte"], got["end_byte"], got["text"], strict=True))


def test_numbers_go_on_over_buckets(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    got = splitting.numbered(df, ["g"], ["id"], [F.floor(F.col("id") / 100)], "at").toPandas()
    for _, g in got.groupby("g"):
        assert (g.sort_values("id")["at"].to_numpy() == np.arange(len(g))).all()


# --- 7


def test_leaks_at_the_least_density_that_is_accepted(spark):
    """Documents that hold an item in runs of five words with every sixth changed have no n-gram of six of it, but one."""
    names = [f"{a}{b}" for a in ("lum", "vik", "nor", "zet", "qua", "pel") for b in ("rith", "dal", "mex", "fyr", "koth", "bar", "nuth", "gar", "pol", "tiv")]
    changed = [w if k < 6 or k % 6 else "other" for k, w in enumerate(names)]
    found = leaks.leaks(spark.createDataFrame([(1, " ".join(names) + ".")], "item_id bigint, text string"), spark.createDataFrame([(9, " ".join(changed))], "doc_id bigint, text string"))
    assert [(r.item_id, r.doc_id) for r in found.collect()] == [(1, 9)]


def test_leaks(spark):
    passage = "The polymer chain in run NB-3515 reached 27 units after 113 hours. If the acid titration fails, the precipitate can be rebuilt from archive LX-7395 in 174 hours."
    other = "The copper wire in run QQ-1111 reached 99 units after 555 hours. If the slow reaction fails, the mixture can be rebuilt from archive ZZ-2222 in 333 hours."
    shared = "Read the passage and answer the question below."
    items = [(k, f"{shared}\n{t}") for k, t in ((1, passage), (2, f"Something else about {other.lower()[:22]} that is entirely new and was never seen by anyone so far."), (3, "A third item has words of its own, quite unlike the rest."))]
    noisy = passage.replace("reached", "re-\nached").replace("27 units", "27[3] units").replace("archive", "**archive**").upper()
    docs = [(11, f"Before. {passage} After."), (12, f"Intro text here.\n{noisy}"), (13, f"{shared} {other}"), (14, None), (15, ""), (11, passage)]
    found = leaks.leaks(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = found.collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(1, 11), (1, 12)}
    whole = next(r for r in rows if r.doc_id == 11 and r.span_start)
    assert docs[0][1][whole.span_start : whole.span_end].startswith("The polymer")
    sliced = leaks.leaks(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string"), slice_items=1)
    assert {(r.item_id, r.doc_id) for r in sliced.collect()} == {(1, 11), (1, 12)}


def test_words_fold_layout():
    a, _ = leaks.words(["Café costs 1,363 in the well known shop"])
    b, _ = leaks.words(["CAFÉ  costs 1\u00a0363[12] in *the* we\u00adll-known`shop`"])
    assert (a == b).all()


# --- 8


def test_split_tree_is_exact():
    rng = np.random.default_rng(2)
    counts = np.array([100, 7, 0, 31])
    for shards in (1, 2, 5, 8):
        t = mixing.split_tree(counts, shards, rng)
        assert t.shape == (shards, 4)
        assert (t.sum(0) == counts).all()
        assert np.ptp(t.sum(1)) <= 1 + shards.bit_length()


def test_mix(spark):
    docs = spark.createDataFrame([(i, "a" if i < 600 else "b", 10 + i % 7) for i in range(660)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "A ", 0.5, 2, 1.0), ("m", "b/", 0.5, 3, 1.0), ("m", "c", 0.2, 3, 1.0), ("m", "d", None, None, 1.0), ("n", "b", 1.0, None, 0.05)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    got = mixing.mix(docs, targets).toPandas()
    uses = got[got["mix"] == "m"].groupby(["source", "doc_id"]).size()
    total = docs.agg(F.sum("n_tokens")).first()[0]
    assert uses["b"].max() == 3
    assert uses["a"].max() == 1
    assert got[(got["mix"] == "m") & (got["source"] == "a")]["n_tokens"].sum() == pytest.approx(total / 2, rel=0.01)
    assert got[(got["mix"] == "n")].groupby("doc_id").size().max() == 1
    for _, g in got.groupby(["mix", "shard"]):
        assert sorted(g["position"]) == list(range(1, len(g) + 1))
    reached = {(r["mix"], r["source"]): r for r in mixing.shares(mixing.mix(docs, targets), targets).collect()}
    assert reached["m", "c"].reached_tokens == 0


def test_a_large_source_is_drawn_in_part_without_one_window(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 9 + 1).alias("n_tokens"))
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.37)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    got = mixing.mix(docs, targets, most_blocks=2).toPandas()
    total = docs.agg(F.sum("n_tokens")).first()[0]
    assert abs(got["n_tokens"].sum() - 0.37 * total) <= 9
    assert got["doc_id"].is_unique


# --- 9


def test_lines_with_links_keep_their_words():
    got = subjects.sentence_words("# Head\n[[A]] | [[b/c]]\nThe court ruling stands, see [[x/Law|the law]] and [[EN/Appeal]] there.\n```\nno code here\n```")
    assert got == [["the", "court", "ruling", "stands", "see", "the", "law", "and", "appeal", "there"]]
    assert subjects.sentence_words("Court ruling.") == [["court", "ruling"]]


def test_subjects(spark):
    rng = random.Random(9)
    terms = {"law": ["court ruling", "legal guardian", "appeal deadline", "notary record"], "sport": ["league match", "relay team", "penalty kick", "swimming lane"]}
    forms = ["The log lists many failures of the {}.", "It remains open whether the {} holds for the group.", "Without the {} the estimate drops by some points."]
    text = lambda s, n: " ".join(rng.choice(forms).format(rng.choice(terms[s])) for _ in range(n))
    docs, truth = [], {}
    for i in range(200):
        s = ["law", "sport"][i % 2]
        both = i % 10 == 0
        docs.append((i, text(s, 6) + (" " + text("sport" if s == "law" else "law", 5) if both else "")))
        truth[i] = {"law", "sport"} if both else {s}
    docs += [(900, None), (901, "")]
    labels = [(i, (" LAW" if "law" in truth[i] else "sport") if i % 11 else "sport", f"r{i % 3}") for i in range(0, 120)] + [(5, None, "r1"), (6, "unknown", None)]
    areas = spark.createDataFrame([("law", ""), ("sport", ""), (None, "")], "subject string, description string")
    found = subjects.subjects_of(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string, rater string"), areas).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == {d for d, _ in docs}
    assert np.mean([got[i] == truth[i] for i in truth]) >= 0.9
    assert len(got[900]) == len(got[901]) == 1
