"""The operators do the whole job: copies, shared passages, large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import alignment, leaks

PASSAGE = "The polymer chain in run NB-3515 reached 27 units after 113 hours. If the acid titration fails, the precipitate can be rebuilt from archive LX-7395 in 174 hours. Readers of Lumrith should compare the superfluid film with version DX-5198."
COPY = "Ulvmuquin keeps two copies of the shipping cost in vault TX-2831. The log lists 529 failures of the currency reserve in building two."


def _leaks(spark, items, docs):
    return {(r.item_id, r.doc_id) for r in leaks.leaks(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}


def test_copies_and_shared_passages_leak_under_every_id(spark):
    asked = [f"What does {name} say about the {thing}?" for name, thing in zip(("Plotist", "Velnumex", "Tezriquin", "Sabtivik", "Hexpebex"), ("film", "archive", "chain", "run", "hours"), strict=True)]
    shared = "Read the passage and answer the question below."
    items = [(k, f"{COPY}\nWhat is listed there?") for k in range(1, 5)]
    items += [(10 + k, f"{PASSAGE}\n{q}") for k, q in enumerate(asked)]
    # the same passage broken elsewhere, and instructions before passages of their own
    items += [(20 + k, f"{shared}\n{PASSAGE.replace(w, chr(10) + w)}\n{asked[k]}") for k, w in enumerate(("chain", "units", "titration", "archive"))]
    items += [(30 + k, f"{shared}\nAbout {w} alone there are quite some words which nobody else has {w} used.\nWhy?") for k, w in enumerate(("copper", "kidney", "parish"))]
    docs = [(1, f"Before. {COPY} After."), (2, f"Some words. {PASSAGE} More of them."), (3, f"{shared} Nothing that any item has."), (4, None)]
    want = {(k, 1) for k in range(1, 5)} | {(10 + k, 2) for k in range(5)} | {(20 + k, 2) for k in range(4)}
    assert _leaks(spark, items, docs) == want


def test_a_line_repeated_in_one_item_stays(spark):
    line = "Any change to the parser module must wait until Mirtkoth signs form LT-3362 at noon."
    assert _leaks(spark, [(1, f"{line}\n{line}\n{line}\nWhy?")], [(1, f"So. {line} {line} {line} End."), (2, "Else.")]) == {(1, 1)}


def _notes(spark, rows):
    return spark.createDataFrame(rows, "note_row bigint, text string, source_path string, title string").withColumn("modified_at", F.lit("2025-01-01").cast("timestamp"))


def _aligned(df, **how):
    return {(x.row_a, x.sent_a, x.row_b, x.sent_b) for x in alignment.align(df, **how).collect()}


def _alike(packed, large, names, **how):
    return alignment.Space(names, np.ones((len(names) + 1, 4), np.float32))


@pytest.mark.parametrize("block_rows", [7, 8, 1500])
def test_windows_reach_over_blocks(spark, monkeypatch, block_rows):
    """A sentence that two say in the other language pairs with both, in one block or in many."""
    monkeypatch.setattr(alignment, "fit", _alike)
    rows = []
    for r in range(3):
        ks = range(10 * r, 10 * r + 10)
        rows.append((r + 1, "Title\n" + " ".join(f"Form AB-{k} goes with CD-{k}." for k in ks), "EN/1. M/1.1. Note.md", "n"))
        rows.append((r + 4, "Заголовок\n" + " ".join(f"Акт AB-{k} є тут. Акт CD-{k} є там." for k in ks), "UA/1. М/1.1. Нотатка.md", "н"))
    got = _aligned(_notes(spark, rows), block_rows=block_rows)
    assert got == {(r + 1, k + 1, r + 4, 2 * k + half) for r in range(3) for k in range(10) for half in (1, 2)}


def test_marks_alone_pair_nothing(spark, monkeypatch):
    """Without vectors there are no pairs, whatever the marks."""
    monkeypatch.setattr(alignment, "fit", lambda packed, large, names, **k: alignment.Space(names, np.zeros((len(names) + 1, 4), np.float32)))
    rows = [(1, "Title\nForm AB-1 goes with CD-1. Form AB-2 goes with CD-2.", "EN/1. M/1.1. Note.md", "n"), (2, "Заголовок\nАкт AB-1 є тут при CD-1. Акт AB-2 є там при CD-2.", "UA/1. М/1.1. Нотатка.md", "н")]
    assert not _aligned(_notes(spark, rows * 3))


def _captured(monkeypatch):
    seen, fit = [], alignment.fit
    monkeypatch.setattr(alignment, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    return seen


@pytest.mark.parametrize("block_rows", [1500, 6])
def test_space_takes_every_note_and_term(spark, monkeypatch, block_rows):
    """Notes of any number and size train, by the same marks, and every term that they have often enough counts."""
    words = [(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}", f"ж{chr(1072 + k // 26)}{chr(1072 + k % 26)}") for k in range(60)]
    say = lambda k, side: f"Form AB-{k} {words[k % 60][side]} to CD-{k}." if side == 0 else f"Акт AB-{k} {words[k % 60][side]} до CD-{k}."
    rows = [(2 * n + side, "Title\n" + " ".join(say(k, side) for k in range(n, 240, 3)), f"{'EU'[side]}/1. M/1.{n}. Note.md", None) for n in range(3) for side in (0, 1)]
    seen = _captured(monkeypatch)
    _aligned(_notes(spark, rows), block_rows=block_rows)
    space = seen[0]
    assert {w for pair in words for w in pair} <= set(space.names)
    unit = lambda w: space.vector(w) / (space.vector(w) ** 2).sum() ** 0.5
    assert all(max(words, key=lambda p: float(unit(a) @ unit(p[1])))[1] == b for a, b in words)
    # one mark alone trains at no size
    _aligned(_notes(spark, [(r, t.replace("CD-", "") if t else t, p, x) for r, t, p, x in rows]).withColumn("text", F.regexp_replace("text", r"(to|до) \d+", "it")), block_rows=block_rows)
    assert not seen[1].matrix.any()


def test_large_and_packed_notes_pair_alike(spark, monkeypatch):
    """Each size of block gives the same training and the same pairs; repeated rows and sentences pair each."""
    seen = _captured(monkeypatch)
    words = [("value", "значення"), ("table", "таблиця"), ("list", "перелік"), ("drawer", "шухляда")]
    rows = [(1, "Title\n" + " ".join(f"Form AB-{k} has a {words[k % 4][0]} to CD-{k}." for k in range(20)), "EN/1. M/1.1. Note.md", "n"), (2, "Заголовок\n" + " ".join(f"Акт AB-{k} має {words[k % 4][1]} до CD-{k}." for k in range(20)), "UA/1. М/1.1. Нотатка.md", "н")]
    df = _notes(spark, [*rows, (3, *rows[0][1:]), (4, None, "EN/1. M/1.1. Note.md", "n"), (5, "One line", None, None)])
    got = [_aligned(df, block_rows=n) for n in (1500, 6)]
    assert got[0] == got[1] == {x for k in range(1, 21) for x in ((1, k, 2, k), (2, k, 3, k))}
    assert (seen[0].matrix == seen[1].matrix).all()
    assert {"value", "значення"} <= set(seen[0].names)
