"""What several operators of this package share: labels, sentences, folded text, rolling hashes."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "uk", "de", "fr", "pl", "es")

#: Spellings of language labels, regions cut off and case ignored.
LABELS = {
    "en": ("en", "eng", "english"),
    "uk": ("ua", "uk", "ukr", "ukrainian"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "pl": ("pl", "pol", "polish"),
    "es": ("es", "spa", "spanish"),
}

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĞĢĪĮİĶŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽЀ-ЯҐ"
_SENTENCE = re.compile(rf"(?<=[.!?])\s+(?=[{UPPER}])")


def language_label(label: Column) -> Column:
    """The language that a label names, else null. Case, blanks and regions (`EN-GB`) don't count."""
    key = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    out = F.lit(None).cast("string")
    for language, names in LABELS.items():
        out = F.when(key.isin(*names), language).otherwise(out)
    return out


def sentences(text: str) -> list[str]:
    """Sentences end at `.`, `!` or `?` before white space and an upper-case letter, or with the text."""
    return [s for s in _SENTENCE.split(text.strip()) if s]


def _fold_table() -> dict[int, str]:
    out = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))
        if ord(base[0]) < 0x80:
            out[code] = base[0]
    out.update({ord("ł"): "l", ord("Ł"): "L", ord("ß"): "ss", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("đ"): "d"})
    return out


FOLD = _fold_table()


def codes(text: str) -> np.ndarray:
    """The code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a multiply and two shifts)."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n code points from each position on; the last n-1 positions have none."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x100000001B3)
    h = np.zeros(len(points) - n + 1, np.uint64)
    wide = points.astype(np.uint64)
    for k in range(n):
        h = h * base + wide[k : len(points) - n + 1 + k] + np.uint64(n)
    return mixed(h)
