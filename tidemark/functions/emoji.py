"""Emoji as units of text, in Python: no built-in function knows their joined sequences."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: The code points that count as emoji here.
RANGES = (
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA),
    (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6),
    (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF),
)
#: Joiner, keycap mark, selectors; skin tones; letters that make flags by two.
JOINER, KEYCAP, SELECTORS = 0x200D, 0x20E3, (0xFE0E, 0xFE0F)
TONES, FLAG_LETTERS = (0x1F3FB, 0x1F3FF), (0x1F1E6, 0x1F1FF)


def _class(ranges) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in ranges)


def _marks() -> list[tuple[int, int]]:
    """Runs of code points that combine with the one before them; none lies beyond the first two planes."""
    out: list[tuple[int, int]] = []
    for c in range(0x300, 0x20000):
        if unicodedata.combining(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


_LONE = [(JOINER, JOINER), (KEYCAP, KEYCAP), (SELECTORS[0], SELECTORS[1])]
_KEYCAP = f"[0-9#*]{chr(SELECTORS[1])}?{chr(KEYCAP)}"
_BASE = _class([r for r in RANGES if r != (0x1F000, 0x1FAFF)] + [(0x1F000, TONES[0] - 1), (TONES[1] + 1, 0x1FAFF)])
_EXTEND = _class([*_marks(), (KEYCAP, KEYCAP), SELECTORS, TONES])
#: Any emoji in a row, with stray connectors and tones: counts once.
RUN = re.compile(f"(?:{_KEYCAP}|[{_class([*RANGES, *_LONE])}])+")
#: One unit: a keycap, one or two flag letters, or a base with its modifiers and all that is joined to it. A connector or tone alone is none.
UNIT = re.compile(f"{_KEYCAP}|[{_class([FLAG_LETTERS])}]{{1,2}}|[{_BASE}][{_EXTEND}]*(?:{chr(JOINER)}(?:.[{_EXTEND}]*)?)*", re.S)
TOKEN = re.compile(r"https?://\S+|[#@]?\w+(?:[.'’_-]\w+)*")


def count_words(text: str | None, runs: bool = False, token: re.Pattern = TOKEN) -> int:
    """Words, and emoji: units that follow each other and are equal count once; with runs, any emoji in a row count once."""
    text, total, at, last = text or "", 0, 0, None
    for m in (RUN if runs else UNIT).finditer(text):
        if m.start() > at:
            total += len(token.findall(text, at, m.start()))
            last = None
        total += m[0] != last
        last, at = m[0], m.end()
    return total + len(token.findall(text, at))


def units(text: str | None) -> list[str]:
    return UNIT.findall(text or "")


def named(text: str | None) -> str | None:
    """Each unit replaced by :its_name:, the names of its code points joined by _; selectors and joiners have none."""
    if text is None:
        return None
    name = lambda c: unicodedata.name(c, f"u{ord(c):x}").lower().replace(" ", "_").replace("-", "_")
    return UNIT.sub(lambda m: ":" + "_".join(name(c) for c in m[0] if ord(c) not in (JOINER, *SELECTORS)) + ":", text)


def entropy(found: list[str]) -> float:
    n = len(found)
    return -sum(c / n * math.log(c / n) for c in Counter(found).values()) if n else 0.0


@F.pandas_udf(LongType())
def word_count(text: pd.Series) -> pd.Series:
    return text.map(count_words, na_action="ignore").fillna(0).astype("int64")


@F.pandas_udf(LongType())
def word_count_runs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: count_words(t, True), na_action="ignore").fillna(0).astype("int64")


@F.pandas_udf(ArrayType(StringType()))
def emoji_units(text: pd.Series) -> pd.Series:
    return text.map(units, na_action="ignore").map(lambda u: u if isinstance(u, list) else [])


@F.pandas_udf(StringType())
def with_names(text: pd.Series) -> pd.Series:
    return text.map(named, na_action="ignore")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC), which no built-in function makes."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
