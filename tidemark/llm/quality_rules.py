"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at a whole text and votes +1 (sound), -1 (junk) or 0 (abstains). A text's votes are its
pattern; texts are counted by pattern over all documents, at most 3**rules rows, and only those counts reach
the driver. Two hidden classes explain them: EM estimates the share of sound texts and, for each rule
and class, how often it votes each way, from which its accuracy follows. The posterior of "sound"
given the pattern replaces "all rules must pass": a text goes if it falls below ``threshold``, or if it fails the base rule
(fewer than 50 words, or more than half of the words inside repeated 3-word windows).

Defined cases: a null text has no words. Rows that repeat an id are judged each by itself. An empty table
gives an empty result. Rules are estimated from the texts that pass the base rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, read

MIN_WORDS, MAX_REPEAT_SHARE, THRESHOLD = 50, 0.5, 0.5
SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STOP = re.compile(rb"[.!?:;\"')\]](?=[\x20\x09-\x0D]*(?:\n|$))")

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_stops", "n_marks", "n_distinct", "n_adjacent"]


def repeat_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; codes: one number for each distinct word."""
    n = len(codes)
    if n < 4:
        return 0
    size = int(codes.max()) + 1
    if size < 1 << 21:
        key = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    else:
        two = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1].astype(np.int64)
        key = two[:-1] * size + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def features(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), *[0] * (len(FEATURES) - 3))
    white = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    code: dict[bytes, int] = {}
    codes = np.fromiter([code.setdefault(w, len(code)) for w in words], np.int64, n)
    # Words in capitals: no a-z, and two or more of A-Z.
    capitals = np.fromiter([w.isupper() and len(w) - len(w.translate(None, _CAPITALS)) > 1 for w in code], bool, len(code))
    return (
        n, len(text) - white, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(codes), len(lines),
        int(capitals[codes].sum()), len(_STOP.findall(raw)), raw.count(b"!") + raw.count(b"?"), len(code), int((codes[1:] == codes[:-1]).sum()),
    )


def _ratio(a: str, b: str = "n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """name: (junk if, sound if); a rule abstains where neither holds."""
    symbols, repeats, caps, length = _ratio("n_symbols"), _ratio("n_repeat_words"), _ratio("n_caps"), _ratio("word_chars")
    marks, runs, ends = _ratio("n_marks"), _ratio("n_adjacent"), _ratio("n_stops", "n_lines")
    never = F.lit(False)
    return {
        "symbols": (symbols > 0.2, symbols < 0.02),
        "repeated_windows": (repeats > 0.3, never),
        "repeated_lines": (_ratio("n_dup_lines", "n_lines") > 0.3, never),
        "capitals": (caps > 0.4, never),
        "word_length": ((length < 2.5) | (length > 12), never),
        "line_ends": ((ends < 0.3) & (F.col("n_lines") >= 3), never),
        "marks": (marks > 0.25, never),
        "word_runs": (runs > 0.15, never),
        "prose": (never, (symbols < 0.1) & (caps < 0.2) & (marks < 0.15) & (runs < 0.1) & (repeats < 0.2)),
        "sentences": (never, (ends > 0.6) & (_ratio("n_words", "n_lines") > 5) & (symbols < 0.1) & (caps < 0.2) & (runs < 0.1)),
    }


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs besides text_col, and FEATURES (which replace columns of these names)."""
    own = [c for c in docs.columns if c.lower() not in {*FEATURES, text_col.lower()}]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").alias("qr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *[pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * len(FEATURES))]], names=[*own, *FEATURES])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], *[f"{x} long" for x in FEATURES]]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def pattern() -> Column:
    """The votes as one number below 3**rules."""
    votes = [F.when(bad, 0).when(ok, 2).otherwise(1) for bad, ok in rules().values()]
    return sum((v * 3**i for i, v in enumerate(votes)), F.lit(0)).cast("int")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1): share of sound texts, P(vote | class) as [class, rule, vote + 1], posteriors.

    It starts from the rules' own word: a pattern with a junk vote is junk. A hundredth of the texts as
    prior keeps every rule on its side: among junk it votes junk, among sound texts it doesn't.
    """
    n, r = patterns.shape
    total = counts.sum()
    prior = np.array([[4.0, 2.0, 1.0], [0.1, 3.0, 4.0]])[:, None, :] * max(total, 1) / 700
    votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = np.where((patterns == -1).any(axis=1), 0.1, 0.9)
    share, given = 0.5, np.full((2, r, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([1 - good, good]) * counts
        given = np.einsum("cn,nrv->crv", weight, votes) + prior
        given /= given.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (total + 2)
        log = np.einsum("nrv,crv->cn", votes, np.log(given)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return share, given, good


def accuracies(share: float, given: np.ndarray) -> list[float]:
    """P(vote is right | rule votes), of each rule."""
    right = share * given[1, :, 2] + (1 - share) * given[0, :, 0]
    wrong = share * given[1, :, 0] + (1 - share) * given[0, :, 2]
    return (right / (right + wrong)).tolist()


def posteriors(voted: DataFrame) -> DataFrame:
    """voted: n_words, n_repeat_words, qr_code of each text. qr_at, quality: P(sound | pattern), a row a pattern seen."""
    counts = voted.filter(~base_failed()).groupBy("qr_code").count().collect()  # at most 3**rules rows
    codes, width = np.array([c["qr_code"] for c in counts], np.int64), len(rules())
    good = estimate((codes[:, None] // 3 ** np.arange(width)) % 3 - 1, np.array([c["count"] for c in counts], float))[2] if counts else []
    return voted.sparkSession.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good)], "qr_at int, quality double")


def _verdict(threshold: float) -> Column:
    return ~base_failed() & (F.coalesce("quality", F.lit(0.0)) >= threshold)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, FEATURES, base_failed, quality (posterior that the text is sound) and kept, a row for each of docs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("qr_in"))
    voted = checkpointed(measured(rows, "qr_in").withColumn("qr_code", pattern()))
    out = voted.join(F.broadcast(posteriors(voted)), F.col("qr_code") == F.col("qr_at"), "left")
    return out.select("doc_id", *FEATURES, base_failed().alias("base_failed"), "quality", _verdict(threshold).alias("kept"))


def keep_sound(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text is kept. Texts are measured twice, once to count patterns and once to filter, so none is shuffled."""
    table = posteriors(measured(docs.select(F.col(f"`{text_col}`").alias("qr_in")), "qr_in").select("n_words", "n_repeat_words", pattern().alias("qr_code")))
    rows = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("qr_row"), F.col(f"`{text_col}`").alias("qr_in")), "qr_in")
    out = rows.withColumn("qr_code", pattern()).join(F.broadcast(table), F.col("qr_code") == F.col("qr_at"), "left")
    return out.filter(_verdict(threshold)).select("qr_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *FEATURES[:5], "base_failed", "kept", "quality")
