"""Quality score of a text: boosted trees over statistics of the whole text.

The trees are trained on at most about ``SAMPLE`` labelled rows (the bound is a parameter; rows are taken by a hash of the id,
so the sample is the same on every run) and applied to every text in Arrow batches.

Edge cases: a null text counts as an empty one; without any usable label every score is 0.5; rows whose label or id is null
are not learned from; repeated rows are scored each for itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.llm import boosting
from cadaspark.llm.arrow import map_text

SAMPLE = 20_000
WORD = re.compile("[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
STATISTICS = [
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "distinct_pairs", "same_as_last",
    "upper", "digits", "not_ascii", "letters", "space", "symbols", "exclamations", "bars", "stops", "commas", "lines",
    "words_a_line", "repeated_lines", "entropy", "upper_words",
]


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of ``STATISTICS``."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    counts = Counter(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_counts = np.bincount(points[points < 128], minlength=128)
    upper = int(ascii_counts[65:91].sum()) + sum(k for c, k in _rare(points) if c.isupper())
    lower = int(ascii_counts[97:123].sum())
    wide = chars - int(ascii_counts.sum())
    full = ascii_counts[ascii_counts > 0] * per_char
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    letters = int(ascii_counts[65:91].sum()) + lower + wide
    return [
        math.log1p(chars), math.log1p(n), sum(map(len, words)) * per_word, math.log1p(max(map(len, words), default=0)),
        len(counts) * per_word, max(counts.values(), default=0) * per_word,
        len(set(zip(words, words[1:]))) / max(n - 1, 1), sum(map(str.__eq__, words, words[1:])) * per_word,
        upper / max(letters, 1), int(ascii_counts[48:58].sum()) * per_char, wide * per_char, letters * per_char,
        text.count(" ") * per_char, sum(int(ascii_counts[ord(c)]) for c in SYMBOLS) * per_word,
        int(ascii_counts[33]) * per_word, int(ascii_counts[124]) * per_word, int(ascii_counts[46]) * per_word,
        int(ascii_counts[44]) * per_word, math.log1p(len(lines)), n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), float(-(full * np.log(full)).sum()), sum(map(str.isupper, words)) * per_word,
    ]


def _rare(points: np.ndarray) -> list[tuple[str, int]]:
    """Characters beyond ASCII with their counts."""
    values, counts = np.unique(points[points >= 128], return_counts=True)
    return [(chr(v), int(k)) for v, k in zip(values, counts, strict=True)]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> boosting.Forest:
    """Train on labelled documents. ``learn`` is a condition on ``doc_id`` that says which rows may be learned from."""
    usable = labels.where(learn & F.col("quality").isNotNull()).select("doc_id", "quality")
    total = usable.count()
    if total > sample:
        share = int(sample / total * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share)
    # about `sample` rows of two numbers: a proven bound
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")

    def build() -> Callable:
        return lambda texts: [pa.array(list(matrix(texts)), pa.list_(pa.float64()))]

    rows = map_text(chosen, "text", ["doc_id", "quality"], "x array<double>", build).toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return boosting.train(x, (rows["quality"] > 0).to_numpy())


def score(docs: DataFrame, forest: boosting.Forest, carry: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``carry`` columns and ``out``, the probability of the good label."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def build() -> Callable:
        trees = shared.value
        return lambda texts: [pa.array(trees.probability(matrix(texts)))]

    return map_text(docs, text, carry, f"{out} double", build)
