"""Grouping of spelling variants: words one inserted, deleted or replaced letter apart, found by PartEnum signatures.

A word is a binary vector over (letter, how often it has come before): its letter multiset. One edit changes at most two
coordinates, so near words have a Hamming distance of at most two. The coordinates are dealt by hash into ``PARTS`` parts, one more
than can differ, so two near words agree on a whole part: that is the partition; a part's content is a signature, and every part is
enumerated. Since words made of few syllables share their letters with many others, a signature also carries the text around a
third of the word: the edit lies in one of three thirds and leaves the other two, counted from the start and from the end. Equal
signatures are joined and pairs verified by edit distance, which makes the result exact.

The largest near word, if ``factor`` times as frequent, is a word's form; forms are followed to the last by pointer doubling.

Edge cases: null and empty texts have no words; of equally frequent near words the first in code-point order is taken; rows without
an id count, but none of their letters is dropped; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import slices
from cadaspark.llm.words import latin_words
from cadaspark.sources.scratch import keep

PARTS, THIRDS = 3, 3
# Distinct words that a task counts before it hands them on; bounds memory only.
HELD = 400_000


def word_counts(docs: DataFrame, least_length: int, text: str = "text", key: str = "doc_id", drop_every: int | None = None) -> DataFrame:
    """(word, n) over all rows. With ``drop_every``, a word loses a letter in those documents where the CRC of id and word says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, 1):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(w for w in latin_words(t) if len(w) >= least_length)
                if drop_every is None or i is None:
                    seen.update(words)
                    continue
                start = zlib.crc32(b"%d:" % i)
                for w, n in words.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % drop_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    seen[w] += n
            if len(seen) > HELD:
                yield _counted(seen, least_length)
                seen = Counter()
        yield _counted(seen, least_length)

    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter, least_length: int) -> pa.RecordBatch:
    rows = [(w.decode("latin-1"), n) for w, n in seen.items() if len(w) >= least_length]
    words, n = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def signatures(word: str) -> list[int]:
    """64-bit hashes of the signatures of a word, both as the longer and as the shorter one of a pair."""
    parts = [0] * PARTS
    times: dict[str, int] = {}
    for letter in word:
        before = times.get(letter, 0)
        times[letter] = before + 1
        h = xxhash.xxh3_64_intdigest(f"{letter}{before}")
        parts[h % PARTS] ^= h
    out = []
    size = len(word)
    for shorter in (size, size - 1):
        cuts = [shorter * i // THIRDS for i in range(THIRDS + 1)]
        for third in range(THIRDS):
            around = f"{shorter}/{third}/{word[: cuts[third]]}/{word[size - (shorter - cuts[third + 1]) :]}"
            out += [xxhash.xxh3_64_intdigest(f"{around}/{p}/{content}") for p, content in enumerate(parts)]
    return [h - (1 << 63) for h in out]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair of near words once in each direction, from distinct (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                found = signatures(w)
                keys += found
                rows += [i] * len(found)
            source = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).take(source), batch.column(1).take(source)], ["key", "word", "n"]
            )

    signed = keep(words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint"), "signatures")
    a, b = signed.alias("a"), signed.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word"))
    pairs = a.join(b, met & (F.levenshtein("a.word", "b.word", 1) == 1)).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")
    )
    pairs = keep(pairs.distinct(), "near-words")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of (word, form); chains have no circles. Each round doubles the reach."""
    reached = keep(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(reached.join(ahead, "root", "left"), "forms")
        if moved.where("next is not null").limit(1).count() == 0:
            return reached
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))


def groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct (word, n)."""
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    told = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= factor * F.col("n")
    told = keep(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    done = told.join(roots(told.where("form is not null")), "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
