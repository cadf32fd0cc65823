"""Resampling of documents towards a target distribution, by hashed n-gram features.

A feature is a run of one to ``longest`` consecutive words; its bucket is the CRC of its bytes modulo ``buckets``. The features of all
documents and of all target texts are counted by bucket; a document's weight is the sum of its buckets' gains (log ratio of the
smoothed shares, in thousandths), and the documents with the highest weight plus Gumbel noise are drawn, which samples without
replacement in proportion to the weights' exponentials.

The vocabulary has a head and a tail. The head, the most frequent words and word pairs, is broadcast: a word with its exact CRC
state, from which longer features carry on, and a pair with its bucket. Words and pairs of the tail take the CRC directly. Both ways
give the same bucket, so the head only saves time; its size is a parameter and bounds what is broadcast. Bucket totals are exact over all rows,
summed inside each task before they are shuffled; the ranking is by ranges of the score, so no task sorts all documents.

Edge cases: a null or empty text has no features and weight 0; a null id has no noise, a null score and is never drawn, but its
text counts in the totals; equal scores go to the smaller id; repeated rows are ranked each for itself; empty tables give
empty results and empty targets gains from smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import fresh, map_text, slices
from cadaspark.llm.words import wide_words
from cadaspark.sources.scratch import keep

BUCKETS = 10_000
# Words and pairs in the head, and the most bytes of one of them: 65,536 x 64 bytes are broadcast at most.
HEAD, HEAD_BYTES = 32_768, 64


class States(dict):
    """CRC state of a word: looked up in the head, else computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Features:
    """Buckets of the features of word lists."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], longest: int = 1, buckets: int = BUCKETS) -> None:
        self.longest, self.buckets = longest, buckets
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = {(w, v): zlib.crc32(b" " + v, self.states[w]) % buckets for w, v in pairs}

    def of(self, words: list[bytes]) -> np.ndarray:
        """The bucket of every run of one to ``longest`` words, repeats included."""
        states = np.fromiter(map(self.states.__getitem__, words), dtype=np.int64, count=len(words))
        out = [states % self.buckets]
        if self.longest > 1 and len(words) > 1:
            known = list(map(self.pairs.get, zip(words, words[1:])))
            tail = zip(known, words[1:], states.tolist())
            out.append(np.array([b if b is not None else zlib.crc32(b" " + v, s) % self.buckets for b, v, s in tail]))
        runs = states.tolist()
        for n in range(2, self.longest + 1):
            runs = [zlib.crc32(b" " + v, s) for s, v in zip(runs, words[n - 1 :])]
            if n > 2:
                out.append(np.array(runs, dtype=np.int64) % self.buckets)
        return np.concatenate(out)


def _frequent(seen: Counter, most: int) -> Counter:
    return Counter(dict(seen.most_common(most)))


def head(docs: DataFrame, text: str, longest: int, size: int = HEAD) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The most frequent words and pairs of all rows; a task reports the ``size`` most frequent of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for batch in slices(batches, 0):
            for t in batch.column(0).to_pylist():
                found = wide_words(t)
                words.update(found)
                if longest > 1:
                    pairs.update(zip(found, found[1:]))
            for seen in (words, pairs):
                if len(seen) > 16 * size:  # rare ones go, so that a task's memory is bounded
                    kept = _frequent(seen, 4 * size)
                    seen.clear()
                    seen.update(kept)
        rows = [(w, None, n) for w, n in words.most_common(size)] + [(w, v, n) for (w, v), n in pairs.most_common(size)]
        rows = [r for r in rows if len(r[0]) + len(r[1] or b"") < HEAD_BYTES]
        if rows:
            w, v, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], ["word", "next", "n"]
            )

    told = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word binary, next binary, n bigint")
    summed = keep(told.groupBy("word", "next").agg(F.sum("n").alias("n")), "frequent-words")

    def top(rows: DataFrame) -> list:
        return rows.orderBy(F.desc("n"), "word", "next").limit(size).collect()  # at most ``size`` rows

    words = [bytes(r["word"]) for r in top(summed.where("next is null"))]
    pairs = [(bytes(r["word"]), bytes(r["next"])) for r in top(summed.where("next is not null"))] if longest > 1 else []
    return words, pairs


def totals(docs: DataFrame, text: str, features: Callable[[], Features], buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = features()
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 0):
            for t in batch.column(0).to_pylist():
                sums += np.bincount(made.of(wide_words(t)), minlength=buckets)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(sums[filled])], ["bucket", "n"])

    told = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in told.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one number a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in the target and the source, in thousandths, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    ratios = [(float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)) for a, b in zip(source, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS, size: int = HEAD) -> DataFrame:
    """All columns of ``docs``, then n_words, n_features and weight (longer names where ``docs`` has such columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(head(docs, text, longest, size))

    def features() -> Features:
        return Features(*shared.value, longest, buckets)

    told = gains(totals(docs, text, features, buckets), totals(target, text, features, buckets))

    def build() -> Callable:
        made = features()

        def work(texts: list[str | None]) -> list[pa.Array]:
            n_words, n_features, weight = [], [], []
            for t in texts:
                words = wide_words(t)
                found = made.of(words)
                n_words.append(len(words))
                n_features.append(len(found))
                weight.append(int(told[found].sum()))
            return [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]

        return work

    names = [fresh(docs, n) for n in ("n_words", "n_features", "weight")]
    return map_text(docs, text, docs.columns, ", ".join(f"`{n}` bigint" for n in names), build)


def draw(weighed: DataFrame, percent: int, least_words: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``score`` and ``rank`` of every row of (key, n_words, n_features, weight); the best ``percent`` of those long enough have a rank."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scored = weighed.withColumn("score", F.col("weight") + gumbel.cast("bigint"))
    scored = keep(scored.select("*", fit.alias("fit"), F.monotonically_increasing_id().alias("row")), "scored")
    order = [F.desc("score"), F.col(key), F.col("row")]
    placed = scored.where("fit").repartitionByRange(*order).sortWithinPartitions(*order)
    # the place of a row in its sorted range, counted from 0
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(placed.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "score-ranges")
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    most, before, starts = sum(n for _, n in counts) * percent // 100, 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    starts = weighed.sparkSession.createDataFrame(starts, "part int, before bigint")
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(starts, "part").withColumn("rank", F.when(rank <= most, rank))
    columns = [*weighed.columns, "score", "rank"]
    rest = scored.where("not fit").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*columns).union(rest.select(*columns))
