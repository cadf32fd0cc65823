"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hash of ``GRAM`` consecutive words in every window of ``SPAN`` words (of equal ones the last).
Two texts that share ``SPAN`` words in a row choose the same one in them, so every such span is found. Fingerprints of the documents
that pass a filter of the benchmark's fingerprints are joined with these; each row carries the hashes of the words around it, as
far as a window of ``SPAN`` words can reach, so a hit is extended at once and kept if a whole window agrees. Items that are shorter than a window
are fingerprints of their own and must agree as a whole.

The filter is a bit array of fixed size and only saves rows: with a larger benchmark more of them pass, the result is the same.
The items' side of the join is repeated for each of ``SALTS`` shares of the documents, so a passage that many documents hold is
dealt to many tasks. Words are compared by 64-bit hashes.

Edge cases: null and empty texts have no words, hit nothing and are hit by nothing; rows that repeat a document id are judged
each for itself; items that share an id count once; an item without an id takes no part; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import slices
from cadaspark.llm.words import WIDE
from cadaspark.sources.scratch import keep

SPAN, GRAM = 10, 5
# Words on either side of a fingerprint that one window with it can hold, and all words that a row carries.
REACH = SPAN - GRAM
AROUND = SPAN + REACH
FILTER_BITS = 1 << 25  # 4 MB
SALTS = 16
REMEMBERED = 400_000
# Hashes that stand for "no word here"; the two never agree.
NO_WORD, NO_ITEM_WORD = np.uint64(0), np.uint64(1)
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Hashes(dict):
    """64-bit hash of a word, remembered; the marks between texts have none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = 0 if word == b"A" else max(xxhash.xxh3_64_intdigest(word), 2)
        return h


def word_hashes(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in a row with a 0 after each text, and the place of that 0."""
    # after lower-casing no word is a capital A
    joined = b" A ".join((t or "").encode("utf-8", "surrogatepass").translate(WIDE) for t in texts)
    words = (joined + b" A").split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    return h, np.flatnonzero(h == NO_WORD)


def grams(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive places and whether all of them hold words."""
    n = max(len(h) - width + 1, 0)
    out, whole = np.full(n, width, dtype=np.uint64), np.ones(n, dtype=bool)
    empty = h == NO_WORD
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : n + i]) * MIX[0]
            out ^= out >> np.uint64(29)
            whole &= ~empty[i : n + i]
        out *= MIX[1]
    return out ^ (out >> np.uint64(32)), whole


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of texts laid in a row by ``word_hashes``."""
    g, _ = grams(h, GRAM)
    steps = SPAN - GRAM + 1
    n = len(g) - steps + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least, at = g[:n].copy(), np.zeros(n, dtype=np.int64)
    for i in range(1, steps):
        later = g[i : n + i] <= least
        least[later] = g[i : n + i][later]
        at[later] = i
    words_missing = np.concatenate([[0], np.cumsum(h == NO_WORD)])
    whole = words_missing[SPAN : n + SPAN] == words_missing[:n]
    # chosen places never go back from window to window
    at = (at + np.arange(n))[whole]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, g[at]


def surroundings(h: np.ndarray, at: np.ndarray, missing: np.uint64) -> np.ndarray:
    """[fingerprint, AROUND] hashes from REACH words before the place on."""
    pad = np.full(AROUND, missing, dtype=np.uint64)
    padded = np.concatenate([pad, np.where(h == NO_WORD, missing, h), pad])
    return padded[(at + AROUND - REACH)[:, None] + np.arange(AROUND)]


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def item_fingerprints(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(gram, width, around, item): the fingerprints of all items; an item shorter than a window is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, 1):
            h, ends = word_hashes(batch.column(1).to_pylist(), known)
            starts = np.concatenate([[0], ends[:-1] + 1])
            at, gram = fingerprints(h)
            found = [(at, gram, np.full(len(at), GRAM))]
            for width in range(1, SPAN):
                short = starts[ends - starts == width]
                found.append((short, grams(h, width)[0][short], np.full(len(short), width)))
            at, gram, width = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(ends, at)
            # whether the row stands for a whole short item
            whole = (ends - starts)[owner] < SPAN
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(width.astype(np.int32)), pa.array(whole),
                 _packed(surroundings(h, at, NO_ITEM_WORD)), batch.column(0).take(pa.array(owner))],
                ["gram", "width", "whole", "around", "item"],
            )

    narrow = items.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "gram bigint, width int, whole boolean, around binary, item string").distinct()


def filter_of(prints: DataFrame) -> np.ndarray:
    """Bits of the fingerprints, as 64-bit words; of fixed size."""
    place = F.pmod("gram", F.lit(FILTER_BITS)).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    table = prints.select(F.shiftright(place, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint64)


def document_hits(docs: DataFrame, bits: np.ndarray, widths: list[int], text: str, key: str) -> DataFrame:
    """Per document: row, key, n_words and the fingerprints that pass the filter (gram, width, at, around)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def passed(gram: np.ndarray) -> np.ndarray:
        place = gram & np.uint64(FILTER_BITS - 1)
        return (shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in slices(batches, 1):
            h, ends = word_hashes(batch.column(1).to_pylist(), known)
            starts = np.concatenate([[0], ends[:-1] + 1])
            at, gram = fingerprints(h)
            met = passed(gram)
            found = [(at[met], gram[met], np.full(met.sum(), GRAM), np.zeros(met.sum(), dtype=bool))]
            for width in widths:
                gram, whole = grams(h, width)
                at = np.flatnonzero(whole & passed(gram))
                found.append((at, gram[at], np.full(len(at), width), np.ones(len(at), dtype=bool)))
            at, gram, width, whole = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(ends, at)
            order = np.argsort(owner, kind="stable")
            at, gram, width, whole, owner = at[order], gram[order], width[order], whole[order], owner[order]
            hits = pa.StructArray.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(width.astype(np.int32)), pa.array(whole),
                 pa.array(at - starts[owner]), _packed(surroundings(h, at, NO_WORD))],
                ["gram", "width", "whole", "at", "around"],
            )
            offsets = np.searchsorted(owner, np.arange(len(ends) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - starts), pa.ListArray.from_arrays(pa.array(offsets), hits)],
                ["id", "n_words", "hits"],
            )

    narrow = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    hits = "array<struct<gram:bigint,width:int,whole:boolean,at:bigint,around:binary>>"
    told = narrow.mapInArrow(run, f"id {id_type}, n_words bigint, hits {hits}")
    return keep(told.select(F.monotonically_increasing_id().alias("row"), "*"), "document-fingerprints")


def extended(met: DataFrame) -> DataFrame:
    """(row, start, stop, item) of the joined fingerprints whose surroundings agree over a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, AROUND) for c in ("mine", "theirs")
            )
            same = mine == theirs
            width, whole = batch.column("width").to_numpy(), batch.column("whole").to_numpy(zero_copy_only=False)
            inside = np.arange(AROUND) - REACH
            middle = (same | (inside < 0) | (inside >= width[:, None])).all(axis=1)
            before = np.cumprod(same[:, REACH - 1 :: -1], axis=1).sum(axis=1)
            after = np.cumprod(same[:, SPAN:], axis=1).sum(axis=1)
            before, after = np.where(whole, 0, before), np.where(whole, 0, after)
            fine = middle & (whole | (before + after >= REACH))
            at = batch.column("at").to_numpy()
            chosen = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(chosen), pa.array((at - before)[fine]), pa.array((at + width + after)[fine]),
                 batch.column("item").take(chosen)],
                ["row", "start", "stop", "item"],
            )

    return met.mapInArrow(run, "row bigint, start bigint, stop bigint, item string")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Documents (row, id, n_words) and spans (row, start, stop, item): words start to stop of a row lie inside the item's windows."""
    prints = keep(item_fingerprints(items, text, item_key), "item-fingerprints")
    widths = [r["width"] for r in prints.where("whole").select("width").distinct().collect()]  # less than SPAN rows
    told = document_hits(docs, filter_of(prints), sorted(widths), text, key)
    hits = told.select("row", F.explode("hits").alias("h")).select("row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), "h.*")
    salted = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = hits.withColumnRenamed("around", "mine").join(
        salted.withColumnRenamed("around", "theirs"), ["gram", "width", "whole", "salt"]
    )
    return told.select("row", "id", "n_words"), keep(extended(met), "leaked-spans")


def judge(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """key, n_words, n_hit (words inside hits) and ``items`` (ids of the items found, sorted) of every document."""
    told, spans = leaks(docs, items, text, key, item_key)
    places = spans.select("row", "start", "stop").distinct()
    places = places.select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).distinct()
    hit = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = spans.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    done = told.join(hit.join(named, "row"), "row", "left")
    return done.select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
