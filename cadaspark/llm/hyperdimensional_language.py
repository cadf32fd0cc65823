"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram binds three of them, each permuted (rotated) by its place; a text is
the bundle (sum) of its trigrams and a language the bundle of its training texts. A text gets the language whose prototype has the
largest cosine with it. Letters are lower-cased, anything between letters counts as one blank.

Prototypes are bundled from about ``SAMPLE`` texts of each language at most, taken by a hash of the id. The prototypes
(languages x dimensions) are the model and are sent along with the tasks.

Edge cases: a null text or one without a letter gives ``und`` and score 0; without training texts every text is ``und``; equal
cosines go to the language first in the alphabet; negative cosines count as 0; repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import int_lists, map_text, slices

DIMENSIONS = 1024
SEED = 20_011
SAMPLE = 2_000
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for anything else."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(table)
    return _TABLE[0]


class Encoder:
    """Text vectors; letter vectors are made when a letter is first met, each from its own seed."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.vectors: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.vectors[point] = 2 * bits - 1
        return self.vectors[point]

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """One row of ``dimensions`` per text; a text without letters has zeros."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        codes, owner = [], []
        for i, text in enumerate(texts):
            c = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            c = np.concatenate([[0], c, [0]])
            c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
            if len(c) > 2:
                codes.append(c)
                owner.append(i)
        if not owner:
            return out
        alphabet, compact = np.unique(np.concatenate(codes), return_inverse=True)
        size = len(alphabet)
        base = np.array([self.letter(int(a)) for a in alphabet])
        places = [np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]
        grams, at = [], 0
        for c in codes:
            k = compact[at : at + len(c)].astype(np.int64)
            at += len(c)
            grams.append((k[:-2] * size + k[1:-1]) * size + k[2:])
        flat = np.concatenate(grams)
        if size**3 <= 4_000_000:
            seen = np.zeros(size**3, dtype=bool)
            seen[flat] = True
            present = np.flatnonzero(seen)
            rank = np.zeros(size**3, dtype=np.int32)
            rank[present] = np.arange(len(present))
            flat = rank[flat]
        else:
            present, flat = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        step = 2048
        for low in range(0, len(present), step):  # in blocks of trigrams, so that the tables stay small
            block = present[low : low + step]
            bound = (places[0][block // size**2] * places[1][block // size % size] * places[2][block % size]).astype(np.float32)
            counts = np.zeros((len(owner), len(block)), dtype=np.float32)
            for row in range(len(owner)):
                mine = flat[starts[row] : starts[row + 1]] - low
                mine = mine[(mine >= 0) & (mine < len(block))]
                if len(mine):
                    counts[row] = np.bincount(mine, minlength=len(block))
            out[owner] += counts @ bound
        return out


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes, from rows where ``learn`` holds and ``lang`` is given."""
    usable = docs.where(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, dimensions))
    limits = F.create_map(
        *[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, sample / n) * (1 << 30)))]
    )
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < limits[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in slices(batches, 1):
            vectors = encoder.texts(batch.column(1).to_pylist())
            # each text counts alike, however long
            vectors = 1000 * vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            packed = np.round(v).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), int_lists([packed])], ["lang", "v"])

    parts = chosen.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, v array<int>")
    rows = (
        parts.select("lang", F.posexplode("v").alias("d", "x"))
        .groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v")).collect()
    )
    learned = {r["lang"]: np.array(r["v"], dtype=np.float64) for r in rows if any(r["v"])}
    names = sorted(learned)
    return names, np.array([learned[n] / np.linalg.norm(learned[n]) for n in names]).reshape(len(names), dimensions)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], text: str = "text",
    out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``carry`` columns, the predicted language and its score (the cosine), named by ``out``."""
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    dimensions = prototypes.shape[1]

    def build() -> Callable:
        encoder = Encoder(dimensions)

        def work(texts: list[str | None]) -> list[pa.Array]:
            vectors = encoder.texts(texts).astype(np.float64)
            length = np.linalg.norm(vectors, axis=1)
            if not names:
                return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts)))]
            cosine = vectors @ shared.value.T / np.where(length > 0, length, 1)[:, None]
            best = cosine.argmax(axis=1)
            found = length > 0
            score = np.where(found, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
            return [pa.array([names[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], pa.string()), pa.array(score)]

        return work

    return map_text(docs, text, carry, f"{out[0]} string, {out[1]} double", build)
