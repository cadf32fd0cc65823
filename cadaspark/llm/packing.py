"""Packing by powers of two: a document's ids are cut into pieces of binary length, each a sequence of its own.

A document of n ids gives as many full pieces as fit and then one piece for each binary digit of the rest, longest first.
Pieces of equal length form a bucket; batches are drawn from one bucket, so a batch holds no padding and no sequence crosses a
document. Ids come from a byte-level merge vocabulary; the end id closes every document.

Edge cases: a null or empty text has only the end id and makes one piece of length 1. Repeated rows are packed each for itself.
Sequence numbers are unique: bucket, input partition and a counter inside the partition share the bits of one long, so that
a task that runs again gives the same numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import slices

SEQUENCE = 1024
END_ID = 0
# Fixed value: the pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteCodec:
    """Ids of a byte-level vocabulary in the tokenizers JSON form; special tokens in a text count as such."""

    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special
        }
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _ids(self, text: str) -> list[int]:
        if text in self.special:
            return [self.special[text]]
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            ids = [i for part in self.cut.split(text) for i in self._ids(part)]
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


_CODECS: dict[int, ByteCodec] = {}


def codec(spec: bytes) -> ByteCodec:
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(spec)
    return _CODECS[key]


def binary_cuts(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full pieces, then the binary digits of the rest from the largest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", longest: int = SEQUENCE) -> DataFrame:
    """One row per piece: key, start, length, bucket (log2 of the length), sequence_id, offset, doc_tokens and the ids.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers. ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    narrow = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = narrow.schema[0].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(shared.value)
        partition = TaskContext.get().partitionId()
        made = 0
        for batch in slices(batches, 1):
            rows, starts, lengths, totals, ids = [], [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                packed = words.encode(body) + end
                total, start = len(packed) // 4, 0
                for length in binary_cuts(total, longest):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(total)
                    ids.append(packed[4 * start : 4 * (start + length)])
                    start += length
            length = np.array(lengths, dtype=np.int64)
            bucket = np.log2(length).astype(np.int64)
            number = (bucket << 57) + (partition << 36) + made + np.arange(len(rows), dtype=np.int64)
            made += len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(length),
                    pa.array(bucket.astype(np.int32)), pa.array(number), pa.array(np.zeros(len(rows), np.int64)),
                    pa.array(totals, pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["key", "start", "length", "bucket", "sequence_id", "offset", "doc_tokens", "ids_le"],
            )

    schema = (
        f"key {kind}, start bigint, length bigint, bucket int, sequence_id bigint, offset bigint, "
        "doc_tokens bigint, ids_le binary"
    )
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces in a folder per length, so that a reader draws batches of equal length without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
