import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadaspark.llm import packing, plans, sentencepiece_bpe

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(BYTES)
CODEC = sentencepiece_bpe.PieceCodec(open(PIECES, "rb").read())
BYTE_CODEC = packing.ByteCodec(open(BYTES, "rb").read())
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abthe.,'sÉ´梦🙂\x00\x85<>|0x"), st.characters(exclude_categories=["Cs"])), max_size=80)


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_as_the_library(text):
    expected = LIBRARY.encode(text)
    assert ids(CODEC.encode(text)) == expected
    assert CODEC.decode(expected) == LIBRARY.decode(expected)


def test_long_words_and_runs_of_blanks():
    rng = random.Random(3)
    texts = [" " * n for n in range(50)] + ["a" + " " * n + "b" for n in range(50)] + ["the" * 4000, "ab" * 3000]
    texts += ["".join(rng.choice("abcdef") for _ in range(2000)) for _ in range(20)]
    for text in texts:
        assert ids(CODEC.encode(text)) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bytes_as_the_library(text):
    assert ids(BYTE_CODEC.encode(text)) == TOKENIZER.encode(text, add_special_tokens=False).ids


def expected_digests(rows):
    for doc_id, text in rows:
        found = LIBRARY.encode(text or "")
        yield (
            doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(found).encode()).hexdigest(),
        )


def test_op1_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = plans.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter(expected_digests(rows))


def test_pieces_of_odd_rows(odd):
    got = sentencepiece_bpe.encode(odd, PIECES).collect()
    want = Counter((r.doc_id, tuple(LIBRARY.encode(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    again = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd, PIECES), PIECES)
    assert Counter(r.decoded for r in again.collect()) == Counter(r.decoded for r in got)
    assert sentencepiece_bpe.encode(odd.limit(0), PIECES).count() == 0


def check_pieces(rows, texts):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)  # every piece is a sequence of its own
    for doc_id, copies in texts.items():
        want = TOKENIZER.encode(copies[0] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(want) * len(copies)
        for r in pieces:
            part = np.array(want[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.doc_tokens == len(want) and r.offset == 0 and len(part) == 4 * r.length
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and 1 << r.bucket == r.length
            assert getattr(r, "ids_crc32", zlib.crc32(part)) == zlib.crc32(part)
        starts = Counter(r.start for r in pieces)
        assert set(starts.values()) == {len(copies)}


def test_op6_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check_pieces(plans.op6_packing(spark, "/root/testdata/sf0.001").collect(), {r.doc_id: [r.text] for r in rows})


def test_packing_of_odd_rows(odd, tmp_path):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    pieces = packing.pack(odd, BYTES)
    check_pieces(pieces.collect(), texts)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "buckets")).count() == pieces.count()
    assert packing.pack(odd.limit(0), BYTES).count() == 0


@given(st.integers(1, 5000))
def test_binary_cuts(n):
    cuts = packing.binary_cuts(n)
    assert sum(cuts) == n and cuts == sorted(cuts, reverse=True)
    rest = [c for c in cuts if c < 1024]
    assert len(set(rest)) == len(rest) and all(c & (c - 1) == 0 for c in cuts)
