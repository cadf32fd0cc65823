"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Method: every prefix of a word has exactly one last token in its merged form. An automaton lists the pieces that end at a
position; the last token is the one that starts at the word's beginning or whose left neighbour (the last token of the prefix
before it) would stay apart from it when the two are merged alone. Ids are read backwards from the table of last tokens.

White space runs are pieces of equal score, for which the order of merging depends on the position, so they are merged by the
rule itself. Characters outside the vocabulary become byte pieces. Nothing crosses a boundary between a word and the blank
before the next one, so words are encoded once and remembered (a bounded memory that only saves time).

Edge cases: a null or empty text has no ids and decodes to an empty text; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cadaspark.llm.arrow import int_lists, map_text

BLANK = "▁"
REMEMBERED = 400_000
COARSE = re.compile(" *[^ \n]+| +|\n")
# Letters apart from the rest; used when no piece of the model joins the two.
FINE = re.compile(r" *[^\W\d_²]+| *(?:[^ \n\w]|[\d_²])+| +|\n")
LETTER = re.compile(r"[^\W\d_²]")


class PieceCodec:
    """Pieces, scores and the prefix-table encoder of one model file."""

    def __init__(self, model: bytes) -> None:
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif reader.is_control(i):
                self.surface.append(b"")
            elif reader.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = reader.get_score(i)
                self.surface.append(piece.replace(BLANK, " ").encode())
        self._words: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        halves: dict[str, tuple[str, str]] = {}
        for piece in self.ids:
            blanks_only = not piece.strip(BLANK) and len(piece) > 1
            last: list[str] = []
            if not blanks_only and self.merge(piece, last) == [piece]:
                halves[piece] = (last[0], last[1]) if last else ("", "")
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.right_edge = {p: self._edge(p, halves, 1) for p in halves}
        self.left_edge = {p: self._edge(p, halves, 0) for p in halves}
        self.reachable = set(halves)
        kinds = [[bool(LETTER.match(c)) for c in p.lstrip(BLANK)] for p in self.ids]
        self.words = COARSE if any(len(set(k)) > 1 for k in kinds) else FINE

    def _edge(self, piece: str, halves: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float]]:
        """The symbols at one end of a piece while it is made, shortest first, each with the turn at which it is merged."""
        chain = [piece]
        while halves[chain[-1]][side]:
            chain.append(halves[chain[-1]][side])
        chain.reverse()
        turns = [-self.scores[p] for p in chain[1:]] + [float("inf")]
        return list(zip(chain, turns, strict=True))

    def merge(self, symbols: str, last: list[str] | None = None) -> list[str]:
        """The merging rule itself: best score first, leftmost on ties; ``last`` gets the halves of the final merge."""
        parts: list[str | None] = list(symbols)
        left = list(range(-1, len(parts) - 1))
        right = list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                joined = parts[a] + parts[b]
                score = self.scores.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            if last is not None:
                last[:] = parts[a], parts[b]
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def stay_apart(self, first: str, second: str) -> bool:
        """Whether two tokens remain two tokens when they stand alone side by side.

        Walks in time: a merge across the seam happens if the symbols at the seam are there together when its turn comes.
        """
        ends, starts, scores = self.right_edge[first], self.left_edge[second], self.scores
        i = j = 0
        while True:
            end, end_turn = ends[i]
            start, start_turn = starts[j]
            score = scores.get(end + start)
            if score is not None and -score < end_turn and -score <= start_turn:
                return False
            if end_turn <= start_turn:
                if end_turn == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def tokens(self, word: str) -> list[str] | None:
        """Tokens of a word by the table of last tokens; None if a character is outside the vocabulary."""
        last: list[str | None] = [None] * len(word)
        for end, piece in self.automaton.iter(word):
            if last[end] is None:
                start = end - len(piece) + 1
                if start == 0 or (last[start - 1] is not None and self.stay_apart(last[start - 1], piece)):
                    last[end] = piece
        out: list[str] = []
        at = len(word) - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                return None
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def _word(self, word: str) -> bytes:
        text = word.replace(" ", BLANK)
        body = text.lstrip(BLANK)
        run = len(text) - len(body)
        # the last blank can join the word; the blanks before it only join each other
        joined = (BLANK if run else "") + body
        pieces = self.tokens(joined)
        if pieces is None:  # characters outside the vocabulary stand alone and join nothing
            pieces = []
            for inside, part in itertools.groupby(joined, self.reachable.__contains__):
                pieces += self.tokens("".join(part)) if inside else part
        if run > 1:
            free = pieces[:1] == [BLANK]
            pieces = self.merge(BLANK * (run if free else run - 1)) + pieces[free:]
        ids: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            ids += [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed as little-endian 32-bit integers."""
        if not text:
            return b""
        words, out = self._words, []
        for word in self.words.findall(" " + text.replace(BLANK, " ")):
            packed = words.get(word)
            if packed is None:
                packed = self._word(word)
                if len(word) <= 64:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[word] = packed
            out.append(packed)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", errors="replace")


_CODECS: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per Python worker and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode(df: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, ``ids`` array<int> and ``decoded`` string of every text.

    The model file (half a megabyte) is read here and sent along with the tasks.
    """
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def build() -> Callable:
        pieces = codec(shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            packed = [pieces.encode(t) for t in texts]
            decoded = [pieces.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in packed]
            return [int_lists(packed), pa.array(decoded, pa.string())]

        return work

    return map_text(df, text, carry or ["doc_id"], "ids array<int>, decoded string", build)


def decode(df: DataFrame, model_path: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and the ``decoded`` text of arrays of ids (null: empty)."""
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = carry or ["doc_id"]
    narrow = df.select(*keep, df[ids].cast("array<int>").alias("__ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches):
        pieces = codec(shared.value)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "decoded"])

    return narrow.mapInArrow(run, f"{kept}, decoded string")
