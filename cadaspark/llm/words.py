"""Words of texts as bytes: one table turns a text's bytes into lower-cased words and blanks, then a plain split finds the words."""

from __future__ import annotations


def word_table(kept: bytes) -> bytes:
    """A translation of all 256 bytes: ``kept`` stays, A-Z become a-z, anything else becomes a blank."""
    table = bytearray(b" " * 256)
    for b in kept:
        table[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return bytes(table)


LETTERS = bytes(range(ord("a"), ord("z") + 1))
# Digits, letters and everything outside ASCII, over UTF-8.
WIDE = word_table(LETTERS + b"0123456789" + bytes(range(0x80, 0x100)))
# Letters of the first 256 code points, over Latin-1.
LATIN = word_table(LETTERS + bytes(range(0xC0, 0x100)))


def wide_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and characters outside ASCII, A-Z in lower case, in UTF-8; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WIDE).split()


def latin_words(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, in Latin-1; none of a null text."""
    return (text or "").encode("latin-1", "replace").translate(LATIN).split()
