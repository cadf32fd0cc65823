"""License scan: winnowed fingerprints pick candidate places, banded alignment measures them.

Templates are short notices, file headers, opening paragraphs and whole texts. A template is a list of words. Hashes of ``GRAM`` consecutive words are winnowed (the least of every ``WINDOW`` neighbours is kept)
into an inverted index from fingerprint to (template, place); templates of up to ``SHORT`` words keep all. A text is looked up at every place, so any ``GRAM + WINDOW - 1`` words in
common are found. Hits of a template on nearby diagonals make a candidate, which is aligned word by word inside a band around its
diagonals. Matches that cover at least ``COVERAGE`` of the template are reported with their span; each occurrence has a row, and
where matches overlap the one with most matched words is reported.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case for A-Z.

Edge cases: a null or empty text gives no row; a template that occurs twice gives two rows; repeated rows are scanned each for itself; an empty template list gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm.arrow import fresh, slices

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.85
SHORT = 16

# Public licence notices and file headers.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version.",
    "LGPL-notice": "This library is licensed under the GNU Lesser General Public License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
    "version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
    "any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def _notices() -> dict[str, str]:
    """What short notices say after any opening; in lower case, as words are compared."""
    out = {"Apache-2.0": "apache license version 2.0", "EPL-2.0": "eclipse public license 2.0", "Unlicense": "unlicense"}
    out |= {name: f"{name.lower()} license" for name in ("MIT", "ISC")}
    out |= {f"BSD-{n}-Clause": f"bsd {n} clause license" for n in (2, 3)}
    out["MPL-2.0"] = "mozilla public license version 2.0"
    named = {f"{name}-under": f"under the {text}" for name, text in out.items()}
    for short, word in (("GPL", ""), ("LGPL", "lesser "), ("AGPL", "affero ")):
        for version in ("2.0", "2.1", "3.0"):
            text = f"licensed under the gnu {word}general public license version {version.removesuffix('.0')}"
            named |= {f"{short}-{version}-under": text.removeprefix("licensed "), f"{short}-{version}-work": f"this work is {text}"}
    for terms in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            named[f"CC-{terms}-{version}-under"] = f"under cc {terms.lower()} {version}"
            named[f"CC-{terms}-{version}-licensed"] = f"licensed under cc {terms.lower()} {version}"
    del named["GPL-3.0-work"], named["CC-BY-4.0-licensed"], named["CC-BY-SA-4.0-licensed"], named["CC-BY-NC-4.0-licensed"]  # above
    return named


TEMPLATES |= _notices()
# Whole texts, without the lines that name the holder; those of the GNU family up to the end of their terms.
TEMPLATES |= {
    f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8")
    for f in sorted(files("cadaspark.llm").joinpath("licenses").iterdir(), key=lambda f: f.name)
    if f.name.endswith(".txt")
}

WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the kept hashes: in every window the least one, the last of equals."""
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda i: (hashes[i], -i))] if hashes else []
    kept = {
        min(range(s, s + window), key=lambda i: (hashes[i], -i)) for s in range(len(hashes) - window + 1)
    }
    return sorted(kept)


class Index:
    """Fingerprints of all templates; words are numbered, any other word is 0."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: words_of(text) for name, text in templates.items()}
        vocabulary = sorted({w for ws in self.words.values() for w in ws})
        self.code = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.base = len(vocabulary) + 1
        self.postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.codes = {name: [self.code[w] for w in ws] for name, ws in self.words.items()}
        for name, codes in self.codes.items():
            grams = self.grams(np.array(codes, dtype=np.int64)).tolist()
            # the order of winnowing must not follow the alphabet
            mixed = [g * 0x9E3779B97F4A7C15 % (1 << 64) for g in grams]
            # a short notice keeps all: an inserted word would cut the only hash that winnowing leaves
            for at in winnow(mixed) if len(codes) > SHORT else range(len(grams)):
                self.postings[grams[at]].append((name, at))
        self.known = np.array(sorted(self.postings), dtype=np.int64)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) < GRAM:
            return np.zeros(0, dtype=np.int64)
        out = np.zeros(len(codes) - GRAM + 1, dtype=np.int64)
        for i in range(GRAM):
            out = out * self.base + codes[i : len(codes) - GRAM + 1 + i]
        return out

    def candidates(self, codes: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(template, least and greatest diagonal, first word) of hits that lie together."""
        grams = self.grams(codes)
        hits = np.flatnonzero(np.isin(grams, self.known)) if len(grams) and len(self.known) else []
        by_template: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at in hits:
            for name, place in self.postings[int(grams[at])]:
                by_template[name].append((int(at), int(at) - place))
        out = []
        for name, found in by_template.items():
            size = len(self.codes[name])
            groups: list[list[tuple[int, int]]] = []
            latest: dict[int, int] = {}  # the last group that began in a band of diagonals; an earlier one there has ended
            for at, diagonal in found:  # in order of places
                band = diagonal // BAND
                near = [latest[b] for b in (band - 1, band, band + 1) if b in latest]
                near = [g for g in near if abs(groups[g][0][1] - diagonal) <= BAND and at - groups[g][0][0] <= size + BAND]
                if near:
                    groups[max(near)].append((at, diagonal))
                else:
                    latest[band] = len(groups)
                    groups.append([(at, diagonal)])
            out += [(name, min(d for _, d in g), max(d for _, d in g), g[0][0]) for g in groups]
        return out


def reachable(template: list[int], text: np.ndarray, low: int, high: int) -> int:
    """How many template words occur at all in their part of the band: ``align`` never matches more."""
    start = low - BAND
    width = high - low + 2 * BAND + 1
    size = len(template)
    inside = max(0, min(len(text), start + size + width) - max(0, start))
    if inside < COVERAGE * size:
        return inside
    at = start + np.arange(size)[:, None] + np.arange(width)
    same = text[np.clip(at, 0, len(text) - 1)] == np.array(template)[:, None]
    return int((same & (at >= 0) & (at < len(text))).any(axis=1).sum())


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Most words matched in order inside the band of diagonals low - BAND .. high + BAND: count, first and last word matched."""
    first = low - BAND
    width = high - low + 2 * BAND + 1
    none = (0, 0, 0)  # matched, -first word, last word; ties prefer later starts and earlier ends
    before = [none] * (width + 1)
    for i, word in enumerate(template):
        now = [none] * (width + 1)
        for d in range(width):
            j = i + first + d
            best = before[d + 1] if d + 1 < width else none  # skip a template word
            if d and _better(now[d - 1], best):  # skip a text word
                best = now[d - 1]
            if 0 <= j < len(text) and text[j] == word:
                count, start, _ = before[d]
                matched = (count + 1, start if count else j, j)
                if _better(matched, best):
                    best = matched
            now[d] = best
        before = now
    best = none
    for cell in before[:width]:
        if _better(cell, best):
            best = cell
    return best


def _better(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """More matches, then the shorter span, then the earlier one."""
    return (a[0], a[1] - a[2], -a[1]) > (b[0], b[1] - b[2], -b[1])


def matches(index: Index, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
    """(license, matched words, template words, coverage, start, end) with character offsets, in order of place."""
    words = words_of(text or "")
    codes = np.array([index.code.get(w, 0) for w in words], dtype=np.int64)
    kept: list[tuple[str, int, int, int, int]] = []
    while found := index.candidates(codes):
        text_codes, out = codes.tolist(), []
        for name, low, high, _ in found:
            template = index.codes[name]
            if reachable(template, codes, low, high) < COVERAGE * len(template):
                continue
            count, start, end = align(template, text_codes, low, high)
            if count >= COVERAGE * len(template):
                out.append((name, count, len(template), start, end))
        # of overlapping matches the one with most matched words stays
        out.sort(key=lambda r: (-r[1], -r[1] / r[2], r[3], r[0]))
        new: list[tuple[str, int, int, int, int]] = []
        for r in out:
            if not any(r[3] <= k[4] and k[3] <= r[4] for k in [*kept, *new]):
                new.append(r)
        if not new:
            break
        kept += new
        for r in new:  # what is taken hides no other occurrence in the next look
            codes[r[3] : r[4] + 1] = 0
    spans = [m.span() for m in WORD.finditer(text)] if kept else []
    rows = [(n, c, size, c / size, spans[s][0], spans[e][1]) for n, c, size, s, e in kept]
    return sorted(rows, key=lambda r: (r[4], r[5], r[0]))


def scan(df: DataFrame, templates: dict[str, str], carry: list[str], text: str = "text") -> DataFrame:
    """One row per occurrence: ``carry`` columns, license, matched_words, template_words, coverage, start, end (characters)."""
    narrow = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(fresh(df, "text_to_scan")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    last = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in slices(batches, last):
            rows, found = [], []
            for i, body in enumerate(batch.column(last).to_pylist()):
                for m in matches(index, body):
                    rows.append(i)
                    found.append(m)
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in range(last)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                [*carry, "license", "matched_words", "template_words", "coverage", "start", "end"],
            )

    schema = "license string, matched_words bigint, template_words bigint, coverage double, start bigint, `end` bigint"
    return narrow.mapInArrow(run, f"{kept}, {schema}" if kept else schema)
