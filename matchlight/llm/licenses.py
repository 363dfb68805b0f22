"""License scans by conditional compression.

A candidate block is compressed on its own and with each license template as the raw dictionary of
zstandard. A template that the block was made from explains it, so its size drops. Templates are
ranked by that drop; the best ones are confirmed by their exact differences in wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.llm.text import prepare

# Wording of notices and of license texts.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 3",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License version 2"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released under CC0 1.0", "Dedicated to the public domain under the CC0 1.0 Universal dedication"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
}
CUE = re.compile(
    r"licen[sc]|copyright|redistribut|permission|public domain|warrant|\b(?:mit|bsd|gpl|lgpl|agpl|mpl|isc)\b|apache|mozilla|\bcc0?\b|creative commons",
    re.IGNORECASE,
)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
APART = 4  # lines without a cue that a block may hold between lines with one
WINDOW, STEP = 600, 300  # words of a window of a long block
GAIN = 0.4  # least share of the template that must be explained
COVERED = 0.7  # least share of the template's words that must be there, in order


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def blocks(text: str) -> Iterator[tuple[int, str, bool]]:
    """(first line, words, long) of candidates: every line with a cue, and groups of such lines."""
    lines = text.split("\n")
    cued = [i for i, line in enumerate(lines) if CUE.search(line)]
    group: list[int] = []
    for i in [*cued, None]:
        if i is not None and (not group or i - group[-1] <= APART + 1):
            group.append(i)
            continue
        if group:
            yield group[0], "\n".join(lines[group[0] : group[-1] + 1]), True
        group = [i] if i is not None else []
    for i in cued:
        yield i, lines[i], False


def _windows(words: list[str]) -> Iterator[list[str]]:
    yield words[:WINDOW]
    for start in range(STEP, max(STEP, len(words) - STEP), STEP):
        yield words[start : start + WINDOW]


class Scanner:
    """The templates with a compressor each."""

    def __init__(self, level: int = 3):
        import zstandard

        def compressor(data: bytes | None = None):
            given = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None
            return zstandard.ZstdCompressor(level=level, dict_data=given, write_content_size=False, write_checksum=False)

        self.plain = compressor()
        self.templates = []
        for kind, table in ((False, NOTICES), (True, TEXTS)):
            for name, wordings in table.items():
                for wording in wordings:
                    words = words_of(wording)
                    data = " ".join(words).encode()
                    self.templates.append((kind, name, words, compressor(data), len(self.plain.compress(data))))

    def confirmed(self, words: list[str], long: bool) -> list[tuple]:
        """(license, gain, covered, missing, extra) of every template that has words of its own in a block.

        The template with the fewest wording differences takes the words it matches; the others are
        compared with what is left, until none is confirmed. Ties go to the longer template, then the first name.
        """
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        ranked = []
        for kind, name, template, compressor, size in self.templates:
            if kind == long:
                gain = (alone - len(compressor.compress(data))) / size
                if gain >= GAIN:
                    ranked.append((-gain, name, template))
        ranked.sort()
        words, out = list(words), []
        while ranked:
            found = None
            for gain, name, template in ranked:
                matcher = SequenceMatcher(None, template, words, autojunk=False)
                parts = [m for m in matcher.get_matching_blocks() if m.size]
                common = sum(m.size for m in parts)
                covered = common / len(template)
                if covered >= COVERED:
                    extra = parts[-1].b + parts[-1].size - parts[0].b - common
                    missing = len(template) - common
                    # The exact wording decides among those that compression puts forward.
                    rank = (missing + extra, -len(template))
                    if found is None or rank < found[0]:
                        found = rank, (name, -gain, covered, missing, extra), parts
            if found is None:
                break
            _, hit, parts = found
            out.append(hit)
            ranked = [r for r in ranked if r[1] != hit[0]]
            for m in parts:
                words[m.b : m.b + m.size] = [""] * m.size
        return out

    def scan(self, text: str | None) -> list[tuple]:
        """(line, license, gain, covered, missing, extra), one per line and license."""
        out: dict[tuple[int, str], tuple] = {}

        def keep(line: int, hit: tuple) -> None:
            key = (line, hit[0])
            if key not in out or hit[1:] > out[key][1:]:
                out[key] = hit

        single: dict[int, str] = {}
        for line, block, long in blocks(text or ""):
            if not long:
                single[line] = block
            for window in _windows(words_of(block)):
                for hit in self.confirmed(window, long) if window else []:
                    keep(line, hit)
        # A notice may be wrapped: a line with a cue and the one after it, for what neither has alone.
        lines = (text or "").split("\n") if single else []
        for line in single:
            for first in (line - 1, line):
                if 0 <= first < len(lines) - 1 and (first == line or first not in single):
                    for window in _windows(words_of(lines[first] + " " + lines[first + 1])):
                        for hit in self.confirmed(window, False) if window else []:
                            if (first, hit[0]) not in out and (first + 1, hit[0]) not in out:
                                keep(first, hit)
        return [(line, *hit) for (line, _), hit in sorted(out.items())]


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license, gain, covered, missing, extra): every license found, whole texts.

    ``missing`` and ``extra`` count words of the template that the text lacks and words between its
    first and last match that the template lacks; both 0 is the exact wording. NULL and
    empty texts have none. Equal rows give equal results. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["line", "license", "gain", "covered", "missing", "extra"]

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for texts in series:
            yield pd.Series([[dict(zip(names, hit)) for hit in scanner.scan(t)] for t in texts], dtype=object)

    hit = "array<struct<line:int,license:string,gain:double,covered:double,missing:int,extra:int>>"
    found = source.select("doc_id", F.pandas_udf(run, hit)(F.coalesce("text", F.lit(""))).alias("found"))
    return found.select("doc_id", F.explode("found").alias("hit")).select("doc_id", "hit.*")
