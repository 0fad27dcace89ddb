"""License scans: MinHash over overlapping windows, then exact containment.

Texts are read as lower-case words of letters and digits. For each size class
of templates the shingles of a text are cut into overlapping windows, each four
steps long and a step after the one before, the first at the text's own start; a
template of at most three steps lies whole in one of them wherever it stands. Each of ``hashes`` min-hashes is
a band of its own: a window that shares one with a template is a candidate.

Steps run through 1, 2, 3, 4, 6, 8, 12, ..., so a template fills half of its
window at least. With a fifth of its shingles changed its Jaccard index with
the window is still 0.36, and it is missed with a probability of at most
``(1 - 0.36) ** 40 < 2e-8``. A template of one shingle has windows of one, which
all min-hashes find alike. Candidates are verified exactly: the share of the
template's shingles that the window holds must reach ``containment``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .jobs import map_rows, table
from .words import Ranges, batch, mix, starts

#: Notices and the leading or central sentences of common licenses, by SPDX name where there is one.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Scan:
    """Words in a shingle, min-hashes (a band each), and the least containment of a match."""

    shingle: int = 5
    hashes: int = 40
    containment: float = 0.8


@dataclass(frozen=True)
class Template:
    name: str
    words: int
    shingle: int
    tokens: np.ndarray  # its sorted distinct shingles
    least: np.ndarray  # its min-hashes


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return batch([(t or "").encode("utf-8", "surrogatepass").translate(_WORDS).decode("utf-8", "surrogatepass") for t in texts])


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prepared(templates: Mapping[str, tuple[str, ...]], how: Scan) -> list[Template]:
    """The templates as shingles; one of fewer words than a shingle is a single shorter one."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            words, bounds = _words([text])
            if n := int(bounds[-1]):
                k = min(how.shingle, n)
                at = starts(bounds, k)
                tokens = np.unique(Ranges(words).of(at, at + k))
                out.append(Template(name, n, k, tokens, np.array([hashed(tokens, s).min() for s in _seeds(how.hashes)])))
    return out


def _step(shingles: int) -> int:
    """The least step 2**i or 3 * 2**i of which three hold the shingles; 0 for a single one."""
    if shingles == 1:
        return 0
    step = 1
    while 3 * step < shingles:
        step = step * 2 if step == 1 else step * 3 // 2 if step & (step - 1) == 0 else step // 3 * 4
    return step


def hashed(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One min-hash order of shingles, whose hashes are mixed already."""
    return (tokens ^ seed) * (seed | np.uint64(1))


class Steps:
    """Windows of four steps over each text's own shingles; ``first[i]`` is where block i of a text begins."""

    def __init__(self, owner: np.ndarray, step: int):
        n = len(owner)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[: n or 0]
        self.step, end = step, np.append(start[1:], n)
        blocks = -(-(end - start) // step)
        text = np.repeat(np.arange(len(start)), blocks)
        self.first = start[text] + step * (np.arange(len(text)) - (np.cumsum(blocks) - blocks)[text])
        self.end = np.minimum(self.first + 4 * step, end[text])
        self._next, self._after = text[1:] == text[:-1], text[2:] == text[:-2]

    def least(self, values: np.ndarray) -> np.ndarray:
        """The minimum of each window; at the end of a text windows are shorter."""
        block = np.minimum.reduceat(values, self.first)
        pair = block.copy()
        np.minimum(block[:-1], block[1:], out=pair[:-1], where=self._next)
        window = pair.copy()
        np.minimum(pair[:-2], pair[2:], out=window[:-2], where=self._after)
        return window


def candidates(tokens: np.ndarray, owner: np.ndarray, templates: list[Template], seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """(template, first, end) of windows over the shingles that share a min-hash with a template.

    ``owner`` tells which text a shingle is of; a window is of one text.
    """
    found: set[tuple[int, int, int]] = set()
    if not len(tokens):
        return []
    classes: dict[int, list[int]] = {}
    for i, t in enumerate(templates):
        classes.setdefault(_step(len(t.tokens)), []).append(i)
    windows = {step: Steps(owner, step) for step in classes if step}
    for j, seed in enumerate(seeds):
        if j and not windows:
            break
        order = hashed(tokens, seed)
        for step, mine in classes.items():
            if not step and j:
                continue
            least = windows[step].least(order) if step else order
            values = np.array([templates[i].least[j] for i in mine])
            for w in np.flatnonzero(np.isin(least, values)):
                reach = (int(windows[step].first[w]), int(windows[step].end[w])) if step else (int(w), int(w) + 1)
                found |= {(i, *reach) for i, v in zip(mine, values, strict=True) if v == least[w]}
    return sorted(found)


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, how: Scan = Scan()) -> DataFrame:
    """A row for each document and license found in it.

    ``containment`` is that of the best match, ``start_word`` and ``end_word``
    its place (the first of the best), ``n_windows`` how many windows hold the
    license. Null and empty texts match nothing. A text may match several
    licenses. Repeated rows give repeated results. Other columns are not looked
    at. Templates are a fixed parameter; texts are not shuffled.
    """
    ready = prepared(templates, how)

    def work(piece: dict[str, list]) -> dict[str, list]:
        words, bounds = _words(piece["text"])
        best: dict[tuple[int, str], list] = {}
        for k in {t.shingle for t in ready}:
            mine = [t for t in ready if t.shingle == k]
            at = starts(bounds, k)
            tokens = Ranges(words).of(at, at + k)
            owner = np.searchsorted(bounds, at, side="right") - 1
            for i, first, end in candidates(tokens, owner, mine, _seeds(how.hashes)):
                t, doc = mine[i], int(owner[first])
                hit = first + np.flatnonzero(np.isin(tokens[first:end], t.tokens))
                share = len(np.unique(tokens[hit])) / len(t.tokens)
                if share >= how.containment:
                    row = best.setdefault((doc, t.name), [0.0, 0, 0, 0])
                    row[3] += 1
                    if share > row[0]:
                        row[:3] = [share, int(at[hit[0]] - bounds[doc]), int(at[hit[-1]] + k - bounds[doc])]
        keys = sorted(best)
        return {
            "doc_id": [piece["doc_id"][d] for d, _ in keys], "license": [name for _, name in keys], "containment": [best[x][0] for x in keys],
            "start_word": [best[x][1] for x in keys], "end_word": [best[x][2] for x in keys], "n_windows": [best[x][3] for x in keys],
        }

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, license string, containment double, start_word long, end_word long, n_windows long", 2_000_000)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document."""
    return scan(table(spark, sf_dir, "documents"))
