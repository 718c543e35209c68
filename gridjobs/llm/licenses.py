"""Licence notices in whole texts, by Dice coefficient over word bigrams (operator 9)."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm.tables import slices, table

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Dice coefficient from which a stretch of text is taken for a template's.
DICE = 0.8
AT_A_TIME = 100_000
#: Bigrams from which a template is a whole text, which goes before the notices inside it.
WHOLE = 100
# Notices that name a licence or open its text (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    # the opening alone does not tell which clauses follow
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "Licensed under the Eclipse Public License, Version 2.0."],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at", "Licensed under the Eclipse Public License, Version 1.0."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["Licensed under the zlib License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
}
# Whole texts, a file for each licence.
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text())


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """Bigrams of the templates by code, and which templates have each."""

    def __init__(self, texts: dict[str, list[str]], dice: float = DICE):
        self.dice = dice
        self.names, self.bigrams = [], []
        self.terms: dict[str, int] = {}
        for name, variants in texts.items():
            for v in variants:
                w = [self.terms.setdefault(x, len(self.terms)) for x in words(v)]
                if len(w) > 1:
                    self.names.append(name)
                    self.bigrams.append(Counter(zip(w, w[1:], strict=False)))
        self.n = len(self.terms)
        self.sizes = [sum(b.values()) for b in self.bigrams]
        self.least = np.array([size * dice / (2 - dice) for size in self.sizes])
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        for b in self.bigrams:
            code = np.array([x * self.n + y for x, y in b], np.int64)
            order = np.argsort(code)
            self.own.append((code[order], np.array(list(b.values()), np.int64)[order]))
        every = np.concatenate([c for c, _ in self.own] or [np.empty(0, np.int64)])
        of = np.repeat(np.arange(len(self.own)), [len(c) for c, _ in self.own])
        order = np.argsort(every, kind="stable")
        self.codes, first, n = np.unique(every[order], return_index=True, return_counts=True)
        self.having = (first, n, of[order])

    def stretches(self, t: int, at: np.ndarray, codes: np.ndarray) -> Iterator[tuple[float, int, int, int]]:
        """(dice, template, first word, last word + 1) of the best stretch from each of a template's bigrams in one text."""
        own, cap = self.own[t]
        k = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        mine = own[k] == codes
        at, k = at[mine], k[mine]
        size, d, least = self.sizes[t], self.dice, self.least[t]
        # a bigram adds to a stretch if the one that its template's count puts out of use lies before the stretch
        order = np.argsort(k, kind="stable")
        rank = np.arange(len(k)) - np.searchsorted(k[order], k[order])
        before = np.full(len(k), -1)
        far = np.nonzero(rank >= cap[k[order]])[0]
        before[order[far]] = order[far - cap[k[order[far]]]]
        low = np.searchsorted(at, at + least - 1 - 1e-9)
        end = np.searchsorted(at, at + size * (2 - d) / d - 1 + 1e-9, "right")
        place = np.arange(len(at))
        for i in np.nonzero((low < end) & (end - place >= least - 1e-9))[0].tolist():
            lo, hi = int(low[i]), int(end[i])
            common = np.cumsum(before[i:hi] < i)[lo - i :]
            x = 2 * common / (at[lo:hi] - at[i] + 1 + size)
            j = int(x.argmax())
            if x[j] >= d - 1e-9:
                yield float(x[j]), t, int(at[i]), int(at[lo + j]) + 2

    def match(self, near: list[int], at: np.ndarray, codes: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(dice, template, first word, last word + 1) of the best stretches of one text, none overlapping a better one; whole
        texts go before notices.

        ``near``: templates of which the text has bigrams enough; ``at``, ``codes``: where it has a template's bigram, and
        which. A template of n bigrams can reach the coefficient d only with stretches of n * d / (2 - d) to n * (2 - d) / d
        bigrams, of which as many as the first number are its own, so texts with fewer skip it and no longer stretch is tried.
        """
        found = [f for t in near for f in self.stretches(t, at, codes)]
        found.sort(key=lambda x: (self.sizes[x[1]] < WHOLE, -x[0], -self.sizes[x[1]], x[2], x[1]))
        taken: list[tuple[int, int, tuple[float, int, int, int]]] = []  # apart from each other, in order
        for f in found:
            at = bisect_left(taken, (f[3],))
            if not at or taken[at - 1][1] <= f[2]:
                insort(taken, (f[2], f[3], f))
        return [f for _, _, f in taken]

    def scan(self, texts: list[str]) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, dice, first word, last word + 1)."""
        out, at = [], 0
        while at < len(texts):
            first, split, total = at, [], 0
            while at < len(texts) and (not split or total < AT_A_TIME):
                split.append(words(texts[at]))
                total += len(split[-1])
                at += 1
            ids = np.array(list(map(self.terms.get, chain.from_iterable(split), repeat(-1))), np.int64)
            if len(ids) < 2:
                continue
            lengths = np.array([len(w) for w in split])
            ends = np.cumsum(lengths)
            code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.n + ids[1:], -1)
            code[ends[(ends > 0) & (ends < len(ids))] - 1] = -1
            hit = np.nonzero(code >= 0)[0]
            row = np.minimum(np.searchsorted(self.codes, code[hit]), len(self.codes) - 1)
            known = self.codes[row] == code[hit]
            hit, row = hit[known], row[known]
            doc = np.searchsorted(ends, hit, "right")
            begin, n, of = self.having
            n = n[row]
            at_of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[row], n)
            size = len(self.names)
            counts = np.bincount(np.repeat(doc, n) * size + of[at_of], minlength=len(split) * size).reshape(-1, size)
            near = counts >= self.least - 1e-9
            for d in np.nonzero(near.any(1))[0].tolist():
                own = hit[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                start = int(ends[d] - lengths[d])
                for x, t, a, b in self.match(np.nonzero(near[d])[0].tolist(), own - start, code[own]):
                    out.append((first + d, self.names[t], x, a, b))
        return out


def _found(templates: Templates, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = templates.scan([t or "" for t in batch.column("_text").to_pylist()])
            rows = pa.array([g[0] for g in got], pa.int64())
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            cols = [batch.column(c).take(rows) for c in columns] + [pa.array([g[k + 1] for g in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, "license", "dice", "first_word", "end_word"])

    return run


def license_notices(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), dice: float = DICE) -> DataFrame:
    """One row per licence notice: ``keep`` columns, license, dice, first_word, end_word (words counted from 0, end exclusive).

    Text is normalised to lower-case words; every stretch of words that begins and ends with a bigram of a template is
    compared, so notices inside long lines are found as well. Of overlapping notices the best stays. Null and empty texts
    hold none, repeated rows give repeated notices; an empty table gives an empty result. A very long text is one task's, whole, as words. Columns
    that are not kept are not read. One pass, no shuffle.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    t = Templates(templates or TEMPLATES, dice)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_found(t, list(keep)), f"{kinds}, license string, dice double, first_word long, end_word long")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
