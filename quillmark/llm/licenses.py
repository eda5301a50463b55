"""License scans: an exact set-similarity join of text blocks with license templates.

A **block** is a window of ``2 * STRIDE`` words that begins at a multiple of ``STRIDE``, so every passage of up to
``STRIDE`` words lies in one block. Blocks and templates are sets of words; a block meets a template when it holds at
least ``threshold`` of the template's words (containment). Words are ordered by the number of blocks of the whole corpus that
have them, rarest first, and this order is the same for all sets. A pair can meet ``need = ceil(threshold * size)`` only if

* its first common word lies in the first ``size - need + 1`` words of the template and ``block - need + 1`` of the block (prefix filter),
* the block has ``need`` words of templates (length filter),
* behind that word both have enough words left (positional filter);

pairs that pass are counted exactly. Words that no template has cannot meet and are left out of blocks before all this.
Phrases are templates with the threshold 1; where a block has all words of a phrase, its places in the text are sought word by word.

Templates are a parameter with a checked number and size; they and the order of their words go to all tasks. Counts of words
are summed on the executors by word, one row for each task and word of a template.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import lean
from quillmark.llm.words import pieces, texts

STRIDE = 128
THRESHOLD = 0.8
MAX_TEMPLATES = 2000

#: Phrases and the labels that their places give.
PHRASES: tuple[tuple[str, str], ...] = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Public license notices and their labels.
NOTICES: tuple[tuple[str, str], ...] = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("licensed under cc by 4 0", "cc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc"),
)


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    phrase: bool = False


def default_templates() -> list[Template]:
    return [Template(t, label, True) for t, label in PHRASES] + [Template(t, label) for t, label in NOTICES]


def blocks_of(n: int, stride: int = STRIDE) -> int:
    """Blocks of a text of n words."""
    return max(1, -(-n // stride) - 1) if n else 0


class Index:
    """Templates over word numbers. Numbers are ranks in the global order once ``count`` of each word is given."""

    def __init__(self, templates: list[Template], threshold: float, stride: int, count: dict[bytes, int] | None = None) -> None:
        lists = [t.text.encode().lower().split() for t in templates]
        if len(templates) > MAX_TEMPLATES or any(not words or len(words) > stride for words in lists):
            raise ValueError(f"at most {MAX_TEMPLATES} templates of 1 to {stride} words")
        count = count or {}
        order = sorted({w for words in lists for w in words}, key=lambda w: (count.get(w, 0), w))
        self.number = {w: k for k, w in enumerate(order)}
        self.stride, self.templates = stride, templates
        self.phrases = [np.array([self.number[w] for w in words]) for words in lists]
        self.sets = [np.unique(p) for p in self.phrases]  # ascending numbers: the global order
        self.need = [len(s) if t.phrase else max(1, math.ceil(threshold * len(s) - 1e-9)) for s, t in zip(self.sets, templates, strict=True)]
        self.has = np.zeros((len(templates), len(order)), dtype=bool)
        self.prefix = np.full((len(templates), len(order)), -1, dtype=np.int16)  # a word's place in the template's prefix
        for t, (words, need) in enumerate(zip(self.sets, self.need, strict=True)):
            self.has[t, words] = True
            self.prefix[t, words[: len(words) - need + 1]] = np.arange(len(words) - need + 1)
        self.starts = (self.prefix >= 0).any(axis=0) if templates else np.zeros(len(order), dtype=bool)

    def hits(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, and position and number of those that templates have."""
        get, n, at, numbers = self.number.get, 0, [], []
        for words in pieces(text):
            found = np.array([get(w, -1) for w in words], dtype=np.int32)
            here = np.flatnonzero(found >= 0)
            at.append(here + n)
            numbers.append(found[here])
            n += len(words)
        return n, np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*numbers, np.zeros(0, np.int32)]).astype(np.int64)

    def cells(self, n: int, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Distinct block * words + number of a text, ascending."""
        size, cell = len(self.number), at // self.stride
        last = blocks_of(n, self.stride) - 1
        both = np.concatenate([np.minimum(cell, last), np.maximum(cell - 1, 0)])
        return np.unique(both * size + np.tile(numbers, 2))

    def pairs(self, cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, block, common words) of all pairs that meet."""
        size = len(self.number)
        block, number = cells // size, cells % size
        if not self.starts[number].any():
            return
        first = np.searchsorted(cells, block * size)
        place = np.arange(len(cells)) - first  # in the block's order
        length = np.searchsorted(cells, (block + 1) * size) - first
        for t in np.flatnonzero((self.prefix[:, np.unique(number)] >= 0).any(axis=1)).tolist():
            words, need, i = self.sets[t], self.need[t], self.prefix[t, number]
            rows = np.flatnonzero((i >= 0) & (place <= length - need))
            rows = rows[np.unique(block[rows], return_index=True)[1]]  # the first common word of each block
            left = 1 + np.minimum(len(words) - 1 - i[rows], length[rows] - 1 - place[rows])
            for r in rows[left >= need].tolist():
                common = int(self.has[t, number[first[r] : first[r] + length[r]]].sum())
                if common >= need:
                    yield t, int(block[r]), common

    def places(self, t: int, begin: int, end: int, at: np.ndarray, numbers: np.ndarray) -> list[int]:
        """Where the words of template t stand one behind the other, with the first in [begin, end)."""
        phrase = self.phrases[t]
        a, b = np.searchsorted(at, begin), np.searchsorted(at, end)
        rows = np.flatnonzero(numbers[a:b] == phrase[0]) + a
        for k in range(1, len(phrase)):
            rows = rows[rows + k < len(at)]
            rows = rows[(at[rows + k] == at[rows] + k) & (numbers[rows + k] == phrase[k])]
        return at[rows].tolist()


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_FOUND = pa.schema([("n_words", pa.int64()), ("blocks", pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))), ("places", pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64())])))])
_FOUND_DDL = "n_words long, blocks array<struct<template int, label string, first_word long, end_word long, containment double>>, places array<struct<template int, label string, first_word long>>"


def frequencies(docs: DataFrame, index: Index, text: str = "text") -> dict[bytes, int]:
    """For each word that templates have, the number of blocks of the corpus with it; at most one number a word reaches the driver."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.number), dtype=np.int64)
        for batch in batches:
            for value in texts(batch.column(0)):
                total += np.bincount(index.cells(*index.hits(value)) % len(total), minlength=len(total))
        words = [w for w in index.number if total[index.number[w]]]
        yield pa.RecordBatch.from_pydict({"word": words, "n": [int(total[index.number[w]]) for w in words]}, schema=_COUNTS)

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] | None = None, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """key, n_words, blocks (template, label, first and end word, containment), places (template, label, first word) of each row.

    A null or empty text has no words and no blocks; rows that repeat, or have a null key, are scanned one by one; texts are
    scanned whole, in pieces. Other columns are not read, so their names cannot clash. An empty table gives an empty one.
    Blocks and places are ordered by template, then position.
    """
    templates = default_templates() if templates is None else templates
    rough = Index(templates, threshold, stride)
    index = Index(templates, threshold, stride, frequencies(docs, rough, text))
    kind = docs.schema[key].dataType

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in texts(batch.column(1)):
                n, at, numbers = index.hits(value)
                blocks, places = [], set()
                for t, block, common in index.pairs(index.cells(n, at, numbers)) if len(at) else ():
                    template, begin = templates[t], block * stride
                    end = min(n, begin + 2 * stride)
                    if template.phrase:
                        found = index.places(t, begin, end, at, numbers)
                        places.update((t, p) for p in found)
                        if not found:
                            continue
                    blocks.append({"template": t, "label": template.label, "first_word": begin, "end_word": end, "containment": common / len(index.sets[t])})
                rows.append({"n_words": n, "blocks": blocks, "places": [{"template": t, "label": templates[t].label, "first_word": p} for t, p in sorted(places)]})
            found = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["key", *found.schema.names])

    read = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = read.mapInArrow(run, f"key {kind.simpleString()}, {_FOUND_DDL}")
    return found.select(F.col("key").alias(key), "n_words", "blocks", "places")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned rows; score is the largest containment, without a block 0."""
    joined = lambda *labels: F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")
    base = F.col("places.label")
    return found.select(
        key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        joined(base).alias("base_labels"), joined(base, F.col("blocks.label")).alias("labels"), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )


def oracle(templates: list[Template] | None = None, threshold: float = THRESHOLD, stride: int = STRIDE) -> str:
    """The digest in SQL: every block against every template by counting, places by comparing words."""
    templates = default_templates() if templates is None else templates
    rows = ", ".join(f"({k}, '{t.label}', '{t.text}', {'true' if t.phrase else 'false'})" for k, t in enumerate(templates))
    return rf"""
WITH template(t, label, text, phrase) AS (VALUES {rows}
), tword AS (
  SELECT DISTINCT t, unnest(string_split(text, ' ')) AS word FROM template
), need AS (
  SELECT t, count(*) AS size, CASE WHEN any_value(phrase) THEN count(*) ELSE greatest(1, ceil({threshold} * count(*) - 1e-9)) END AS need FROM tword JOIN template USING (t) GROUP BY t
), d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), word AS (
  SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), cell AS (
  SELECT DISTINCT r, word, unnest([least(p // {stride}, greatest(1, (n + {stride - 1}) // {stride} - 1) - 1), greatest(p // {stride} - 1, 0)]) AS block FROM word WHERE word IN (SELECT word FROM tword)
), met AS (
  SELECT r, block, t, count(*) / any_value(size) AS containment FROM cell JOIN tword USING (word) JOIN need USING (t) GROUP BY r, block, t HAVING count(*) >= any_value(need)
), place AS (
  SELECT DISTINCT d.r, template.t, label, p FROM word JOIN d USING (r) JOIN template ON phrase AND word.word = string_split(template.text, ' ')[1] AND w[p + 1 : p + len(string_split(template.text, ' '))] = string_split(template.text, ' ')
), base AS (
  SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r
), said AS (
  SELECT r, label, containment FROM met JOIN template USING (t) WHERE NOT phrase UNION ALL SELECT r, label, 1.0 FROM place
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM said GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""
