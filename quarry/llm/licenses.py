"""License scans by a positional rare-token index (operator 5).

The templates' words are indexed with their places. For each template whose key phrases a file holds
it looks up that template's words of the highest inverse document frequency (counted over all
documents): so many that one at least is in place wherever the template is. The places they point to
are tried one by one, and a template that is aligned often enough is confirmed by the key phrases it
must hold near that place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Label, words of a usual notice, key phrases that must stand in the aligned stretch.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

#: Share of a template's words that must align, and words by which places may be off.
ALIGNED, SLACK = 0.6, 2

_MEMBER = common.alnum_bytes()


class Index:
    """Postings by word hash, phrases as hashes, and the words that open the lookups."""

    def __init__(self, templates: list = TEMPLATES, base: list = BASE) -> None:
        code = lambda text: np.array([common.hash_word(w, _MEMBER) for w in text.split()], np.uint64)
        self.templates = [(label, code(text), [code(k) for k in keys]) for label, text, keys in templates]
        self.base = [(code(phrase), label) for phrase, label in base]
        self.vocabulary = np.unique(np.concatenate([t for _, t, _ in self.templates] + [p for p, _ in self.base]))
        self.numbers = [np.searchsorted(self.vocabulary, words) for _, words, _ in self.templates]
        self.idf = np.ones(len(self.vocabulary))

    def weigh(self, counts: dict[int, int], documents: int) -> None:
        """Sets inverse document frequencies from documents that hold each word of the vocabulary; above 0 even for a word of all documents."""
        n = np.array([counts.get(k, 0) for k in range(len(self.vocabulary))])
        self.idf = np.log((2 + documents) / (1 + n))

    def holders(self, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """For each template the rows (of n) that hold all its key phrases; it can be in no others."""
        out = np.ones((len(self.templates), n), bool)
        for held, (_, _, keys) in zip(out, self.templates, strict=True):
            for k in keys:
                at = starts(words, k)
                seen = np.zeros(n, bool)
                seen[row[at[row[at] == row[at + len(k) - 1]]]] = True
                held &= seen
        return out

    def find(self, words: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def shifts(self, template: int, number: np.ndarray) -> np.ndarray:
        """Every place of a file where the template may begin.

        If a share of ALIGNED of its words is in place, then of any set of words larger than the
        rest one is, within SLACK; the rarest such set is looked up.
        """
        own = self.numbers[template]
        rare = np.argsort(-self.idf[own], kind="stable")[: len(own) - int(np.ceil(ALIGNED * len(own) - 1e-9)) + 1]
        postings: dict[int, list[int]] = {}
        for place in rare.tolist():
            postings.setdefault(int(own[place]), []).append(place)
        found = [np.flatnonzero(number == kind)[:, None] - np.array(places) for kind, places in postings.items()]
        near = np.unique(np.concatenate([x.ravel() for x in found]))
        return np.unique(near[:, None] + np.arange(-SLACK, SLACK + 1))

    def match(self, words: np.ndarray, number: np.ndarray, held: np.ndarray) -> tuple[set[str], float]:
        """Labels of those of the held templates (numbers) that one file holds, and the largest share of aligned words among them."""
        labels, best = set(), 0.0
        for template in held.tolist():
            label, want, keys = self.templates[template]
            shift = self.shifts(template, number)
            # all key phrases must stand in the stretch; other places need no look
            for k in keys:
                at = starts(words, k)
                after = np.searchsorted(at, np.maximum(shift - SLACK, 0))
                inside = after < len(at)
                inside[inside] = at[after[inside]] + len(k) <= shift[inside] + len(want) + SLACK
                shift = shift[inside]
            for low in range(0, len(shift), 4096):
                at = shift[low : low + 4096, None] + np.arange(len(want))
                aligned = np.zeros(at.shape, bool)
                for slip in range(-SLACK, SLACK + 1):
                    there = at + slip
                    inside = (there >= 0) & (there < len(words))
                    aligned |= inside & (words[np.clip(there, 0, len(words) - 1)] == want)
                share = float(aligned.mean(1).max())
                if share >= ALIGNED:
                    labels.add(label)
                    best = max(best, share)
        return labels, best


def starts(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase stands in words."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def document_counts(docs: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """Documents that hold each licence word, over all rows, and rows. Each task returns one small row."""

    def run(batches):
        total, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for block in common.blocks(batches):
            words, row, _ = common.hashed_words(*common.raw(block.column(0)), _MEMBER)
            number = index.find(words)
            keys = np.unique(row[number >= 0] * len(index.vocabulary) + number[number >= 0])
            total += np.bincount(keys % len(index.vocabulary), minlength=len(total))
            rows += block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([rows, *total.tolist()], pa.int64())], names=["word", "n"])

    common.small_batches(docs.sparkSession)
    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in got}
    return counts, counts.pop(-1, 0)


def license_scan(docs: DataFrame, templates: list = TEMPLATES, base: list = BASE) -> DataFrame:
    """Scans every whole text.

    One row per row of docs: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, null without), base_labels, labels (base and found
    by templates; distinct, sorted, comma-joined, empty without), score (1 with a base phrase, else
    the largest share of a found template's words in place, else 0). A null or empty text has no
    words and no labels; repeated rows each get a row; other columns are left out.
    """
    index = Index(templates, base)
    index.weigh(*document_counts(docs, index))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        index, n = sent.value, block.num_rows
        words, row, _ = common.hashed_words(*common.raw(block.column(1)), _MEMBER)
        number = index.find(words)
        ends = np.searchsorted(row, np.arange(n), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        places: dict[int, list[int]] = {}
        marks: dict[int, set[str]] = {}
        for phrase, label in index.base:
            at = starts(words, phrase)
            at = at[row[at] == row[at + len(phrase) - 1]] if len(at) else at
            for r, p in zip(row[at].tolist(), (at - begins[row[at]]).tolist(), strict=True):
                places.setdefault(r, []).append(p)
                marks.setdefault(r, set()).add(label)
        found: dict[int, set[str]] = {r: set(x) for r, x in marks.items()}
        score = np.zeros(n)
        held = index.holders(words, row, n)
        for r in np.flatnonzero(held.any(0)).tolist():
            labels, share = index.match(words[begins[r] : ends[r]], number[begins[r] : ends[r]], np.flatnonzero(held[:, r]))
            if labels:
                found.setdefault(r, set()).update(labels)
                score[r] = share
        score[list(marks)] = 1.0
        text = lambda x: [",".join(sorted(x.get(r, ()))) for r in range(n)]
        at = [places.get(r) for r in range(n)]
        cols = [
            block.column(0), pa.array(ends - begins, pa.int64()), pa.array([len(x or ()) for x in at], pa.int64()),
            pa.array([min(x) if x else None for x in at], pa.int64()), pa.array([max(x) if x else None for x in at], pa.int64()),
            pa.array(text(marks), pa.string()), pa.array(text(found), pa.string()), pa.array(score, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return common.map_blocks(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
