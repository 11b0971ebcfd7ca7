"""Licences of files: TF-IDF cosine to templates, then inheritance down the directories.

A statement is looked for in a whole text, across its lines. Every line, and
every window of the template's number of words, is a sparse vector of word
counts times inverse document frequency, where the frequencies of the
templates' words are counted over all documents and any other word counts as
never seen. A text that shares no strong word with a template can't reach the
least cosine and is skipped: the words are *strong* that must be among the
shared ones for the bound ``|shared part of template| / |template|`` to reach
it. The same bound, from running sums, skips windows.

A file without a statement of its own takes the licence of the nearest
directory above it that holds a licence file with one. Directories are joined
with their ancestors by path, once a directory, not once a file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import materialise, slices

# Usual statements of licences, as found in file headers, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
# The headers that the GNU licences recommend, and titles and opening words of licence files.
TEMPLATES += [
    ("GPL-2.0", _GNU.format(what="program", kind="General", v="2")),
    ("GPL-3.0", _GNU.format(what="program", kind="General", v="3")),
    ("LGPL-2.1", _GNU.format(what="library", kind="Lesser General", v="2.1")),
    ("LGPL-3.0", _GNU.format(what="library", kind="Lesser General", v="3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
]
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

LEAST = 0.8
#: Directories whose licences are broadcast: some 200 bytes each, 10 MB at most.
BROADCAST_DIRS = 50_000

_WORD = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Templates as weighted vectors, given the document frequencies of their words."""

    def __init__(self, df: dict[str, int], n_docs: int, templates: list[tuple[str, str]], least: float):
        self.least, self.df, self.n = least, df, n_docs
        self.unseen = self._idf(0)
        self.templates = []
        strong = set()
        for name, text in templates:
            counts = Counter(terms(text))
            vector = {t: c * self.idf(t) for t, c in counts.items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            # Weakest words first, for as long as all of them together stay short of the bound.
            weak = 0.0
            for t, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
                weak += v * v
                if math.sqrt(weak) / norm >= least:
                    strong.add(t)
            self.templates.append((name, vector, norm, sum(counts.values())))
        self.place = {t: i for i, t in enumerate(sorted({t for _, vector, _, _ in self.templates for t in vector}))}
        # Squared weight of each word in each template; the last column stands for any other word.
        self.squares = np.zeros((len(self.templates), len(self.place) + 1))
        for row, (_, vector, _, _) in zip(self.squares, self.templates):
            for t, v in vector.items():
                row[self.place[t]] = v * v
        self.quick = re.compile("|".join(re.escape(t) for t in sorted(strong))) if strong else None

    def _idf(self, df: int) -> float:
        return math.log((1 + self.n) / (1 + df)) + 1

    def idf(self, t: str) -> float:
        return self._idf(self.df[t]) if t in self.df else self.unseen

    def cosine(self, counts: Counter, vector: dict[str, float], norm: float) -> float:
        own = {t: c * self.idf(t) for t, c in counts.items()}
        dot = sum(w * vector[t] for t, w in own.items() if t in vector)
        return dot / norm / math.sqrt(sum(w * w for w in own.values())) if dot else 0.0

    def match(self, text: str | None) -> list[tuple[str, float]]:
        """(licence, best cosine) of the licences stated in a text, best first, equals by name."""
        best: dict[str, float] = {}
        low = (text or "").lower()
        if not self.quick or not self.quick.search(low):
            return []
        ts, ends = [], [0]
        for line in low.split("\n"):
            ts += _WORD.findall(line)
            ends.append(len(ts))
        other = len(self.place)
        known = np.fromiter((self.place.get(t, other) for t in ts), np.int64, len(ts))
        shared = self.squares @ (np.bincount(known, minlength=other + 1) > 0)
        lines = np.array(sorted(set(zip(ends, ends[1:]))), np.int64).reshape(-1, 2)
        for (name, vector, norm, size), squares, part in zip(self.templates, self.squares, shared):
            if part < (self.least * norm) ** 2 * (1 - 1e-9):
                continue
            # At least the squared norm of the template's part in each span.
            run = np.concatenate([[0.0], np.cumsum(squares[known])])
            enough = (self.least * norm) ** 2 * (1 - 1e-9) - 1e-9 * run[-1]
            spans = [tuple(x) for x in lines[run[lines[:, 1]] - run[lines[:, 0]] >= enough].tolist()]
            if len(ts) >= size:
                spans += [(p, p + size) for p in np.flatnonzero(run[size:] - run[:-size] >= enough).tolist()]
            else:
                spans.append((0, len(ts)))
            for a, b in dict.fromkeys(spans):
                c = self.cosine(Counter(ts[a:b]), vector, norm)
                if c >= self.least and c > best.get(name, 0.0):
                    best[name] = c
        return sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))


def term_frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """Over all texts: in how many each of the templates' words occurs, and the number of texts."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    place = {t: i for i, t in enumerate(vocabulary)}
    finder = re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(vocabulary, key=lambda t: (-len(t), t))) + r")(?![a-z0-9])")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(vocabulary), np.int64), 0
        for b in slices(batches):
            for text in b["text"].to_pylist():
                total += 1
                for t in set(finder.findall((text or "").lower())):
                    n[place[t]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1], pa.int32()), pa.array([*n.tolist(), total], pa.int64())], ["term", "n"])

    got = {r["term"]: r["n"] for r in files.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: got.get(i, 0) for t, i in place.items()}, got.get(-1, 0)


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """path, doc_id, own (licences stated, best first) and own_score (the best cosine, null without one)."""
    df, n = term_frequencies(files, templates)
    sent = files.sparkSession.sparkContext.broadcast(Matcher(df, n, templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sent.value.match(t) for t in b["text"].to_pylist()]
            own = pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string()))
            score = pa.array([f[0][1] if f else None for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b["path"], b["doc_id"], own, score], ["path", "doc_id", "own", "own_score"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("path", "doc_id", "text").mapInArrow(run, f"path string, doc_id {kind}, own array<string>, own_score double")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licence_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The licence of every row of ``files`` (path, doc_id, text).

    Columns: doc_id, path, own, own_score, licence, origin and licence_dir.
    origin is ``own``, ``directory`` or ``none``; licence_dir is the directory
    inherited from. A licence file speaks for its directory; of several in one
    directory the one with the best score counts, of equals the smallest path.
    The root directory is ''. A row with a null path has its own licence or
    none; null and empty texts state none. Repeated rows keep their rows.
    Other columns are ignored.
    """
    rows = materialise(own_licences(files, templates, least).withColumn("dir", directory(F.col("path"))), "licence-own")
    given = (
        rows.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILES) & F.col("own_score").isNotNull())
        .groupBy(F.col("dir").alias("licence_dir"))
        .agg(F.min(F.struct((-F.round("own_score", 9)).alias("s"), "path", F.col("own")[0].alias("licence"))).alias("best"))
        .select("licence_dir", F.col("best.licence").alias("inherited"))
    )
    parts = F.split("dir", "/")
    above = rows.where("dir is not null").select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("licence_dir")))).alias("a")
    ).select("dir", "a.depth", "a.licence_dir")
    nearest = materialise(
        above.join(given, "licence_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "inherited")).alias("n")).select("dir", "n.licence_dir", "n.inherited"),
        "licence-dirs",
    )
    few = nearest.count() <= BROADCAST_DIRS
    return rows.join(F.broadcast(nearest) if few else nearest, "dir", "left").select(
        "doc_id",
        "path",
        "own",
        "own_score",
        F.coalesce(F.get("own", F.lit(0)), F.col("inherited")).alias("licence"),
        F.when(F.size("own") > 0, "own").when(F.col("inherited").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.size("own") == 0, F.col("licence_dir")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The driver's documents as a tree of files: source/lang/block/id, one licence file in each block of 64 ids."""
    block = F.floor(F.col("doc_id") / 64).cast("string")
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    # A licence file sits in the block's directory, the others one level below, by source.
    path = F.when(F.col("doc_id") % 64 == 0, F.concat_ws("/", F.lit("tree"), block, name)).otherwise(
        F.concat_ws("/", F.lit("tree"), block, F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    )
    return docs.select(path.alias("path"), "doc_id", "text")
