"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Term weights are log-scaled counts times the inverse frequency of the term among the templates; words that
no template has count towards the length with the largest weight. Line breaks and comment marks are no words.
Every window of as many words as a notice has, at every offset of the text, is compared with that notice, so
wrapped notices and those within a longer line are found; single lines and whole files are compared with all
notices, and whole files with the full licence texts of ``licence_texts``, weighted among themselves. A file's
own licence is the best of cosine MIN_COSINE or more; it is a licence file if matched words are at least
FILE_SHARE of its words, or the file as a whole matches.

A notice is slid over a text only if the text has terms with MIN_COSINE squared of the notice's squared length;
by Cauchy-Schwarz no window can match otherwise.

A directory's licence is that of its licence files, or failing these the one most of its licensed files
carry. A file without a licence of its own inherits from the nearest ancestor directory that has one:
the file's directory prefixes are exploded and joined to the directories by equality.

Defined results: null or empty texts match nothing and may inherit; a null path has no directory and
inherits nothing; ties go to the smallest licence name; files that repeat a path are each judged and all count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dealt
from .common import Workspace

# Short notices and opening or core sentences of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
MIN_COSINE, FILE_SHARE = 0.75, 0.5
#: Parts that a directory's descendants are dealt to where they meet its licence.
SPREAD = 32
_TOKEN = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")


def bodies() -> dict[str, list[str]]:
    """Full licence texts by name."""
    return {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Templates:
    """TF-IDF vectors of the templates, as an inverted index by term."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, full: dict[str, list[str]] | None = None):
        self.full = Templates(full) if full else None
        texts = [(name, Counter(_tokens(t))) for name, ts in sorted(templates.items()) for t in ts]
        df = Counter(w for _, c in texts for w in c)
        self.idf = {w: 1 + math.log((1 + len(texts)) / (1 + n)) for w, n in df.items()}
        self.unknown = 1 + math.log(1 + len(texts))
        self.names, self.postings = [n for n, _ in texts], {}
        self.weights, self.widths = [], [sum(c.values()) for _, c in texts]
        for k, (_, c) in enumerate(texts):
            norm = math.sqrt(sum((self._tf(n) * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.postings.setdefault(w, []).append((k, self._tf(n) * self.idf[w] / norm))
            self.weights.append({w: self._tf(n) * self.idf[w] / norm for w, n in c.items()})

    @staticmethod
    def _tf(n: int) -> float:
        return 1 + math.log(n)

    def best(self, c: Counter) -> tuple[float, str | None]:
        """Cosine and name of the nearest template for a text's term counts; exact for any text."""
        known = [w for w in c if w in self.postings]
        if not known:
            return 0.0, None
        norm2 = sum((self._tf(n) * self.idf.get(w, self.unknown)) ** 2 for w, n in c.items())
        # By Cauchy-Schwarz the cosine is at most the share of the known terms in the length.
        if sum((self._tf(c[w]) * self.idf[w]) ** 2 for w in known) < MIN_COSINE**2 * norm2:
            return 0.0, None
        dots: dict[int, float] = {}
        for w in known:
            x = self._tf(c[w]) * self.idf[w]
            for k, y in self.postings[w]:
                dots[k] = dots.get(k, 0.0) + x * y
        score, k = max((v, -k) for k, v in dots.items())
        return round(score / math.sqrt(norm2), 9), self.names[-k]

    def cosine(self, k: int, c: Counter) -> float:
        """Cosine of one template and a text's term counts."""
        norm2 = sum((self._tf(n) * self.idf.get(w, self.unknown)) ** 2 for w, n in c.items())
        return round(sum(self._tf(c[w]) * self.idf[w] * y for w, y in self.weights[k].items() if w in c) / math.sqrt(norm2), 9)

    def windows(self, tokens: list[str]) -> list[tuple[float, str, int, int]]:
        """(cosine, name, start, end) of matching windows: the best of each template, then the best apart from those taken."""
        present, out = self.postings.keys() & set(tokens), []
        mass = [0.0] * len(self.weights)
        for w in present:
            for k, y in self.postings[w]:
                mass[k] += y * y
        tf = [0.0] + [self._tf(n) for n in range(1, max(self.widths) + 2)]
        floor = MIN_COSINE**2 - 1e-6
        for k, weight in enumerate(self.weights):
            if mass[k] < floor:
                continue
            width, counts, norm2, dot, hits = min(self.widths[k], len(tokens)), {}, 0.0, 0.0, []
            for i, w in enumerate(tokens):
                for t, step in ((w, 1), (tokens[i - width], -1)) if i >= width else ((w, 1),):
                    n, g = counts.get(t, 0), self.idf.get(t, self.unknown)
                    counts[t] = n + step
                    norm2 += (tf[n + step] ** 2 - tf[n] ** 2) * g * g
                    dot += (tf[n + step] - tf[n]) * g * weight.get(t, 0.0)
                if i >= width - 1 and dot > 0 and dot * dot >= floor * norm2:
                    start = i + 1 - width
                    score = self.cosine(k, Counter(tokens[start : i + 1]))
                    if score >= MIN_COSINE:
                        hits.append((-score, start))
            taken: set[int] = set()
            for score, start in sorted(hits):
                if start not in taken and start + width - 1 not in taken:
                    taken.update(range(start, start + width))
                    out.append((-score, self.names[k], start, start + width))
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """Licence, cosine and whether the text is a licence file."""
        if not text or not text.strip():
            return None, 0.0, False
        tokens: list[str] = []
        found: list[tuple[float, str, int, int]] = []
        for line in text.split("\n"):
            words = _tokens(line)
            score, name = self.best(Counter(words)) if not self.postings.keys().isdisjoint(words) else (0.0, None)
            if score >= MIN_COSINE:
                found.append((score, name, len(tokens), len(tokens) + len(words)))
            tokens += words
        found += self.windows(tokens)
        whole = Counter(tokens)
        for templates in (self, self.full) if self.full else (self,):
            score, name = templates.best(whole)
            if score >= MIN_COSINE:
                found.append((score, name, 0, len(tokens)))
        if not found:
            return None, 0.0, False
        matched = len(set().union(*(range(start, end) for _, _, start, end in found)))
        score, name = min((-score, name) for score, name, _, _ in found)
        return name, -score, matched >= FILE_SHARE * len(tokens)


def _pieces(batches, rows: int = 256):
    """Arrow batches cut small, so that memory follows a few files and not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scan(files: DataFrame) -> DataFrame:
    """(key, path, licence, cosine, is_file) per row of ``files`` (key, path, text)."""
    full = bodies()

    def run(batches):
        templates = Templates(full=full)
        for b in _pieces(batches):
            found = [templates.scan(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], b["path"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["key", "path", "licence", "cosine", "is_file"])

    return files.select("key", "path", "text").mapInArrow(run, "key long, path string, licence string, cosine double, is_file boolean")


def _directories(path: Column) -> Column:
    """(directory, depth) of all ancestors of a path, the root '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds ``inherited`` and ``from_dir`` to files without a licence of their own.

    Directory licences are summed per task before the shuffle, and files meet their directories through
    the distinct directories, so a directory with a third of all files is one row on either side. Tables of
    directories grow with the files and their written rows are small for what they take in memory, so none is broadcast.
    """
    own_dir = F.regexp_replace("path", r"(^|/)[^/]*$", "")
    counts = scanned.where("licence is not null and path is not null").groupBy(own_dir.alias("dir"), "licence").agg(F.sum(F.col("is_file").cast("long")).alias("files"), F.count("*").alias("n"))
    best = counts.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("f"), (-F.col("n")).alias("n"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("inherited"))
    dirs = scanned.where("path is not null").select(own_dir.alias("at")).distinct()
    ancestors = dirs.select("at", F.explode(_directories(F.concat("at", F.lit("/x")))).alias("a")).select("at", "a.dir", "a.depth").distinct()
    # Every directory has the topmost ones as ancestors, so these meet in SPREAD parts.
    ancestors = ancestors.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(SPREAD)))
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    nearest = dealt(ancestors).join(best, ["dir", "part"]).groupBy("at").agg(F.max(F.struct("depth", "dir", "inherited")).alias("b"))
    nearest = nearest.select("at", F.col("b.dir").alias("from_dir"), "b.inherited")
    out = scanned.withColumn("at", own_dir).join(dealt(nearest), "at", "left")
    lacks = F.col("licence").isNull()
    return out.select("key", "path", "licence", "cosine", "is_file", F.when(lacks, F.col("inherited")).alias("inherited"), F.when(lacks, F.col("from_dir")).alias("from_dir"))


def tree_path() -> Column:
    """Documents as files of a tree source/lang/bucket/doc_id. A null part is '?', a name of its own; a slash in a part is no
    separator; a row without doc_id has no path, so it lies in no directory and inherits nothing."""
    part = lambda c: F.translate(F.coalesce(c, F.lit("?")), "/", "_")
    return F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), F.floor(F.col("doc_id") / 64).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = tree_path()
    ws = Workspace(spark, "licences")
    scanned = ws.save(scan(docs.select(F.col("doc_id").cast("long").alias("key"), path.alias("path"), "text")), "scanned")
    return inherit(scanned).withColumnRenamed("key", "doc_id")
