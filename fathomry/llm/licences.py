"""Licence scan: sparse TF-IDF cosine of statements to templates, then inheritance along directories.

A file is a row with a path. Its statements are its lines, its blocks (lines without a blank one between them), the
sentences of its blocks, and the whole text, of whatever length. Each distinct statement is weighed by TF-IDF (idf
over the templates) and compared with every template by cosine; at THRESHOLD or more and with MIN_TERMS shared terms the
best template is the statement's licence. No statement is left out before that: those that cannot reach the threshold
are told by their own length in the terms of the templates.

A text of any length is compared as a whole with full licence texts too, and is a licence file at FULL_THRESHOLD or more.
An SPDX tag counts as a statement, of cosine 1, for each licence that it names.

A file's own licence is that of the full text it is, or the one most of its statements carry. A file without one
inherits that of the nearest directory above it: the licence that most of the licence files (full licence texts, and
files of which a statement is a good part) of that directory carry.

Statements are compared where their text is read, by a pass over Arrow batches, and only licences go on; directories are
counted before they meet the files, and ancestors are reached by joins on path prefixes.

Cases: a null or empty text has no statement and may inherit; a null path has no directory, so it inherits nothing;
ties go to the licence that sorts first; repeated rows count as often as they stand; an empty table gives no rows;
``scan`` reads only path and text, whatever other columns there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, plan_bytes

THRESHOLD, MIN_TERMS = 0.6, 3
#: Licences of directories go to every executor up to this size, beyond it by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Cosine of a text of any length to a full licence text.
FULL_THRESHOLD = 0.8
#: A file is a licence file when its statements have at least this share of its words.
FILE_SHARE = 0.3

#: Fixed texts: a short statement and the opening of the licence for each identifier.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
WORD = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"


#: A licence tag in a text, with its expression, and the identifiers in one.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*")


def full_texts() -> dict[str, tuple[str, ...]]:
    """The full licence texts, read by the driver. That of AGPL-3.0 is made from GPL-3.0's by its name."""
    found = {f.name.removesuffix(".txt"): (f.read_text("utf-8"),) for f in (resources.files(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt")}
    affero = re.sub(r"(?i)gnu general public", "GNU Affero General Public", found["GPL-3.0"][0])
    return dict(sorted((found | {"AGPL-3.0": (affero,)}).items()))


def tagged(text: str) -> list[str]:
    """The licences that the tags of a text name, once each: 'MIT OR Apache-2.0' names two."""
    known = {x.lower(): x for x in [*TEMPLATES, "GPL-1.0", "LGPL-2.0", "LGPL-2.1"]}
    plain = (re.sub(r"-(only|or-later)$", "", x.lower()) for m in SPDX.finditer(text) for x in IDENTIFIER.findall(re.sub(r"(?i)\bwith\s+\S+", "", m[1])))
    return list(dict.fromkeys(known[x] for x in plain if x in known))


def weights(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float]]:
    """(licence, template number, term, unit weight) of the templates, and the idf of each term."""
    texts = [(name, i, Counter(re.findall(WORD, t.lower()))) for name, ts in templates.items() for i, t in enumerate(ts)]
    df = Counter(t for *_, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, i, c in texts:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(math.fsum(v * v for v in raw.values()))
        rows += [(name, i, t, v / norm) for t, v in raw.items()]
    return rows, idf


def unknown_idf(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> float:
    """The idf of a term that no template has."""
    return math.log(1 + sum(len(ts) for ts in templates.values())) + 1


class Scorer:
    """Cosines of texts to templates, exactly and without a join: what cannot reach the threshold is ruled out by the
    part of its length that lies in terms no template has."""

    def __init__(self, rows: list[tuple[str, int, str, float]], idf: dict[str, float], unknown: float, threshold: float):
        self.idf, self.unknown, self.threshold = idf, unknown, threshold
        self.names = sorted({(name, i) for name, i, *_ in rows})
        place = {x: j for j, x in enumerate(self.names)}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for name, i, term, w in rows:
            self.by_term.setdefault(term, []).append((place[name, i], w))

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The licence of the best template and its cosine, if it reaches the threshold with MIN_TERMS shared terms."""
        idf = self.idf
        if len(words) < MIN_TERMS or sum(w in idf for w in words) < MIN_TERMS:
            return None
        counts = Counter(words)
        inside, outside = {}, 0.0
        for term, n in counts.items():
            v = 1.0 if n == 1 else 1 + math.log(n)
            if term in idf:
                inside[term] = v * idf[term]
            else:
                outside += v * v
        if len(inside) < MIN_TERMS:
            return None
        known = math.fsum(v * v for v in inside.values())
        norm2 = known + outside * self.unknown * self.unknown
        if known < self.threshold * self.threshold * norm2 * (1 - 1e-9):
            return None
        dots, shared = [0.0] * len(self.names), [0] * len(self.names)
        for term in sorted(inside):
            for j, w in self.by_term[term]:
                dots[j] += inside[term] * w
                shared[j] += 1
        found = [(-round(dots[j] / math.sqrt(norm2), 9), self.names[j][0]) for j in range(len(dots)) if shared[j] >= MIN_TERMS]
        cosine, name = min(found, default=(0.0, ""))
        return (name, -cosine) if -cosine >= self.threshold else None


_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def statements(text: str) -> Iterator[list[str]]:
    """The words of the distinct statements of a text: lines, blocks, sentences of blocks, and all of it."""
    find = re.compile(WORD).findall
    seen: set[tuple[str, ...]] = set()
    whole: list[str] = []
    block: list[str] = []
    in_block: list[str] = []

    def new(words: list[str]) -> Iterator[list[str]]:
        key = tuple(words)
        if len(words) >= MIN_TERMS and key not in seen:
            seen.add(key)
            yield words

    for line in [*text.lower().split("\n"), ""]:
        if line.strip():
            words = find(line)
            yield from new(words)
            block.append(line)
            in_block += words
            continue
        if block:
            yield from new(in_block)
            sentences = _SENTENCE.split("\n".join(block))
            if len(sentences) > 1:
                for sentence in sentences:
                    yield from new(find(sentence))
            whole += in_block
        block, in_block = [], []
    yield from new(whole)


def own_licences(files: DataFrame, ids: list[str]) -> DataFrame:
    """ids, path, own, own_cosine, licence_file of files (ids, path, text): what each file's own text says."""
    kept = files.select(*ids, "path")
    schema = T.StructType([*kept.schema.fields, T.StructField("own", T.StringType()), T.StructField("own_cosine", T.DoubleType()), T.StructField("licence_file", T.BooleanType())])
    find = re.compile(WORD).findall
    full = full_texts()
    shipped = files.sparkSession.sparkContext.broadcast((*weights(full), unknown_idf(full), FULL_THRESHOLD))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, whole = Scorer(*weights(), unknown_idf(), THRESHOLD), Scorer(*shipped.value)
        for batch in batches:
            out: list[tuple[str | None, float | None, bool | None]] = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                all_words = find(text.lower())
                n_words = len(all_words)
                licence = whole.best(all_words)
                if licence is not None:
                    out.append((*licence, True))
                    continue
                met: dict[str, list[float]] = {name: [1.0] for name in tagged(text)}
                longest = 0
                for words in statements(text):
                    best = scorer.best(words)
                    if best is not None:
                        met.setdefault(best[0], []).append(best[1])
                        longest = max(longest, len(words))
                if met:
                    own = min(met, key=lambda x: (-len(met[x]), x))
                    out.append((own, max(met[own]), longest >= FILE_SHARE * n_words))
                else:
                    out.append((None, None, None))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*ids, "path")), *columns], schema.names)

    return files.select(*ids, "path", "text").mapInArrow(run, schema)


def parent(path: Column) -> Column:
    """The directory of a path; null at the top."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", ""))


def most_common(df: DataFrame, key: list[str]) -> DataFrame:
    """key, licence: the licence that stands most often under key."""
    n = df.groupBy(*key, "licence").agg(F.sum("n").alias("n"), F.max("cosine").alias("cosine"))
    best = n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), "licence", "cosine")).alias("b"))
    return best.select(*key, "b.licence", "b.cosine")


def scan(files: DataFrame, scratch: Scratch, ids: list[str] | None = None) -> DataFrame:
    """ids, path, licence, cosine (of the statement it comes from), origin ('own', 'inherited' or null), from_directory."""
    ids = ids or []
    known = scratch.save(own_licences(files, ids), "own")
    directory = parent(F.col("path"))
    files_of = known.filter("licence_file").groupBy(directory.alias("d"), F.col("own").alias("licence")).agg(F.count(F.lit(1)).alias("n"), F.max("own_cosine").alias("cosine")).filter("d is not null")
    given = most_common(files_of, ["d"]).select(F.col("d").alias("a"), F.col("licence").alias("dir_licence"), F.col("cosine").alias("dir_cosine"))
    # nearest ancestor of every directory, by joins of its prefixes
    wanted = known.filter("own is null and path is not null").select(directory.alias("d")).filter("d is not null").distinct()
    parts = F.split("d", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("a")))
    nearest = wanted.select("d", F.explode(prefixes).alias("p")).select("d", "p.depth", "p.a").join(given, "a").groupBy("d").agg(F.max_by(F.struct("a", "dir_licence", "dir_cosine"), "depth").alias("n"))
    nearest = scratch.save(nearest, "nearest")
    # a directory may hold a third of all files: its one row goes to them, not they to it
    nearest = F.broadcast(nearest) if plan_bytes(nearest) <= BROADCAST_BYTES else nearest
    joined = known.withColumn("d", F.when(F.col("own").isNull(), directory)).join(nearest, "d", "left")
    return joined.select(
        *ids,
        "path",
        F.coalesce("own", "n.dir_licence").alias("licence"),
        F.coalesce("own_cosine", "n.dir_cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("n.a").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(F.col("own").isNull(), F.col("n.a")).alias("from_directory"),
    )


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files source/lang/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")))
    return scan(docs.select("doc_id", path.alias("path"), "text"), Scratch(spark, "op1"), ["doc_id"])
