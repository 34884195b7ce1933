"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the positions they
have in license templates. Every match votes for its diagonal (text position
minus template position); votes of neighbouring diagonals, which insertions
and deletions leave side by side, are merged into spans, and a span is verified
by how much of the template its words really cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ragged, steps

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
#: Diagonals this far apart, at most, belong to one span.
NEIGHBOURS = 4
#: Share of a template's k-grams that a span must hold in order.
ACCEPT = 0.75

#: Phrases whose consecutive words alone give a label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Customary one-line license notices, by label.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Licensed under the BSD License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
]

#: Opening texts of public license notices, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}

_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class LicenseSet:
    """What to look for. Templates and phrases are small by construction: ``MAX_WORDS`` in all."""

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str], ...] = (*NOTICES, *TEMPLATES.items())
    k: int = K
    accept: float = ACCEPT

    MAX_WORDS = 1_000_000

    def __post_init__(self) -> None:
        if sum(len(t.split()) for _, t in (*self.phrases, *self.templates)) > self.MAX_WORDS:
            raise ValueError("the templates are too large to broadcast")


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, text.translate(_LOWER)) if w]


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for at in range(k):
        out = (out ^ hashes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _text_grams(texts: pa.Array, known: LicenseSet) -> tuple[list, ...]:
    """Per text: number of words, base places, first and last of them, base labels, k-gram hashes."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), WORD_GAP)
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[there]
    words = flat.filter(pa.array(there)).dictionary_encode()
    names = words.dictionary.to_pylist()
    hashes = np.array(list(map(_word_hash, names)), np.uint64)
    codes = words.indices.to_numpy()
    code_of = {w: n for n, w in enumerate(names)}
    n_words = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(n_words)
    starts = ends - n_words
    n_base, first, last = np.zeros(len(texts), np.int64), np.full(len(texts), 1 << 60), np.full(len(texts), -1)
    labels: list[set[str]] = [set() for _ in texts]
    for phrase, label in known.phrases:
        wanted = [code_of.get(w) for w in words_of(phrase)]
        if not wanted or None in wanted or len(wanted) > len(codes):
            continue
        at = np.flatnonzero(codes[: len(codes) - len(wanted) + 1] == wanted[0])
        for k, code in enumerate(wanted):
            at = at[codes[at + k] == code]
        at = at[owner[at] == owner[at + len(wanted) - 1]]
        np.add.at(n_base, owner[at], 1)
        np.minimum.at(first, owner[at], at - starts[owner[at]])
        np.maximum.at(last, owner[at], at - starts[owner[at]])
        for n in set(owner[at].tolist()):
            labels[n].add(label)
    grams = rolling(hashes[codes], known.k) if len(codes) else np.zeros(0, np.int64)
    sizes = np.maximum(0, n_words - known.k + 1)
    picked = grams[ragged(starts, sizes)] if len(grams) else np.zeros(0, np.int64)
    gram_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32)), pa.array(picked, pa.int64()))
    none = n_base == 0
    return n_words, n_base, pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), [",".join(sorted(x)) for x in labels], gram_lists


def template_grams(spark: SparkSession, known: LicenseSet) -> DataFrame:
    """(label, template, t_pos, gram): where each k-gram stands in each template."""
    rows = []
    for number, (label, text) in enumerate(known.templates):
        hashes = np.array([_word_hash(w) for w in words_of(text)], np.uint64)
        rows += [(label, number, at, int(g)) for at, g in enumerate(rolling(hashes, known.k))]
    return spark.createDataFrame(rows, "label string, template int, t_pos int, gram long")


def scan_licenses(docs: DataFrame, known: LicenseSet = LicenseSet(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row.

    Base labels come from phrases whose words stand consecutively; n_base
    counts their places, first_word and last_word are the smallest and largest
    start (null without any). ``labels`` adds those of verified template
    spans, which ``spans`` lists (label, first, last, score). ``score`` is the
    best span's share of its template's k-grams, 1 where a base phrase stands
    and 0 without either. Null text has no words. Rows that repeat are kept
    apart; a null id is a value like any other. Other columns are not read.
    """
    spark = docs.sparkSession
    sizes = {n: len(words_of(t)) - known.k + 1 for n, (_, t) in enumerate(known.templates)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"]
        for batch in batches:
            for part in steps(batch, "t"):
                n_words, n_base, first, last, labels, grams = _text_grams(part.column("t"), known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), first, last, pa.array(labels, pa.string()), grams], names)

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    base = rows.mapInArrow(of, "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<long>")
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    grams = base.select(*keys, F.posexplode_outer("grams").alias("pos", "gram"))
    # Each text keeps one row of its own, its first; all others stay only if they vote.
    votes = grams.join(F.broadcast(template_grams(spark, known)), "gram", "left").where("template is not null or coalesce(pos, 0) = 0")
    diagonals = votes.groupBy(*keys, "template", "label", (F.col("pos") - F.col("t_pos")).alias("diag")).agg(F.count("t_pos").alias("n"), F.collect_set("t_pos").alias("hits"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    line = Window.partitionBy("row", "template").orderBy("diag")
    apart = diagonals.withColumn("new", F.when(F.col("diag") - F.lag("diag").over(line) <= NEIGHBOURS, 0).otherwise(1))
    merged = apart.withColumn("span", F.sum("new").over(line)).groupBy(*keys, "template", "label", "span").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))
    size = F.create_map(*[F.lit(x) for n, s in sizes.items() for x in (n, max(1, s))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    share = F.size("hits") / F.element_at(size, F.col("template"))
    scored = merged.withColumn("share", F.when(F.col("template").isNotNull(), share))
    # Verified: enough of the template, within a stretch no longer than twice its length.
    good = (F.col("share") >= known.accept) & (F.col("last") - F.col("first") < 2 * F.element_at(size, F.col("template")) + 2 * known.k)
    span = F.struct("label", F.col("first").cast("long").alias("first"), (F.col("last") + known.k - 1).cast("long").alias("last"), F.col("share").alias("score"))
    per_text = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(good, span))).alias("spans"))
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(own, F.transform("spans", lambda s: s["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return per_text.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans")
