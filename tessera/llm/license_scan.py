"""License scan: exact containment join of text blocks with license templates, and phrase places.

Tokens are ordered by their document frequency over the whole corpus, rarest first. A block can
hold at least ``ceil(t * |T|)`` of the ``|T|`` distinct tokens of a template only if it has one
of the template's ``|T| - ceil(t * |T|) + 1`` rarest tokens (prefix filter), has that many distinct tokens
itself (length filter), and if the place of the first common token leaves enough tokens after it
(positional filter). What passes is verified by counting the common tokens, so every block of the corpus that
meets the threshold is found. A block is a run of lines without a blank line. The templates are a
constant of this module (or a parameter of the caller), so what tasks receive does not grow with the corpus.

Defined cases: a null text is empty and gives no words, null places, empty labels and score 0.
Rows are judged one by one, so repeated rows and null ids give repeated results. Very long texts are
read whole. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, as_bytes, map_batches

#: Fixed phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening or notice texts of public licenses; a label may have more than one.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    # those two run over a blank line of the license's own layout, where blocks end: its paragraphs, besides the text set in one block
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: everything else becomes a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))
BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Index:
    """Templates with their tokens in frequency order, and their prefixes by token."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.templates, self.by_token, self.rank = [], {}, {}
        tokens = {w for _, t in templates for w in words_of(t.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(tokens, key=lambda w: (frequency.get(w, 0), w)))}
        for label, text in templates:
            ordered = sorted(set(words_of(text.encode())), key=self.rank.__getitem__)
            need = math.ceil(threshold * len(ordered) - 1e-9)
            for place, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.by_token.setdefault(w, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(ordered), need))
        self.prefix = frozenset(self.by_token)

    def matches(self, tokens: set[bytes]) -> dict[str, float]:
        """Label and containment of the templates that a block's tokens reach."""
        found: dict[str, float] = {}
        seen = set()
        mine = sorted(tokens & self.rank.keys(), key=self.rank.__getitem__)
        for after, w in enumerate(mine):
            for k, place in self.by_token.get(w, ()):
                if k in seen:
                    continue
                label, template, need = self.templates[k]
                # no template token before this one is in the block, or k had been seen
                if len(tokens) < need or min(len(template) - place, len(mine) - after) < need:
                    continue
                seen.add(k)
                common = len(template & tokens)
                if common >= need:
                    found[label] = max(found.get(label, 0.0), common / len(template))
        return found


def token_frequencies(docs: DataFrame, text_col: str, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """Documents holding each of ``tokens``, over all rows; as many rows come back as there are tokens."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("__text").to_pylist():
                total.update(tokens.intersection(words_of(text)))
        yield {"token": list(total), "n": list(total.values())}

    counted = map_batches(docs.select(as_bytes(F.col(text_col)).alias("__text")), count, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def base_places(words: list[bytes], joined: bytes, phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(start word, label) of all places of the phrases; ``joined`` is the words with a space at both ends."""
    found = []
    for phrase, label in phrases.items():
        if b" " + phrase + b" " in joined:
            parts = phrase.split()
            found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i] == parts[0] and words[i : i + len(parts)] == parts]
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per document: words, phrase places, labels of phrases and of templates, score.

    The score is 1 where a phrase stands, else the best containment of a template that reaches the threshold, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    tokens = frozenset(w for _, t in templates for w in words_of(t.encode()))
    index = Index(templates, token_frequencies(docs, text_col, tokens), threshold)
    needles = {p.encode(): label for p, label in phrases.items()}
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                spaced = text.translate(TABLE)
                words = spaced.split()
                joined = b" " + b" ".join(words) + b" "
                places = base_places(words, joined, needles)
                base = sorted({label for _, label in places})
                found: dict[str, float] = {}
                if not index.prefix.isdisjoint(words):
                    for block in BLANK.split(text):
                        for label, share in index.matches(set(words_of(block))).items():
                            found[label] = max(found.get(label, 0.0), share)
                starts = [i for i, _ in places]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *found})), 1.0 if base else max(found.values(), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield {"doc_id": batch.column("__id")} | {str(i): list(c) for i, c in enumerate(columns)}

    return map_batches(docs.select(F.col(id_col).alias("__id"), as_bytes(F.col(text_col)).alias("__text")), scan, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _places_sql(phrase: str) -> str:
    """Starts (from 0) of a phrase in the word list ``ws``."""
    same = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(0, len(ws)), lambda i: {same})"


def _template_rows() -> str:
    return ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_words_sql("coalesce(text, '')")} AS ws FROM documents
), base AS (
  SELECT doc_id, len(ws) AS n_words, list_concat({", ".join(_places_sql(p) for p in PHRASES)}) AS places,
         list_filter([{", ".join(f"CASE WHEN len({_places_sql(p)}) > 0 THEN '{label}' END" for p, label in PHRASES.items())}], lambda x: x IS NOT NULL) AS labels
  FROM d
), templates AS (
  SELECT label, list_distinct({_words_sql("t")}) AS tokens FROM (VALUES {_template_rows()}) AS v(k, label, t)
), blocks AS (
  SELECT doc_id, list_distinct({_words_sql("block")}) AS tokens FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\x0b\\x0c]*\\n')) AS block FROM d)
), shares AS (
  SELECT doc_id, label, len(list_intersect(b.tokens, t.tokens)) AS common, len(t.tokens) AS size FROM blocks b CROSS JOIN templates t
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(common::DOUBLE / size) AS share FROM shares WHERE common >= ceil(0.8 * size - 1e-9) GROUP BY doc_id
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(base.labels)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base.labels, coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN len(base.labels) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN found USING (doc_id)
"""
