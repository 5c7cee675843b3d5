"""Licence notices found through a positional index of rare words.

A template is a notice as words, with key phrases that must stand in it. The inverse document frequency
(IDF) of every template word is first counted over all texts. A text's licence words are then looked up
from the highest IDF on: each place of a template's rarest key word proposes where the template would
start, the places of its next rarest key word must propose the same start, and what is left is verified by
the whole key phrases. A place's score is the share of the template's words that stand at their places.

Every key word of a place has to be there, so looking up the rarest loses none, whatever the frequencies:
they decide how much is looked up, not what is found. The index holds the templates only and goes to
every task; texts aren't shuffled. Of all texts only one count per template word reaches the driver.

Cases: a null or empty text has no words and no places. Repeated rows count each, null ids stay. An empty
table gives no rows. Only the id and text columns are read, so others can't clash. A text is searched whole,
with memory in proportion to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, text_bytes

#: Letters (A-Z already lower-cased), digits and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Key words of a template whose places are intersected.
RARE = 2
#: Share of a template's words, in tenths, that gives its label.
ENOUGH = 8


@dataclass(frozen=True)
class Template:
    """`text` holds each of the `keys`; `base` templates are key phrases as a whole."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @cached_property
    def words(self) -> list[bytes]:
        return WORD.findall(self.text.lower().encode())

    @cached_property
    def key_places(self) -> list[int]:
        """Numbers of the words in key phrases."""
        found = set()
        for key in self.keys:
            phrase = WORD.findall(key.lower().encode())
            at = next((i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase), None)
            if at is None or not phrase:
                raise ValueError(f"{key!r} isn't a phrase of {self.text!r}")
            found |= set(range(at, at + len(phrase)))
        return sorted(found)


#: Fixed phrases and labels of the base.
BASE = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
)
#: Fixed wording of common notices.
NOTICES = (
    Template("mit", "Released under the MIT License", ("MIT License",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License Version 2.0",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("GNU General Public License version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("GNU General Public License version 3",)),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ("Lesser General Public License version 3",)),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("Affero General Public License version 3",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License v. 2.0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",)),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("CC0 1.0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
TEMPLATES = BASE + NOTICES


def frequencies(docs: DataFrame, text_col: str, templates: Sequence[Template]) -> tuple[int, dict[bytes, int]]:
    """Number of texts, and of those that hold each template word, over all texts."""
    wanted = {w for t in templates for w in t.words}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                held.update(wanted.intersection(WORD.findall(text.lower())))
                held[b""] += 1
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        yield batch_of(schema, list(held), list(held.values()))

    counted = in_arrow(docs.select(F.col(text_col).cast("string")), each, "word binary, n long")
    found = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


class Index:
    """Postings of the rare key words of the templates, by word: (template, place in it, rank)."""

    def __init__(self, templates: Sequence[Template], n_texts: int, held: dict[bytes, int]):
        self.templates = tuple(templates)
        self.idf = {w: math.log((n_texts + 1) / (held.get(w, 0) + 1)) for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.n_rare = []
        for number, t in enumerate(self.templates):
            rare = sorted(t.key_places, key=lambda p: (-self.idf[t.words[p]], p))[:RARE]
            self.n_rare.append(len(rare))
            for rank, place in enumerate(rare):
                self.postings[t.words[place]].append((number, place, rank))
        self.first = {w for w, own in self.postings.items() if any(rank == 0 for _, _, rank in own)}

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, words that stand at their place) of every place, by start."""
        if self.first.isdisjoint(words):
            return []
        stands: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                stands[w].append(i)
        starts: dict[int, set[int]] = {}
        for w in sorted(stands, key=lambda w: (-self.idf[w], w)):
            for number, place, rank in self.postings[w]:
                if rank == 0:
                    starts[number] = {i - place for i in stands[w]}
        for w, own in stands.items():
            for number, place, rank in self.postings[w]:
                if rank and number in starts:
                    starts[number] &= {i - place for i in own}
        found, n = [], len(words)
        for number, own in starts.items():
            t = self.templates[number]
            for start in own:
                if all(0 <= start + p < n and words[start + p] == t.words[p] for p in t.key_places):
                    matched = sum(0 <= start + p < n and words[start + p] == w for p, w in enumerate(t.words))
                    found.append((number, start, matched))
        return sorted(found, key=lambda f: (f[1], f[0]))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES
) -> DataFrame:
    """Per row: the id, `n_words` and `places`: label, whether base, the number of the word at which the
    template starts (negative if its first words are missing), words matched and words in all."""
    index = Index(templates, *frequencies(docs, text_col, templates))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, listed = [], []
            for text in text_bytes(batch.column(1)):
                words = WORD.findall(text.lower())
                sizes.append(len(words))
                own = ((index.templates[t], start, matched) for t, start, matched in index.places(words))
                listed.append([
                    {"label": t.label, "base": t.base, "start": start, "matched": matched, "total": len(t.words)}
                    for t, start, matched in own
                ])
            yield batch_of(pa.schema([batch.schema.field(0), ("n_words", pa.int64()), ("places", PLACES)]), batch.column(0), sizes, listed)

    out = (
        f"`{id_col}` {field_type(docs, id_col)}, n_words long, "
        "places array<struct<label: string, base: boolean, start: long, matched: int, total: int>>"
    )
    return in_arrow(docs.select(id_col, F.col(text_col).cast("string")), each, out)


PLACES = pa.list_(pa.struct([
    ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("matched", pa.int32()), ("total", pa.int32()),
]))


def labels(places: Column) -> Column:
    """The different labels of some places, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def enough(place: Column, tenths: int = ENOUGH) -> Column:
    """Whether so much of the template stands there that its label is given."""
    return 10 * place["matched"] >= tenths * place["total"]
