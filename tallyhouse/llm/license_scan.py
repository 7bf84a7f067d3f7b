"""License notices in whole texts: exact phrases, and short notices with a few edits.

A notice of ``n`` letters may have ``n // 10`` edits. Cut into one piece more
than that, at least one piece stands unchanged in every match (pigeonhole). The
pieces are looked up exactly; around each hit the ``regex`` library's
bounded-error matching decides, and tells span and edits. Texts are compared as
lower-case words joined by one space. Documents are worked on one by one:
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import ship

# Phrases that must stand exactly, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that may have a few edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "this work is dedicated to the public domain": "public-domain",
}

#: Lower-cases A-Z; every byte that is in no word becomes a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label = text.encode(), label
        self.edits = len(self.text) // 10
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(self.text, special_only=True) + b"){e<=%d}" % self.edits)

    def places(self, text: bytes) -> list[tuple[int, int]]:
        """Stretches that a match must lie in, merged where they overlap."""
        found = []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                found.append((max(0, at - offset - self.edits), at - offset + len(self.text) + self.edits))
                at = text.find(piece, at + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        for a, b in self.places(text):
            yield from self._within(text, a, min(b, len(text)))

    def _within(self, text: bytes, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """The best match of a stretch, and likewise those before and after it, in order."""
        stretches, found = [(a, b)], []
        while stretches:
            a, b = stretches.pop()
            m = self.pattern.search(text, a, b) if b - a >= len(self.text) - self.edits else None
            if m:
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                stretches += [(a, m.start()), (m.end(), b)]
        yield from sorted(found)


def _exact(text: bytes, phrase: bytes) -> Iterator[int]:
    at = text.find(phrase)
    while at >= 0:
        yield at + 1
        at = text.find(phrase, at + 1)


def _scan(phrases: dict[str, str], notices: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Notice(t, label) for t, label in notices.items()]
        exact = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("letters", pa.int64())])
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in W.chunks(batch.column(batch.schema.get_field_index("text"))):
                data = chunk.data.tobytes()
                counts, base, near = [], [], []
                for i in range(len(chunk.rows)):
                    own = data[chunk.offsets[i] : chunk.offsets[i + 1]].translate(_FOLD).split()
                    text = b" %s " % b" ".join(own)
                    word = lambda at, text=text: text.count(b" ", 0, at) - 1
                    counts.append(len(own))
                    base.append(sorted(({"label": x, "first_word": word(at), "last_word": word(at + len(p) - 2), "edits": 0, "letters": len(p) - 2} for p, x in exact for at in _exact(text, p)), key=lambda s: (s["first_word"], s["label"])))
                    near.append([{"label": n.label, "first_word": max(0, word(a + 1)), "last_word": word(max(a + 1, b - 1)), "edits": e, "letters": len(n.text)} for n in known for a, b, e in n.matches(text)])
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.rows.start, len(counts)), pa.array(counts, pa.int64()), pa.array(base, pa.list_(span)), pa.array(near, pa.list_(span))], ["doc_id", "n_words", "phrases", "notices"])

    return run


def license_spans(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, phrases, notices), a row per row.

    ``phrases`` and ``notices`` list what was found: label, first and last word
    (from 0), edits, and the letters of the phrase. A null text is empty; an
    empty text has no words and no spans. Any doc_id, null or repeated, is
    passed on. Other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    span = "array<struct<label:string,first_word:long,last_word:long,edits:long,letters:long>>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan(phrases or PHRASES, notices or NOTICES), f"doc_id long, n_words long, phrases {span}, notices {span}")


def license_labels(spans: DataFrame) -> DataFrame:
    """Per document: exact places, their labels, all labels, and how close the closest span is (1 exact, 0 none)."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    close = F.transform(F.concat("phrases", "notices"), lambda s: 1 - s["edits"] / s["letters"])
    return spans.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.first_word").alias("first_word"),
        F.array_max("phrases.first_word").alias("last_word"),
        labels("phrases.label").alias("base_labels"),
        labels(F.concat("phrases.label", "notices.label")).alias("labels"),
        F.coalesce(F.array_max(close), F.lit(0.0)).alias("score"),
    )
