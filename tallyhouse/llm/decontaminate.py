"""Benchmark passages in documents, with edits, by q-gram counts in diagonal bands.

Texts are compared as lower-case words joined by one space. Benchmark items are
cut into overlapping segments of ``SEGMENT`` letters (a shorter item is one
segment), and of ``FINE`` letters every ``FINE_STEP``, so each exact excerpt of
``FINE + FINE_STEP - 1`` letters holds a whole one; a segment of m letters may have ``m // 12`` edits, k. By the q-gram
lemma a region within k edits shares at least ``m + 1 - (k + 1) q`` q-grams with
it, on diagonals that differ by k at most. So shared q-grams are counted per
segment in diagonal bands of twice that width, each overlapping the next by
half; bands below the bound are dropped, the rest is aligned within the band.

Items go out to the tasks in blocks of bounded size, a pass over the documents
for each. Documents are worked on one by one; nothing of them is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import ship

Q, SEGMENT, STEP, FINE, FINE_STEP = 8, 96, 48, 64, 8
#: Items of a block, and letters of one.
BLOCK_ITEMS, BLOCK_LETTERS = 4096, 1 << 21
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_TABLE_BITS = 22
#: Keeps a band's number above zero: bands begin before the text by an item's letters at most.
_FAR = 1 << 35


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_FOLD).split())


def edit_budget(m: int) -> int:
    """A twelfth, as long as the lemma's bound stays above zero."""
    return max(0, min(m // 12, m // Q - 1))


def grams(data: np.ndarray) -> np.ndarray:
    """Each Q = 8 bytes in a row as one number, the first byte lowest."""
    if len(data) < Q:
        return np.zeros(0, dtype=W.U)
    return np.ndarray(len(data) - Q + 1, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(W.U)


def _slot(values: np.ndarray) -> np.ndarray:
    out = values * W.U(0x9E3779B97F4A7C15)
    out >>= W.U(64 - _TABLE_BITS)
    return out.view(np.int64)


def align(segment: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """The least edits that turn the segment into a part of the text, and where: (edits, start, stop), or None.

    The text has ``budget`` letters more at either end than the diagonal needs,
    so only 4 * budget + 1 diagonals count.
    """
    at = text.find(segment)
    if at >= 0:
        return 0, at, at + len(segment)
    width, far = 4 * budget + 1, budget + 1
    row = [(0, j) for j in range(width)]  # at j: text[:j], no letter of the segment used
    for i, letter in enumerate(segment):
        new: list[tuple[int, int]] = []
        for d in range(width):  # text position i + 1 + d - 0 on this diagonal
            j = i + d
            best = (row[d][0] + (j >= len(text) or text[j] != letter), row[d][1]) if j < len(text) else (far, 0)
            if d + 1 < width and row[d + 1][0] + 1 < best[0]:
                best = (row[d + 1][0] + 1, row[d + 1][1])
            if d and new[d - 1][0] + 1 < best[0] and j < len(text):
                best = (new[d - 1][0] + 1, new[d - 1][1])
            new.append(best)
        row = new
        if min(row)[0] > budget:
            return None
    edits, d = min((x[0], d) for d, x in enumerate(row))
    return (edits, row[d][1], min(len(segment) + d, len(text))) if edits <= budget else None


class Index:
    """Segments of some items, and where each q-gram stands in the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.segments: list[tuple[int, bytes, bool]] = []
        parts, places, starts, spans, owner = [], [], [], [], []
        for item, text in items:
            own = plain(text)
            if len(own) < Q:
                continue
            parts.append(grams(np.frombuffer(own, dtype=np.uint8)))
            at = np.arange(len(parts[-1]))
            span = []
            for size, step, fine in ((SEGMENT, STEP, False), (FINE, FINE_STEP, True)):
                last = max(0, len(own) - size)
                begin = np.array([*range(0, last, step), last] if last or not fine else [], dtype=np.int64)
                # The segments that hold the q-gram: the first of them, and how many.
                low = np.searchsorted(begin, at + Q - min(size, len(own)))
                span += [low + len(self.segments), np.searchsorted(begin, at, "right") - low]
                self.segments += [(item, own[a : a + size], fine) for a in begin.tolist()]
                starts.append(begin)
            owner.append(len(owner))
            places.append(at)
            spans.append(np.array(span, dtype=np.int32))
        values = np.concatenate(parts) if parts else np.zeros(0, dtype=W.U)
        order = np.argsort(values, kind="stable")
        values = values[order]
        if parts:
            self.place, self.start = np.concatenate(places).astype(np.int32)[order], np.concatenate(starts)
            self.span = np.concatenate(spans, axis=1)[:, order]
            self.owner = np.repeat(owner, [len(p) for p in parts])[order]
        self.values, self.first = np.unique(values, return_index=True)
        self.count = np.diff(np.append(self.first, len(values)))
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[_slot(self.values)] = True
        sizes = np.array([len(s) for _, s, _ in self.segments], dtype=np.int64)
        self.budget = np.array([edit_budget(int(m)) for m in sizes], dtype=np.int64)
        self.bound = sizes + 1 - (self.budget + 1) * Q
        self.half = np.maximum(1, self.budget)
        self.widest = int(self.half.max()) if len(sizes) else 1
        # Of each item: the q-grams that its least demanding segment must share.
        self.least = np.full(len(parts), 1 << 30)
        if parts:
            held = np.repeat(owner, [len(s[0]) + len(s[1]) for s in zip(starts[::2], starts[1::2], strict=True)])
            np.minimum.at(self.least, held, self.bound)
        # For the first look: per kind of segment the width of a region and the q-grams it must share.
        kinds: dict[int, int] = {}
        for m, k, need in zip(sizes, self.budget, self.bound, strict=True):
            width = -(-int(m + k) // 16) * 16
            kinds[width] = min(kinds.get(width, 1 << 30), int(need))
        self.kinds = sorted(kinds.items())

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Of the hits' places, in order, those in a stretch with as many hits as some segment needs."""
        return at[self.near(at)]

    def near(self, at: np.ndarray) -> np.ndarray:
        """Which of the places ``dense`` keeps. Each of a stretch is one of ``need`` in a row that are as near."""
        change = np.zeros(len(at) + 1, dtype=np.int8)
        for width, need in self.kinds:
            if need > len(at):
                continue
            begin = at[need - 1 :] - at[: len(at) - need + 1] < width
            change[: len(begin)] += begin
            change[need : need + len(begin)] -= begin
        return np.cumsum(change[:-1], dtype=np.int64) > 0

    def beside(self, owner: np.ndarray, band: np.ndarray) -> np.ndarray:
        """For the hits' items and bands: which may share their band and one beside it with enough others.

        Counted in fewer slots than there are bands, so counts are too high at most; two
        bands that reach the bound together both stay.
        """
        last = (1 << max(10, 3 + len(band).bit_length())) - 1
        slot = (owner * 0x9E3779B1 + band) & last
        n = np.bincount(slot, minlength=last + 1)
        return n[slot] + np.maximum(n[slot - 1], n[(slot + 1) & last]) >= self.least[owner]

    def passages(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, stop, edits) in a plain text; of a fine segment only where no other of the item lies."""
        best: dict[tuple[int, int, bool], tuple[int, int, int, int]] = {}
        for *x, fine in self.regions(data):
            key = (x[0], x[1], fine)
            best[key] = min(best.get(key, tuple(x)), tuple(x), key=lambda y: y[3])
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for (item, start, fine), x in sorted(best.items(), key=lambda y: (y[0][2], y[1][3], y[1])):
            own = out.setdefault(item, [])
            if not fine or all(x[2] <= y[1] or y[2] <= start for y in own):
                own.append(x)
        return sorted(x for own in out.values() for x in own)

    def regions(self, data: bytes) -> Iterator[tuple[int, int, int, int, bool]]:
        """(item, start, stop, edits, whether of a fine segment) in a plain text.

        Segments come before the fine ones of their item; one of these that must
        overlap a region that was found is not aligned, as ``passages`` drops it.
        """
        values = grams(np.frombuffer(data, dtype=np.uint8))
        if not len(values) or not len(self.values):
            return
        # Most places fall out by one look into the table, and most others by how few are near each other.
        at = self.dense(np.flatnonzero(self.table.take(_slot(values))))
        if not len(at):
            return
        own = values[at]
        place = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        same = self.values[place] == own
        at, place = at[same], place[same]
        near = self.near(at)
        at, place = at[near], place[near]
        if not len(at):
            return
        many = self.count[place]
        entry = np.repeat(self.first[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        begun = np.repeat(at, many) - self.place[entry]  # where the item would begin
        # Most texts fall out here, before anything is sorted.
        kept = self.beside(self.owner[entry], begun // self.widest)
        if not kept.any():
            return
        entry, begun = entry[kept], begun[kept]
        # A segment's shared q-grams lie on half + 1 neighbouring diagonals of its item, so in two neighbouring bands.
        line, which, n = np.unique((self.owner[entry] << 36) + begun // self.widest + _FAR, return_inverse=True, return_counts=True)
        beside = np.diff(line) == 1
        near = n + np.maximum(np.append(n[1:] * beside, 0), np.insert(n[:-1] * beside, 0, 0))
        kept = near[which] >= self.least[self.owner[entry]]
        entry, begun, found = entry[kept], begun[kept], []
        for low, n in ((self.span[0][entry], self.span[1][entry]), (self.span[2][entry], self.span[3][entry])):
            one = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append((one, np.repeat(begun, n) + self.start[one]))
        segment, diagonal = (np.concatenate(x) for x in zip(*found, strict=True))
        half = self.half[segment]
        band = diagonal // half
        # A band and the one before it, so that any half + 1 neighbouring diagonals share one.
        line = (segment << 36) + band + _FAR
        line, size = np.unique(np.concatenate([line, line - 1]), return_counts=True)
        segment, band = line >> 36, (line & ((1 << 36) - 1)) - _FAR
        enough = size >= self.bound[segment]
        known: dict[int, dict[int, int]] = {}  # of each item: where its regions start, and the least stop of these
        for s, b in zip(segment[enough].tolist(), band[enough].tolist(), strict=True):
            item, text, fine = self.segments[s]
            k, width = int(self.budget[s]), int(self.half[s])
            low = b * width - k
            high = b * width + 2 * width + len(text) + k
            # A region starts within 4k letters, and lacks k of the segment's at most.
            if fine and k and any(y < max(0, low) + len(text) - k and max(0, low + 4 * k) < stop for y, stop in known.get(item, {}).items()):
                continue
            # Bytes that match nothing (plain texts have none) stand for what lies before the text.
            near = b"\0" * -low + data[max(0, low) : max(0, high)]
            found = align(text, near, k) if k else None
            if not k:
                spot = near.find(text)
                found = (0, spot, spot + len(text)) if spot >= 0 else None
            if found and not fine:
                own, start, stop = known.setdefault(item, {}), max(0, low + found[1]), max(0, low + found[2])
                own[start] = min(own.get(start, stop), stop)
            if found:
                yield item, max(0, low + found[1]), max(0, low + found[2]), found[0], fine


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _search(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = []
                for text, before in zip(_column(part, "text"), _column(part, "regions"), strict=True):
                    own = [dict(zip(("item_id", "start", "stop", "edits"), x, strict=True)) for x in index.passages(plain(text.as_py()))]
                    found.append((before.as_py() or []) + own)
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), _column(part, "text"), pa.array(found, kind)], ["doc_id", "text", "regions"])

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block at a time on the driver."""
    block: list[tuple[int, str]] = []
    letters = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or letters + len(row[1]) > BLOCK_LETTERS):
            yield block
            block, letters = [], 0
        block.append((row[0], row[1]))
        letters += len(row[1])
    yield block


def leaked_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, regions), a row per row.

    ``regions`` lists (item_id, start, stop, edits), positions in bytes of the
    plain text; a region may be found by several segments of an item. Each exact
    excerpt of 71 letters (bytes of the plain text) of an item is found. Null and
    empty texts have none; items that are null or have fewer than 8 letters
    are not looked for. Any doc_id, null or repeated, is passed on. Other
    columns are not read. An empty benchmark finds nothing.
    """
    ship(docs.sparkSession)
    none = F.array().cast("array<struct<item_id:long,start:long,stop:long,edits:long>>")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("regions"))
    for block in item_blocks(benchmark):
        own = own.mapInArrow(_search(block), own.schema)
    return own.select("doc_id", "regions")


def leaks(found: DataFrame) -> DataFrame:
    """Per document: contaminated, the number of regions, the items, and the fewest edits (null if clean)."""
    return found.select(
        "doc_id",
        (F.size("regions") > 0).alias("contaminated"),
        F.size("regions").cast("long").alias("n_regions"),
        F.array_sort(F.array_distinct("regions.item_id")).alias("items"),
        F.array_min("regions.edits").alias("least_edits"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, all columns, in which no benchmark passage is found."""
    ship(docs.sparkSession)
    kept = docs
    for block in item_blocks(benchmark):
        kept = kept.mapInArrow(_filter(block, "text"), docs.schema)
    return kept


def _filter(items: list[tuple[int, str]], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                clean = [next(index.regions(plain(t.as_py())), None) is None for t in part.column(part.schema.get_field_index(column))]
                yield part.filter(pa.array(clean, pa.bool_()))

    return run
