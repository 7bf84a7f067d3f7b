"""Substring dedup: seed on winnowed anchors, extend both ways, cut maximal repeats.

A window is ``min_words`` consecutive words of one document. Every word that
lies in a window whose word sequence also starts in a document with a smaller
id is removed.

* Seeds. Each window picks the least-hash run of ``SEED`` words in it (the
  rightmost of equals), its anchor. Equal windows pick equal anchors, so only
  windows with the same anchor need comparing. Neighbouring windows mostly
  share their anchor; such a block, from the first word of its first window to
  the last word of its last one, is the anchor with its greatest extension.
* Extend. Blocks are grouped by (anchor, content), keeping the smallest
  document: all other copies are repeats as a whole. Where documents agree on
  an anchor but not on the whole block, the extension is settled window by
  window, again as a minimum per (anchor, window content).
* Cut. Each document gets the blocks and windows it owns; every other window of
  it is a repeat. Adjoining repeats merge to maximal ones.

Both groupings are minima that combine before the shuffle: a passage in a third
of all documents costs one row per task, and no group of copies is gathered or
joined with itself. What a document owns is bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import Stage

SEED = 12
#: Words of one document handled at once.
SLICE = 1 << 20


class _Blocks:
    """Windows of a chunk and the blocks they form, row by row."""

    def __init__(self, chunk: W.Chunk, min_words: int):
        found = W.find_words(chunk)
        hashes, seed = W.hash_words(chunk, found), min(SEED, min_words)
        counts = found.counts
        self.found, self.n_words = found, counts
        starts, picks, seeds = [], [], []
        for low in range(0, max(1, len(hashes) - min_words + 1), SLICE):
            part = hashes[low : low + SLICE + min_words - 1]
            if len(part) < min_words:
                break
            at = np.arange(len(part) - seed + 1)
            own = W.hash_runs(part, at, at + seed)
            order = (own & ~W.U(0xFFFFFF)) | (W.U(0xFFFFFF) - at.astype(W.U))
            least = W.sliding_min(order, min_words - seed + 1)
            picks.append((W.U(0xFFFFFF) - (least & W.U(0xFFFFFF))).astype(np.int64) + low)
            seeds.append(own[: len(least)] if low + SLICE < len(hashes) - min_words + 1 else own)
            starts.append(np.arange(len(least)) + low)
        self.hashes = hashes
        if not starts:
            starts, picks, seeds = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=W.U)]
        start, pick, own = np.concatenate(starts), np.concatenate(picks), np.concatenate(seeds)
        row = found.row
        fits = row[start] == row[start + min_words - 1]
        start, pick = start[fits], pick[fits]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(start))[: len(heads)] - 1
        self.start, self.row, self.block = start, row[start], np.cumsum(new) - 1
        self.anchor = W.mix(own[pick[heads]])
        content = W.hash_runs(hashes, start[heads], start[tails] + min_words)
        self.key = W.mix(content ^ W.mix(self.anchor + (pick[heads] - start[heads]).astype(W.U)))
        self.block_row = self.row[heads]

    def windows(self, chosen: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Which windows lie in the chosen blocks, and a hash of each."""
        at = np.flatnonzero(chosen[self.block]) if len(self.block) else np.zeros(0, dtype=np.int64)
        return at, W.hash_runs(self.hashes, self.start[at], self.start[at] + min_words)


def _tag(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key ^ W.mix(row.astype(W.U) + W.U(1))


def _lists(column: pa.Array, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """Rows (from 0) and values of a list column."""
    part = column.slice(rows.start, len(rows))
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(rows)), sizes), part.flatten().to_numpy(zero_copy_only=False).view(W.U)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _seed(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _column(batch, "doc_id").to_numpy(zero_copy_only=False)
            for chunk in W.chunks(_column(batch, "text")):
                found = _Blocks(chunk, min_words)
                doc = pa.array(ids[chunk.rows.start : chunk.rows.stop][found.block_row])
                yield pa.RecordBatch.from_arrays([W.signed(found.anchor), W.signed(found.key), doc], ["anchor", "block", "doc"])

    return run


def _extend(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _column(batch, "doc_id").to_numpy(zero_copy_only=False)
            for chunk in W.chunks(_column(batch, "text")):
                found = _Blocks(chunk, min_words)
                chosen = np.isin(_tag(found.block_row, found.key), _tag(*_lists(_column(batch, "open"), chunk.rows)))
                at, content = found.windows(chosen, min_words)
                doc = pa.array(ids[chunk.rows.start : chunk.rows.stop][found.row[at]])
                yield pa.RecordBatch.from_arrays([W.signed(found.anchor[found.block[at]]), W.signed(content), doc], ["anchor", "block", "doc"])

    return run


def _cut(min_words: int, layout: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _column(batch, "doc_id")
            for chunk in W.chunks(_column(batch, "text")):
                rows = chunk.rows
                found = _Blocks(chunk, min_words)
                own = _tag(found.block_row, found.key)
                sure = np.isin(own, _tag(*_lists(_column(batch, "sure"), rows)))
                chosen = np.isin(own, _tag(*_lists(_column(batch, "open"), rows)))
                repeat = ~sure[found.block] if len(found.block) else np.zeros(0, dtype=bool)
                at, content = found.windows(chosen, min_words)
                repeat[at] = ~np.isin(_tag(found.row[at], content), _tag(*_lists(_column(batch, "kept"), rows)))
                no_id = ids.slice(rows.start, len(rows)).is_null().to_numpy(zero_copy_only=False)
                repeat &= ~no_id[found.row]
                edge = np.zeros(len(found.hashes) + 1, dtype=np.int64)
                np.add.at(edge, found.start[repeat], 1)
                np.add.at(edge, found.start[repeat] + min_words, -1)
                gone = np.cumsum(edge)[:-1] > 0
                yield _cut_rows(batch, chunk, found, gone, layout)

    return run


def _cut_rows(batch: pa.RecordBatch, chunk: W.Chunk, found: _Blocks, gone: np.ndarray, layout: bool) -> pa.RecordBatch:
    first, data = found.found.first, chunk.data.tobytes()
    texts, removed, spans = [], [], []
    for i in range(len(chunk.rows)):
        own = gone[first[i] : first[i + 1]]
        text, count = data[chunk.offsets[i] : chunk.offsets[i + 1]], int(own.sum())
        if count or not layout:
            parts = text.split()
            text = b" ".join(compress(parts, (~own).tolist()) if count else parts)
        texts.append(text.decode())
        removed.append(count)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) if count else []
        spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    made = [pa.array(found.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)]
    part = batch.slice(chunk.rows.start, len(chunk.rows))
    return pa.RecordBatch.from_arrays([_column(part, x) for x in ("doc_id", "row")] + made, ["doc_id", "row", "n_words", "n_removed", "kept_text", "repeats"])


def cut_repeats(docs: DataFrame, min_words: int = 50, keep_layout: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, row, n_words, n_removed, kept_text, repeats).

    ``row`` holds the other columns as a struct; ``repeats`` are the maximal
    spans of removed words, ``[start, stop)``; ``kept_text`` is the kept words
    joined by one space; with ``keep_layout``, the text as it was where no word
    is removed.

    A null or empty text has no words. Texts shorter than ``min_words`` are
    whole. A row with a null doc_id neither loses words nor makes others lose
    them. Rows that repeat a doc_id do not remove words from each other: only a
    smaller id does. An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "substring-dedup")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("row"))
    known, hit = docs.filter("doc_id is not null").select("doc_id", "text"), "anchor long, block long, doc long"
    blocks = stage.put(known.mapInArrow(_seed(min_words), hit).groupBy("anchor", "block").agg(F.min("doc").alias("doc")))
    unsettled = stage.put(blocks.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("anchor", F.lit(True).alias("split")))
    owned = stage.put(
        blocks.join(unsettled, "anchor", "left")
        .groupBy("doc")
        .agg(F.collect_list(F.when(F.col("split").isNull(), F.col("block"))).alias("sure"), F.collect_list(F.when(F.col("split"), F.col("block"))).alias("open"))
        .withColumnRenamed("doc", "doc_id")
    )
    stage.drop(blocks)
    probed = known.join(owned.filter(F.size("open") > 0).select("doc_id", "open"), "doc_id")
    kept = stage.put(
        probed.mapInArrow(_extend(min_words), hit)
        .groupBy("anchor", "block")
        .agg(F.min("doc").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("block").alias("kept"))
    )
    whole = docs.join(owned, "doc_id", "left").join(kept, "doc_id", "left")
    made = StructType.fromDDL("n_words long, n_removed long, kept_text string, repeats array<struct<start:long,stop:long>>")
    shape = StructType([docs.schema["doc_id"], docs.schema["row"], *made])
    return whole.mapInArrow(_cut(min_words, keep_layout), shape)
