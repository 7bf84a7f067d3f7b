"""Toxicity of whole texts by a convolutional classifier over hashed word embeddings.

A word's vector is the sum of hashed vectors of itself and of its beginnings of
three lengths, so words made from a known stem are known. Filters of several
widths run over the words of a text; the strongest answer of each filter
anywhere in the text (max pooling) goes into a logistic unit. Trained in numpy
on a sample of labelled rows (bounds below); every text is scored whole. A
score depends on the text alone. Thresholds are then set for each language, from
histograms of the scores of all labelled rows that the model hasn't learnt from:
a language gets a cut of its own only where that makes fewer errors there than
the common threshold by more than chance would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import BATCH, Stage, tidy
from tallyhouse.session import conf

#: The sample: at most so many labelled rows, in hash order, and words of them.
ROWS, WORDS = 6000, 4_000_000
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
BEGINNINGS = (3, 4, 5)
PASSES, RATE, SHARE = 5, 0.05, 5
#: The common threshold, and by how many deviations a language's own must do better.
THRESHOLD, SURE = 0.3, 2.0
#: Bins of a histogram for each unit of the logit.
BINS = 32

_LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_WORD = np.arange(256, dtype=W.U)
_WORD[65:91] += W.U(32)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_buckets(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' buckets (words x 4), which of them each word is, and each text's first word."""
    found = W.find_words(chunk, _LETTERS)
    own, first, which = np.unique(W.hash_words(chunk, found, fold_case=True), return_index=True, return_inverse=True)
    starts, stops = found.starts[first], found.stops[first]
    kinds = [own]
    begun = np.zeros(len(own), dtype=W.U)
    for k in range(max(BEGINNINGS)):
        at = starts + k
        letter = _WORD[chunk.data[np.minimum(at, len(chunk.data) - 1)]] + W.U(1) if len(at) else begun
        begun = begun * W.U(257) + np.where(at < stops, letter, W.U(0))
        if k + 1 in BEGINNINGS:
            kinds.append(W.mix(begun + W.U(k + 1)))
    return (np.stack(kinds, axis=1) % W.U(BUCKETS)).astype(np.int32), which, found.first


@dataclass
class Model:
    embed: np.ndarray  # buckets x SIZE
    filters: list[np.ndarray]  # of each width: width x SIZE x FILTERS
    bias: np.ndarray  # widths x FILTERS
    out: np.ndarray  # widths * FILTERS, and a constant

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's word vectors (and two zero rows): each filter's strongest answer, and where."""
        places = max(1, len(x) - 2)
        best, where = [], []
        for kernel, bias in zip(self.filters, self.bias, strict=True):
            z = sum(x[k : k + places] @ kernel[k] for k in range(len(kernel)))
            at = z.argmax(axis=0)
            best.append(z[at, np.arange(FILTERS)] + bias)
            where.append(at)
        return np.maximum(np.concatenate(best), 0), np.stack(where)

    def scores(self, chunk: W.Chunk) -> np.ndarray:
        buckets, which, first = word_buckets(chunk)
        texts = len(first) - 1
        vectors = np.vstack([self.embed[buckets].sum(axis=1), np.zeros((1, SIZE), dtype=np.float32)])
        row = np.repeat(np.arange(texts), np.diff(first))
        line = np.full(len(which) + 2 * texts, len(vectors) - 1)
        line[np.arange(len(which)) + 2 * row] = which
        begin = first[:-1] + 2 * np.arange(texts)
        end = begin + np.maximum(1, np.diff(first))
        cuts = np.stack([begin, end], axis=1).ravel()
        pooled = []
        for kernel, bias in zip(self.filters, self.bias, strict=True):
            z = np.zeros((len(line) + 1, FILTERS), dtype=np.float32)
            for k in range(len(kernel)):
                z[: len(line) - k] += (vectors @ kernel[k])[line[k:]]
            pooled.append(np.maximum.reduceat(z, cuts, axis=0)[::2] + bias if texts else z[:0])
        logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def _evidence(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How far the toxic texts with a bucket exceed what chance gives, in standard errors."""
    hits = np.zeros((2, BUCKETS))
    for own, label in zip(texts, labels, strict=True):
        hits[int(label), np.unique(own)] += 1
    expected = hits.sum(axis=0) * labels.mean()
    return ((hits[1] - expected) / np.sqrt(expected + 1)).astype(np.float32)


def train(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """From texts as word buckets. The first number of a vector starts as evidence, all else small and random."""
    rng = np.random.default_rng(7)
    share = min(max(float(labels.mean()) if len(labels) else 0.0, 0.001), 0.999)
    model = Model(
        (rng.standard_normal((BUCKETS, SIZE)) * 0.02).astype(np.float32),
        [(rng.standard_normal((w, SIZE, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), dtype=np.float32),
        np.append(rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1, np.log(share / (1 - share))).astype(np.float32),
    )
    if not len(labels) or labels.min() == labels.max():
        model.out[:-1] = 0
        return model
    model.embed[:, 0] = np.clip(_evidence(texts, labels), -2, 10) / 10
    for kernel in model.filters:
        kernel[:, 0, :2] = 1.0
    squares = {k: np.ones_like(v) * 0.1 for k, v in (("embed", model.embed), ("bias", model.bias), ("out", model.out))}
    kernel_squares = [np.ones_like(k) * 0.1 for k in model.filters]

    def step(value: np.ndarray, square: np.ndarray, slope: np.ndarray) -> None:
        square += slope * slope
        value -= RATE * slope / np.sqrt(square)

    zero = np.zeros((2, SIZE), dtype=np.float32)
    for _ in range(PASSES):
        for i in rng.permutation(len(texts)):
            own = texts[i]
            x = np.vstack([model.embed[own].sum(axis=1), zero]) if len(own) else np.zeros((3, SIZE), dtype=np.float32)
            pooled, where = model.pooled(x)
            error = 1 / (1 + np.exp(-np.clip(pooled @ model.out[:-1] + model.out[-1], -40, 40))) - labels[i]
            back = (error * model.out[:-1] * (pooled > 0)).reshape(len(WIDTHS), FILTERS)
            step(model.out, squares["out"], np.append(error * pooled, error).astype(np.float32))
            step(model.bias, squares["bias"], back.astype(np.float32))
            for j, (kernel, at) in enumerate(zip(model.filters, where, strict=True)):
                for k in range(len(kernel)):
                    seen = x[at + k]  # FILTERS x SIZE
                    upward = back[j][:, None] * kernel[k].T
                    step(kernel[k], kernel_squares[j][k], (seen * back[j][:, None]).T)
                    for f in np.flatnonzero(back[j]):
                        if at[f] + k < len(own):
                            b = own[at[f] + k]
                            squares["embed"][b] += upward[f] ** 2
                            model.embed[b] -= RATE * upward[f] / np.sqrt(squares["embed"][b])
    return model


def _to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(_column(batch, "text")):
            buckets, which, first = word_buckets(chunk)
            texts = [buckets[which[a:b]].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [_column(batch, c).slice(chunk.rows.start, len(texts)) for c in ("place", "doc_id", "lang", "toxic")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], ["place", "doc_id", "lang", "toxic", "buckets"])


def _fold(column: str, folds: int) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def _known(labels: DataFrame, held_out_fold: int, folds: int) -> DataFrame:
    """(doc_id, toxic) of the training folds, a row per document."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(_fold("doc_id", folds) != held_out_fold)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, buckets) of ``ROWS`` labelled rows at most, in hash order, as one partition."""
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").dropna(subset=["doc_id"]).join(F.broadcast(chosen), "doc_id")
    made = rows.mapInArrow(tidy(_to_buckets), "place long, doc_id long, lang string, toxic int, buckets binary")
    size = (F.octet_length("buckets") / (4 * (len(BEGINNINGS) + 1))).cast("long")
    # A single text beyond the bound is left out of the sample.
    return made.filter(size <= WORDS // 20).orderBy("place", F.xxhash64("buckets")).limit(ROWS).select("doc_id", "toxic", "buckets").coalesce(1)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the sample, up to the bound on words: a model, and the documents that it has learnt from."""
    rows, words = [], 0
    for batch in batches:
        for doc_id, toxic, buckets in zip(*(_column(batch, c) for c in ("doc_id", "toxic", "buckets")), strict=True):
            if words <= WORDS:
                own = np.frombuffer(buckets.as_py(), dtype=np.int32).reshape(-1, len(BEGINNINGS) + 1)
                words += len(own)
                if words <= WORDS:
                    rows.append((doc_id.as_py(), toxic.as_py(), own))
    rows = [x for i, x in enumerate(rows) if i % SHARE]
    model = train([x for *_, x in rows], np.array([t for _, t, _ in rows], dtype=np.float64))
    parts = [model.embed, *model.filters, model.bias, model.out]
    made = [pa.array([[i for i, *_ in rows]], pa.list_(pa.int64())), pa.array([[x.tobytes() for x in parts]], pa.list_(pa.binary()))]
    yield pa.RecordBatch.from_arrays([*made, pa.array([[list(x.shape) for x in parts]], pa.list_(pa.list_(pa.int32())))], ["learnt", "parts", "shapes"])


def learnt(docs: DataFrame, known: DataFrame) -> tuple[Model, list[int]]:
    """The model and the documents that it has learnt from. Learnt in one task; the sample doesn't come to the driver."""
    # Some texts at a time go to the worker.
    with conf(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "200"}):
        got = _sample(docs, known).mapInArrow(tidy(_learn), "learnt array<long>, parts array<binary>, shapes array<array<int>>").first()
    if got is None:  # no row, no task
        return train([], np.zeros(0)), []
    embed, *filters, bias, out = (np.frombuffer(p, dtype=np.float32).reshape(s) for p, s in zip(got["parts"], got["shapes"], strict=True))
    return Model(embed, filters, bias, out), got["learnt"]


def histograms(docs: DataFrame, known: DataFrame, learnt: list[int], shared) -> DataFrame:
    """(lang, bin, toxic, n, low, high): rows not learnt from by bin of the score, of each language; null is none.

    Texts are scored where they lie; only ids and scores meet the labels. The
    common threshold lies between two bins.
    """
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text", "lang")
    shape = StructType([own.schema["row"], own.schema["lang"], StructField("score", DoubleType())])
    found = own.filter("row.doc_id is not null and lang is not null").mapInArrow(tidy(_run(shared, "score")), shape).select("row.doc_id", "lang", "score")
    seen = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(learnt))], "doc_id long")
    rest = found.join(known.join(F.broadcast(seen), "doc_id", "left_anti"), "doc_id")
    logit = F.coalesce(F.log(F.col("score") / (1 - F.col("score"))), F.lit(40.0))
    place = F.floor((logit - math.log(THRESHOLD / (1 - THRESHOLD))) * BINS)
    # Rounding must not put a score on the other side of the threshold.
    place = F.when(F.col("score") >= THRESHOLD, F.greatest(place, F.lit(0))).otherwise(F.least(place, F.lit(-1)))
    counts = rest.groupBy("lang", place.alias("bin"))
    return counts.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def threshold_of(bins: dict[int, list[float]]) -> float:
    """From [toxic rows, rows, least score, greatest score] by bin (0 begins at THRESHOLD): the middle of the cut with the fewest errors.

    THRESHOLD, unless that makes ``SURE`` deviations fewer. Of equal cuts the highest counts.
    """
    keys = sorted(bins, reverse=True)
    toxic, n, least, greatest = np.array([bins[k] for k in keys]).T
    errors = np.cumsum(n - toxic) + toxic.sum() - np.cumsum(toxic)
    at = sum(k >= 0 for k in keys)
    common = errors[at - 1] if at else toxic.sum()
    k = int(errors.argmin())
    if common - errors[k] <= SURE * math.sqrt(common + errors[k]):
        return THRESHOLD
    return float((least[k] + (greatest[k + 1] if k + 1 < len(n) else 0.0)) / 2)


def _limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of histograms, a language's rows together: the languages with a threshold of their own."""
    lang, bins = None, {}

    def made() -> Iterator[pa.RecordBatch]:
        own = threshold_of(bins) if bins else THRESHOLD
        if own != THRESHOLD:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([own])], ["lang", "threshold"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["lang"] != lang:
                yield from made()
                lang, bins = row["lang"], {}
            bins[row["bin"]] = [float(row[c]) for c in ("toxic", "n", "low", "high")]
    yield from made()


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, folds: int = 4) -> tuple[Model, DataFrame]:
    """The model, learnt from four fifths of the sample, and (lang, threshold): the languages with a threshold of their own.

    These are set on all other labelled rows of the training folds.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    known = _known(labels, held_out_fold, folds)
    model, seen = learnt(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bins = histograms(docs.filter(_fold("doc_id", folds) != held_out_fold), known, seen, shared)
    # A language has as many rows here as bins.
    with conf(docs.sparkSession, BATCH):
        return model, stage.put(bins.repartition("lang").sortWithinPartitions("lang").mapInArrow(_limits, "lang string, threshold double"))


def _run(shared, name: str = "toxicity"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.scores(chunk) for chunk in W.chunks(_column(batch, "text"))]
            made = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([_column(batch, "row"), _column(batch, "lang"), made], ["row", "lang", name])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, held_out_fold: int = 2, folds: int = 4) -> DataFrame:
    """(doc_id, text, lang, ...) and (doc_id, toxic, ...) -> a row per document of

    row (a struct of the columns to ``carry``: all if None), held_out, score (0 to 1), threshold (of the language), flagged (score at or
    above it). Learns from labelled rows whose crc32(doc_id as text) mod
    ``folds`` is not ``held_out_fold``; labels that are null or without a
    document are not used, of several for one document the greatest is. Null
    and empty texts get the score of a text without words. A null or unknown
    language has the threshold THRESHOLD. Without labels of both kinds all
    scores are the share of toxic labels. Rows that repeat a doc_id are scored
    one by one. Scored rows are staged with what they carry.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    model, limits = fit(docs.select("doc_id", text.alias("text"), lang.alias("lang")), labels, held_out_fold, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    own = docs.select(F.struct(*kept).alias("row"), text.alias("text"), lang.alias("lang"))
    shape = StructType([own.schema["row"], own.schema["lang"], StructField("toxicity", DoubleType())])
    # Staged, as the size of batches is that of the moment when a plan runs, and a caller's may run any time later.
    with conf(docs.sparkSession, BATCH):
        found = Stage(docs.sparkSession, "toxicity").put(own.mapInArrow(tidy(_run(shared)), shape))
    # A few languages at most differ: Spark broadcasts them, if they are as few as that.
    limits = limits.select(F.col("lang").alias("own_lang"), "threshold")
    limit = F.coalesce("threshold", F.lit(THRESHOLD))
    out = found.join(limits, F.col("lang") == F.col("own_lang"), "left").select("row", F.col("toxicity").alias("score"), limit.alias("threshold"))
    return out.select("row", (_fold("row.doc_id", folds) == held_out_fold).alias("held_out"), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
