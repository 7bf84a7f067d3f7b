"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Every token has a class. ``P(token | before) = P(class | before) * P(token | class)``.

* Classes. The ``TOP`` most frequent tokens are dealt by descending count to
  classes of about equal mass; all others, and tokens never seen, get one of
  ``RARE`` classes by a hash of their last two bytes. The end of a text has a
  class of its own.
* ``P(class | before)`` is a softmax over weights of three hashed features: the
  token before (bigram), the one before that (skip), and both (trigram).
  Training documents are dealt to learners by a hash of id and text, about
  ``SHARE`` tokens to each. A learner runs gradient steps over all its documents
  in the order of that hash, and steps end at the same tokens however the table
  is partitioned. Their weights are averaged by their number of tokens, in
  slices, each summed as it streams by. Buckets grow with the tokens learnt from.
* ``P(token | class)`` is (count + 1) / (tokens + types + 1) of the class.

Counts cover all training documents and are never cut. Only the top tokens (a
bounded number, cut at a count that a histogram gives) go out to the tasks; counts of all others are joined to the
documents that use them, where no token can be hot any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import Stage

TOP, CLASSES, RARE = 1 << 17, 32, 16
#: Tokens of a learner, and learners at most (beyond that, each gets more).
SHARE, LEARNERS = 1 << 22, 1 << 10
#: A histogram step of counts is a factor of 2 ** (1 / STEPS).
STEPS = 64
#: Tokens of a gradient step, its rate, and rows of weights in a slice.
STEP, RATE, SLICE = 1 << 14, 0.3, 512
END, BEGIN = W.U(0x5BF03635F0B7A54D), W.U(0x1CE4E5B9BF58476D)
END_CLASS, N_CLASSES = RARE + CLASSES, RARE + CLASSES + 1
#: Distinct tokens that a task counts before it passes them on.
HELD = 1 << 20


def bucket_bits(tokens: int) -> int:
    """Of a feature's buckets: 13 below 2 ** 27 tokens, one more with every 16 times as many, 16 at most.

    Gradient steps slow down where weights outgrow a core's cache.
    """
    return min(16, 13 + max(0, tokens.bit_length() - 24) // 4)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Tokens:
    """Tokens of a chunk, an end after each text, with rare classes and rows."""

    def __init__(self, chunk: W.Chunk):
        found = W.find_words(chunk)
        row = found.row
        n, texts = len(row), len(chunk.rows)
        words, ends = np.arange(n) + row, found.first[1:] + np.arange(texts)
        self.hash = np.empty(n + texts, dtype=W.U)
        self.hash[words], self.hash[ends] = W.hash_words(chunk, found, fold_case=True), END
        fold = np.arange(256, dtype=np.int64)
        fold[65:91] += 32
        last = fold[chunk.data[found.stops - 1]] * 256 + fold[chunk.data[np.maximum(found.stops - 2, found.starts)]]
        self.rare = np.full(n + texts, END_CLASS, dtype=np.uint8)
        self.rare[words] = W.mix(last.astype(W.U)) % W.U(RARE)
        self.first = found.first[:-1] + np.arange(texts)
        self.row = np.empty(n + texts, dtype=np.int64)
        self.row[words], self.row[ends] = row, np.arange(texts)

    def features(self, bits: int) -> np.ndarray:
        """Buckets of the three features of each token."""
        one, two = np.roll(self.hash, 1), np.roll(self.hash, 2)
        one[self.first] = two[self.first] = BEGIN
        second = self.first + 1
        second = second[second < len(two)]
        at = second[self.row[second] == self.row[second - 1]]
        two[at] = BEGIN
        shift = W.U(64 - bits)
        both = (one * W.U(0x9E3779B97F4A7C15)) ^ (two * W.U(0xC2B2AE3D27D4EB4F))
        made = (one * W.U(0xD6E8FEB86659FD93), two * W.U(0xA0761D6478BD642F), W.mix(both))
        return np.stack([(x >> shift).astype(np.uint16) for x in made])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, count, rare = (np.concatenate(x) for x in zip(*held, strict=True))
        own, first, back = np.unique(token, return_index=True, return_inverse=True)
        return own, np.bincount(back, weights=count).astype(np.int64), rare[first]

    def out() -> pa.RecordBatch:
        token, count, rare = merged()
        return pa.RecordBatch.from_arrays([W.signed(token), pa.array(count), pa.array(rare.astype(np.int32))], ["token", "count", "rare"])

    for batch in batches:
        for chunk in W.chunks(_column(batch, "text")):
            tokens = Tokens(chunk)
            own, first, count = np.unique(tokens.hash, return_index=True, return_counts=True)
            held.append((own, count, tokens.rare[first]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield out()
                    held = []
    if held:
        yield out()


@dataclass
class Vocabulary:
    """The top tokens (by hash), their counts and classes, and totals of all classes."""

    token: np.ndarray
    count: np.ndarray
    kind: np.ndarray
    tokens_of: np.ndarray
    types_of: np.ndarray
    total: int
    types: int

    def look_up(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class, and its count if it is a top token, else -1."""
        if not len(self.token):
            return tokens.rare, np.full(len(tokens.hash), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.token, tokens.hash), len(self.token) - 1)
        top = self.token[place] == tokens.hash
        return np.where(top, self.kind[place], tokens.rare), np.where(top, self.count[place], -1)


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """From (token, count, rare): ``TOP`` rows at most, whole counts, and sums come to the driver."""
    all_of = counts.agg(F.sum("count").alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("count") * STEPS)
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    kept, cut = 0, None
    for row in sizes:
        kept += row["count"]
        if kept > TOP:
            break
        cut = row["step"]
    frequent = step >= (cut if cut is not None else sizes[0]["step"] + 1 if sizes else 0)
    top = counts.filter(frequent).select("token", "count").orderBy(F.desc("count"), "token").toPandas()
    token, count = top["token"].to_numpy().astype(np.int64).view(W.U), top["count"].to_numpy().astype(np.int64)
    mass = np.cumsum(count) - count
    kind = RARE + np.minimum(mass * CLASSES // max(1, count.sum()), CLASSES - 1)
    kind[token == END] = END_CLASS
    tokens_of = np.bincount(kind, weights=count, minlength=N_CLASSES)
    types_of = np.bincount(kind, minlength=N_CLASSES).astype(float)
    for row in counts.filter(~frequent).groupBy("rare").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect():
        tokens_of[row["rare"]] += row["n"]
        types_of[row["rare"]] += row["v"]
    order = np.argsort(token)
    return Vocabulary(token[order], count[order], kind[order].astype(np.uint8), tokens_of, types_of, int(all_of["n"] or 0), int(all_of["v"]))


def prior(vocabulary: Vocabulary) -> np.ndarray:
    share = vocabulary.tokens_of + 1
    return np.log(share / share.sum()).astype(np.float32)


def _logits(bias: np.ndarray, weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = bias + weights[0][features[0]]
    out += weights[1][features[1]]
    out += weights[2][features[2]]
    out -= out.max(axis=1, keepdims=True)
    return out


def _descend(bias: np.ndarray, weights: np.ndarray, square: np.ndarray, features: np.ndarray, kind: np.ndarray) -> None:
    """A gradient step over some tokens; each weight has its own rate."""
    error = np.exp(_logits(bias, weights, features))
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(kind)), kind] -= 1
    for w, s, f in zip(weights, square, features, strict=True):
        order = np.argsort(f, kind="stable")
        own, first = np.unique(f[order], return_index=True)
        slope = np.add.reduceat(error[order], first, axis=0)
        s[own] += slope * slope
        w[own] -= RATE * slope / (np.sqrt(s[own]) + 1)


class Learner:
    """Gradient steps of ``STEP`` tokens each over a stream of texts."""

    def __init__(self, vocabulary: Vocabulary, bits: int, start: np.ndarray | None):
        self.vocabulary, self.bits, self.bias = vocabulary, bits, prior(vocabulary)
        self.weights = np.zeros((3, 1 << bits, N_CLASSES), dtype=np.float32) if start is None else start.copy()
        self.square, self.seen = np.zeros_like(self.weights), 0
        self.features, self.kind = np.zeros((3, 0), np.uint16), np.zeros(0, np.uint8)

    def read(self, chunk: W.Chunk) -> None:
        tokens = Tokens(chunk)
        kind, features = self.vocabulary.look_up(tokens)[0], tokens.features(self.bits)
        self.seen += len(kind)
        self.kind, self.features = np.concatenate([self.kind, kind]), np.concatenate([self.features, features], axis=1)
        whole = len(self.kind) // STEP * STEP
        self._descend(whole)
        self.kind, self.features = self.kind[whole:], self.features[:, whole:]

    def _descend(self, tokens: int) -> None:
        for low in range(0, tokens, STEP):
            _descend(self.bias, self.weights, self.square, self.features[:, low : low + STEP], self.kind[low : low + STEP])

    def slices(self) -> Iterator[pa.RecordBatch]:
        self._descend(len(self.kind))
        flat = self.weights.reshape(-1, SLICE * N_CLASSES)
        for low in range(0, len(flat), 8):
            part = flat[low : low + 8]
            columns = [pa.array(range(low, low + len(part)), pa.int32()), pa.array([self.seen] * len(part), pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "seen", "weights"])


def _train(shared, bits: int, start: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, number = None, None
        for batch in batches:
            numbers = _column(batch, "learner").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if first == last:
                    continue
                if numbers[first] != number:
                    if learner is not None:
                        yield from learner.slices()
                    learner, number = Learner(shared.value, bits, start), numbers[first]
                for chunk in W.chunks(_column(batch, "text").slice(first, last - first)):
                    learner.read(chunk)
        if learner is not None:
            yield from learner.slices()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what streams by, a slice at a time kept per task."""
    total: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for part, n, own in zip(*(batch.column(i) for i in range(3)), strict=True):
            k, n = part.as_py(), n.as_py()
            total[k] = total.get(k, 0) + np.frombuffer(own.as_buffer(), dtype=np.float32).astype(np.float64) * n
            seen[k] = seen.get(k, 0) + n
    for k, own in total.items():
        mean = (own / seen[k]).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen[k]], pa.int64()), pa.array([mean], pa.binary())], ["slice", "seen", "weights"])


def _fit(train: DataFrame, shared, rounds: int) -> np.ndarray:
    total = shared.value.total
    bits, learners = bucket_bits(total), max(1, min(LEARNERS, -(-total // SHARE)))
    order = F.xxhash64("doc_id", "text")
    dealt = train.select(F.pmod(order, F.lit(learners)).cast("int").alias("learner"), order.alias("place"), "text")
    dealt = dealt.repartition(learners, "learner").sortWithinPartitions("learner", "place").select("learner", "text")
    weights, shape, slices = None, "slice int, seen long, weights binary", (3 << bits) // SLICE
    for _ in range(rounds):
        parts = dealt.mapInArrow(_train(shared, bits, weights), shape).repartition(slices, "slice")
        new = np.zeros((slices, SLICE * N_CLASSES), dtype=np.float32)
        for row in parts.mapInArrow(_average, shape).collect():
            new[row["slice"]] = np.frombuffer(row["weights"], dtype=np.float32)
        weights = new.reshape(3, 1 << bits, N_CLASSES)
    return weights


def _score(shared, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value, model.value
        bias, whole = prior(vocabulary), np.log10(vocabulary.total + vocabulary.types + 1)
        bits = weights.shape[1].bit_length() - 1
        inside = np.log10(vocabulary.tokens_of + vocabulary.types_of + 1)
        for batch in batches:
            for chunk in W.chunks(_column(batch, "text")):
                tokens, texts = Tokens(chunk), len(chunk.rows)
                (kind, count), features = vocabulary.look_up(tokens), tokens.features(bits)
                choice = np.empty(len(kind))
                for low in range(0, len(kind), STEP):
                    logits = _logits(bias, weights, features[:, low : low + STEP])
                    own = kind[low : low + STEP]
                    choice[low : low + STEP] = logits[np.arange(len(own)), own] - np.log(np.exp(logits).sum(axis=1))
                choice = choice / np.log(10) - inside[kind]
                counted = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                sums = [np.bincount(tokens.row, weights=x, minlength=texts) for x in (counted, choice, count >= 0)]
                size = np.bincount(tokens.row, minlength=texts)
                rare = np.flatnonzero(count < 0)
                order = rare[np.lexsort((tokens.hash[rare], tokens.row[rare]))]
                row, token = tokens.row[order], tokens.hash[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])])) if len(order) else order
                times = np.diff(np.append(new, len(order)))
                each = np.bincount(row[new], minlength=texts)
                columns = [
                    *(_column(batch, c).slice(chunk.rows.start, texts) for c in ("doc_id", "held_out")),
                    pa.array(size.astype(np.int64)),
                    pa.array(sums[2].astype(np.int64)),
                    pa.array(sums[0]),
                    pa.array(-whole * size),
                    pa.array(sums[1]),
                    W.lists(W.signed(token[new]), each),
                    W.lists(pa.array(times.astype(np.int32)), each),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "top_known", "counted", "base", "choice", "token", "times"])

    return run


def scored(docs: DataFrame, held_out_fold: int = 2, folds: int = 7, rounds: int = 1) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    Learns from documents whose crc32(doc_id as text) mod ``folds`` is not
    ``held_out_fold`` (a null doc_id counts as an empty text). Scores are log10
    probabilities. A null text is empty; an empty text is its end alone. Rows
    that repeat a doc_id count each. Other columns are not read. With nothing
    to learn from, all counts are 0.
    """
    stage = Stage(docs.sparkSession, "maxent-lm")
    context = docs.sparkSession.sparkContext
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold == held_out_fold).alias("held_out"))
    train = docs.filter(~F.col("held_out")).select("doc_id", "text")
    counts = train.mapInArrow(_count, "token long, count long, rare int").groupBy("token", "rare").agg(F.sum("count").alias("count"))
    counts = stage.put(counts)
    vocabulary = _vocabulary(counts)
    shared = context.broadcast(vocabulary)
    model = context.broadcast(_fit(train, shared, rounds))
    shape = "doc_id long, held_out boolean, n_tokens long, top_known long, counted double, base double, choice double, token array<long>, times array<int>"
    parts = stage.put(docs.mapInArrow(_score(shared, model), shape).withColumn("row", F.monotonically_increasing_id()))
    used = parts.select("row", F.explode(F.arrays_zip("token", "times")).alias("rare")).select("row", "rare.token", "rare.times")
    rest = used.join(counts.select("token", "count"), "token").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("more"), F.sum("times").alias("known"))
    more = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return parts.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("top_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("choice") + more).alias("score"),
    )
