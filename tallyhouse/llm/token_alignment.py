"""Alignment of two tokenizers' tokens over the same texts, by byte offsets.

Both sides' tokens lie end to end over the bytes of a text (a space and the
text). In a batch, texts lie end to end too, so a byte's place in the batch is a
key of its document and its offset at once. ``pandas.merge_asof`` finds for each
token's start the other side's token that covers it; both directions together
are all overlapping pairs. Where tokens of both sides end, a group ends.

Encoding: neither side's tokens cross the start of a run of spaces (the split
pattern of one side cuts there; no piece of the other holds a space behind
another sign). So a worker keeps stretches (spaces and what follows) with their
ids, and texts of plain signs are put together from these. The libraries encode
new stretches, many at a time (where ids are ranks of merges, the library for
ranks, which is faster and gives the same), and all other texts whole.

Counts over the corpus: each task sums the documents of each pair of ids before
the shuffle. The most frequent pairs (``HEAD`` at most, cut at a count read
from a histogram) go out to the tasks; the others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.bpe_automaton import PLAIN, byte_signs
from tallyhouse.llm.staging import Stage
from tallyhouse.session import conf

#: Pairs whose counts go out to the tasks, at most.
HEAD = 1 << 17
#: Tokens (both sides) aligned at once, unless one text has more; pairs a task keeps before it passes them on.
SLICE, HELD = 1 << 19, 1 << 20
#: A histogram step is a factor of 2 ** (1 / STEPS).
STEPS = 16
NONE = np.zeros(0, np.int32)
#: Ids take more room than texts: rows that go to a worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_DIGITS: list[np.ndarray] = [NONE, NONE]

#: Stretches that a worker keeps per generation, and the letters of one that it keeps at most; letters encoded at once.
KEPT, KEPT_LETTERS, AT_ONCE = 1 << 17, 48, 1 << 15

# The split pattern of the byte-level vocabulary's pre-tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STRETCH = re.compile(" +[^ ]*")
#: Other white space before two spaces: the first side's pattern has them in one piece.
_MIXED = re.compile("[\t\n\r]  ")
_LOADED: dict[int, Encoder] = {}


class Side:
    """One tokenizer: a text with a space in front to ids."""

    def __init__(self, encode, spelled: list[bytes], encode_plain=None):
        self.encode, self.encode_plain, self.spelled = encode, encode_plain or encode, spelled
        self.length = np.array([len(x) for x in spelled], np.int64)

    def ids(self, text: str, plain: bool = False) -> np.ndarray | None:
        """None if the tokens don't spell the text."""
        ids = (self.encode_plain if plain else self.encode)(text)
        spells = b"".join([self.spelled[i] for i in ids]) == text.encode()
        return np.array(ids, np.int32) if spells else None

    def pieces(self, stretches: list[str]) -> list[bytes | None]:
        """The ids of each, as bytes, from one call for all."""
        ids = self.ids("".join(stretches), plain=True)
        ends = np.cumsum([len(x.encode()) for x in stretches])
        if ids is not None:
            stops = np.searchsorted(np.cumsum(self.length[ids]), ends) + 1
            if (np.cumsum(self.length[ids])[stops - 1] == ends).all():
                data, stops = ids.tobytes(), [0, *(4 * stops).tolist()]
                return [data[i:j] for i, j in zip(stops[:-1], stops[1:], strict=True)]
        each = [self.ids(x) for x in stretches]
        return [None if x is None else x.tobytes() for x in each]


class Encoder:
    """Both tokenizers, and the stretches met last with their ids of both sides."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(definition)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        value = {sign: byte for byte, sign in enumerate(byte_signs())}
        spelled = [b""] * (max(a.get_vocab().values(), default=-1) + 1)
        for sign, i in a.get_vocab().items():
            spelled[i] = bytes(value[s] for s in sign) if all(s in value for s in sign) else b""
        b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        batch = getattr(a, "encode_batch_fast", a.encode_batch)  # without offsets
        self.sides = (
            Side(lambda text: batch([text], add_special_tokens=False)[0].ids, spelled),
            # The model adds the space itself.
            Side(lambda text: list(b.encode(text[1:])), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]),
        )
        known = json.loads(definition)
        split = known["pre_tokenizer"] or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not known.get("normalizer")
        self.cuts = usual and not any("▁" in p.lstrip("▁") for p in pieces)
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in known["model"]["merges"]]
        numbers = known["model"]["vocab"]
        if usual and [numbers[m] for m in merges] == list(range(256, 256 + len(merges))) and set(range(256)) == {numbers[s] for s in value}:
            # Ids follow the merges, so they are ranks, which the faster library takes.
            import tiktoken

            ranks = {spelled[i]: i for i in range(256 + len(merges))}
            self.sides[0].encode_plain = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def known(self, needed: set[str]) -> dict[str, tuple]:
        known, new = {}, []
        for stretch in needed:
            ids = self.kept.get(stretch)
            if ids is None and (ids := self.old.get(stretch)) is not None:
                self.kept[stretch] = ids
            if ids is None:
                new.append(stretch)
            else:
                known[stretch] = ids
        first = 0
        while first < len(new):
            last, letters = first, 0
            while last < len(new) and letters < AT_ONCE:
                letters += len(new[last])
                last += 1
            part = new[first:last]
            for stretch, ids in zip(part, zip(*(side.pieces(part) for side in self.sides), strict=True), strict=True):
                known[stretch] = ids
                if len(stretch) <= KEPT_LETTERS:
                    self.kept[stretch] = ids
            first = last
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        return known

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text (a space in front); none if either side's tokens don't spell it."""
        split = [_STRETCH.findall(t) if self.cuts and PLAIN.fullmatch(t) and not _MIXED.search(t) else None for t in texts]
        known = self.known({x for own in split if own for x in own})
        out = []
        for text, own in zip(texts, split, strict=True):
            made = None
            if len(text) == 1:
                made = NONE, NONE
            elif own is not None:
                both = [known[x] for x in own]
                try:
                    made = tuple(np.frombuffer(b"".join([x[side] for x in both]), np.int32) for side in (0, 1))
                except TypeError:  # some stretch isn't spelled by its own tokens
                    made = None
            if made is None:
                made = tuple(side.ids(text) for side in self.sides)
                made = (NONE, NONE) if made[0] is None or made[1] is None else made
            out.append(made)
        return out


def encoder(files: tuple[str, bytes]) -> Encoder:
    """Loaded once per Python worker."""
    key = hash(files)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(*files)
    return _LOADED[key]


def _encode(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(files.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in W.chunks(batch.column(batch.schema.get_field_index("text"))):
                data = chunk.data.tobytes()
                made = both.ids([" " + data[i:j].decode() for i, j in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)])
                columns = [W.lists(pa.array(np.concatenate([NONE, *m])), np.array([len(x) for x in m])) for m in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.rows.start, len(chunk.rows)), *columns], ["doc_id", "a", "b"])

    return run


class Aligned:
    """Some documents' tokens of both sides: links between them, and groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b, self.count_a, self.count_b = a, b, count_a, count_b
        self.doc_a = np.repeat(np.arange(len(count_a)), count_a)
        end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        left = pd.DataFrame({"at": end_a - length_a[a], "a": np.arange(len(a))})
        right = pd.DataFrame({"at": end_b - length_b[b], "b": np.arange(len(b))})
        covering_b = pd.merge_asof(left, right, on="at")["b"].to_numpy(np.int64)
        covering_a = pd.merge_asof(right, left, on="at")["a"].to_numpy(np.int64)
        start_a, start_b = left["at"].to_numpy(), right["at"].to_numpy()
        together_a, together_b = start_b[covering_b] == start_a, start_a[covering_a] == start_b
        # Where both start together, both directions find the same pair.
        self.link_a = np.concatenate([np.arange(len(a)), covering_a[~together_b]])
        self.link_b = np.concatenate([covering_b, np.flatnonzero(~together_b)])
        # Tokens end together where the next ones start together, and at the end of a text.
        self.cut_a, self.cut_b = np.append(together_a[1:], True)[: len(a)], np.append(together_b[1:], True)[: len(b)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each link's document and pair of ids, as one number."""
        code = (self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b]
        return self.doc_a[self.link_a], code

    def groups(self) -> np.ndarray:
        return np.bincount(self.doc_a, weights=self.cut_a, minlength=len(self.count_a)).astype(np.int64)

    def texts(self) -> list[bytes]:
        """Each document's groups in writing: ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a) + len(self.b)
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b))])
        until_a = np.cumsum(np.bincount(group_a))
        place_a = np.arange(len(self.a)) + before_b[group_a] if n else np.zeros(0, int)
        place_b = np.arange(len(self.b)) + until_a[group_b] if n else np.zeros(0, int)
        ids, sign = np.empty(n, np.int32), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
        sign[place_a[last_a]], sign[place_b[self.cut_b]] = ord("|"), ord(";")
        digits, cells = _decimals(int(ids.max(initial=0)) + 1)
        size, cell = digits[ids], cells[ids]
        cell[np.arange(n), size] = sign
        out = cell[np.arange(cell.shape[1]) <= size[:, None]]
        ends = np.cumsum(size.astype(np.int64) + 1)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.count_a + self.count_b)])]
        whole = out.tobytes()
        return [whole[i : max(i, j - 1)] for i, j in zip(stops[:-1], stops[1:], strict=True)]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the numbers below ``n``: how many digits, and the digits with room for a sign behind."""
    if len(_DIGITS[0]) < n:
        size = 1 << n.bit_length()
        text = [str(i).encode() for i in range(size)]
        width = len(text[-1]) + 1
        _DIGITS[:] = np.array([len(t) for t in text], np.int8), np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(size, width)
    return _DIGITS[0], _DIGITS[1]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), ends


def _aligned(batch: pa.RecordBatch, length_a: np.ndarray, length_b: np.ndarray) -> Iterator[tuple[int, Aligned]]:
    """A batch of encoded documents in slices: the first row of each, and its tokens aligned."""
    (a, at_a), (b, at_b) = (_lists(batch.column(batch.schema.get_field_index(c))) for c in "ab")
    both, first = at_a + at_b.astype(np.int64), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(both, both[first] + SLICE, side="right")) - 1)
        own_a, own_b = at_a[first : last + 1], at_b[first : last + 1]
        yield first, Aligned(a[own_a[0] : own_a[-1]], b[own_b[0] : own_b[-1]], np.diff(own_a), np.diff(own_b), length_a, length_b)
        first = last


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def _count(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [s.length for s in encoder(files.value).sides]
        codes, counts, held = [], [], 0

        def rows() -> pa.RecordBatch:
            code, count = _summed(codes, counts)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "c"])

        for batch in batches:
            for _, part in _aligned(batch, *lengths):
                doc, code = part.pairs()
                at, known = pd.factorize(code)
                each = np.unique(doc * len(known) + at) % len(known) if len(known) else at
                codes.append(known)
                counts.append(np.bincount(each, minlength=len(known)))
                held += len(known)
                if held > HELD:
                    code, count = _summed(codes, counts)
                    codes[:], counts[:], held = [code], [count], len(code)
                    if held > HELD // 2:
                        yield rows()
                        codes[:], counts[:], held = [], [], 0
        if codes:
            yield rows()

    return run


def _report(files, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [s.length for s in encoder(files.value).sides]
        head, head_count, best = shared.value
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id")]
            for first, part in _aligned(batch, *lengths):
                n = len(part.count_a)
                doc, code = part.pairs()
                at, known = pd.factorize(code)
                place = np.minimum(np.searchsorted(head, known), max(len(head) - 1, 0))
                has = head[place] == known if len(head) else np.zeros(len(known), bool)
                count = np.where(has, head_count[place], 0) if len(head) else np.zeros(len(known), np.int64)
                is_best = has & (count == best[known >> 32])
                sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, doc, count[at])
                np.add.at(bests, doc, is_best[at].astype(np.int64))
                rare = ~has[at]
                rest, many = np.unique(doc[rare] * max(len(known), 1) + at[rare], return_counts=True)
                rest_doc, rest_code = rest // max(len(known), 1), known[rest % max(len(known), 1)] if len(rest) else rest
                texts = part.texts()
                made = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                pairs = pa.StructArray.from_arrays([pa.array(rest_code, pa.int64()), pa.array(many, pa.int64())], ["code", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.slice(first, n) for k in keys),
                        *(pa.array(x, pa.int64()) for x in (part.count_a, part.count_b, part.groups(), np.bincount(doc, minlength=n), bests, sums)),
                        pa.array(made),
                        W.lists(pairs, np.bincount(rest_doc, minlength=n)),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"],
                )

    return run


class Alignment:
    """Documents encoded by two tokenizers, kept as staged tables.

    ``encoded``: (row, doc_id, a, b), ids of both sides per document.
    ``counts``: (code, a, b, c), how many documents hold a pair of ids linked.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
            self.files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
        self.stage = Stage(docs.sparkSession, "token-alignment")
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        made = own.mapInArrow(_encode(self.files), "doc_id long, a array<int>, b array<int>")
        # Written once, so the numbers stay as they are in all later steps.
        self.encoded = self.put(made.withColumn("row", F.monotonically_increasing_id()))
        found = self.encoded.select("a", "b").mapInArrow(_count(self.files), "code long, c long")
        summed = found.groupBy("code").agg(F.sum("c").alias("c"))
        self.counts = self.put(summed.select("code", F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "c"))

    def put(self, rows: DataFrame) -> DataFrame:
        with conf(rows.sparkSession, BATCH):
            return self.stage.put(rows)

    def _cut(self, size: int) -> int:
        """The least step of counts such that no more than ``size`` pairs lie at or above it."""
        steps = self.counts.groupBy(F.floor(F.log2("c") * STEPS).alias("step")).count().orderBy(F.desc("step")).collect()
        total, cut = 0, 1 << 20
        for row in steps:
            total += row["count"]
            if total > size:
                break
            cut = row["step"]
        return cut

    def report(self, head: int = HEAD) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per document."""
        spark = self.encoded.sparkSession
        frequent = F.floor(F.log2("c") * STEPS) >= self._cut(head)
        known = self.counts.filter(frequent).select("code", "c").orderBy("code").toPandas()
        most = self.counts.groupBy("a").agg(F.max("c").alias("most"))
        top = most.toPandas()  # a row per id of the vocabulary
        best = np.zeros(int(top["a"].max()) + 1 if len(top) else 1, np.int64)
        best[top["a"].to_numpy(np.int64)] = top["most"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["c"].to_numpy(np.int64), best))
        shape = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<code:long,n:long>>"
        made = self.put(self.encoded.mapInArrow(_report(self.files, shared), shape))
        rare = self.counts.filter(~frequent).join(most, "a").select("code", "c", (F.col("c") == F.col("most")).alias("is_best"))
        rest = made.select("row", F.explode("rest").alias("r")).select("row", "r.code", "r.n").join(rare, "code")
        rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("c")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("more_best"))
        out = made.drop("rest").join(rest, "row", "left")
        added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more"), "groups_sha256")

    def links(self) -> DataFrame:
        """(a, b, c, share): ids linked in ``c`` documents, and ``c`` over the most that ``a`` has."""
        most = self.counts.groupBy("a").agg(F.max("c").alias("most"))
        return self.counts.join(most, "a").select("a", "b", "c", (F.col("c") / F.col("most")).alias("share"))


def align(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row.

    ``path_a`` is a byte-level tokenizer file, encoding a space and the text;
    ``path_b`` a piece model that adds the space itself. Both are read on the
    driver and go out to the tasks, their size bounded by the vocabularies. Special tokens' strings
    are plain text. A link is a pair of tokens that overlap; ``n_best`` counts
    links whose ids are linked in as many documents as any of their a id's,
    ``count_sum`` sums these numbers of documents. Groups are the shortest runs
    of tokens that end together; their digest is '' without tokens.

    A text that is null or empty, or that tokens don't spell exactly, has no
    tokens: zeros. Rows that repeat a doc_id are documents of their own; null
    doc_ids are passed on. Other columns are not read. An empty table gives an
    empty result.
    """
    return Alignment(docs, path_a, path_b).report(head)
