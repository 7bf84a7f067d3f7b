"""Byte-pair encoding by an automaton over tokens, compiled from the merges.

States are tokens; reading token ``v`` in state ``u`` leads to state ``v`` if
the arc exists. The automaton starts with an arc between any two signs of the
alphabet. Each merge ``(u, v) -> w``, in order, adds one gadget: the arc from
``u`` to ``v`` goes, ``w`` can be entered wherever ``u`` can, and what may
follow ``v`` at that time may follow ``w``. Written out, arcs would be the square
of the vocabulary, so a gadget is kept as its three numbers (entry, exit, time),
and whether an arc exists is followed back through the gadgets and noted.

A token sequence is the encoding of a word if and only if the automaton accepts
it, and each prefix of a word has one accepted sequence. So a word is encoded by
following arcs, the longest label first; a position from which no arc leads on
is given up for good. Decoding puts out the labels of the arcs. The new words of a
chunk of texts follow their arcs side by side, as arrays; a few, and long ones,
one by one.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import ship, tidy

#: Texts between white space, words and arcs that a task keeps at hand, in two generations.
KEPT_STRETCHES, KEPT_WORDS, KEPT_ARCS = 1 << 16, 1 << 16, 1 << 16
#: Bytes of text whose stretches are looked up together, about.
CHUNK = 4 << 20
#: Rows that go back together.
GOES_BACK = 300
#: Words that are encoded side by side: at most so many, at least so many, of so many signs at most.
ABREAST, FEW_WORDS, LONG_WORD = 1 << 15, 64, 64


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself if it can be printed, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _plain_signs() -> tuple[str, str, str]:
    """Signs below U+0250 whose case, form and kind no library sees otherwise: all, letters, numbers."""
    signs = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)] if c not in (0xAD, 0x130)]
    kind = lambda k: "".join(re.escape(s) for s in signs if unicodedata.category(s)[0] == k)
    return "".join(map(re.escape, signs)), kind("L"), kind("N")


#: Stands for the end of a word in labels and words; no byte's sign.
END = "\0"

_SIGNS, _LETTERS, _NUMBERS = _plain_signs()
PLAIN = re.compile(f"[{_SIGNS}]*")
# The split pattern of the vocabulary's pre-tokenizer, over plain signs.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class Kept(dict):
    """What a function gave: the last ``size`` results at least, twice as many at most."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.note(key, found)
        return found

    def note(self, key, found) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found

    def seen(self, key):
        """What is at hand, or None."""
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.note(key, found)
        return found

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Numbers:
    """A fixed table of distinct 64-bit keys above 0 and whole numbers, looked up many at a time; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, (2 * len(keys)).bit_length())
        self.shift, self.mask = W.U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, dtype=W.U), np.full(1 << bits, -1, dtype=np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several for one place, the last
            held = free[self.keys[at[free]] == keys[free]]
            self.values[at[held]] = values[held]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * W.U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        on = np.flatnonzero((there != keys) & (there != 0))
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there != 0)]
        return out


_SIGN_VALUES = W.mix(np.arange(1, 0x201, dtype=W.U))
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


class Abreast:
    """The automaton's tables as arrays; words follow their arcs side by side.

    Labels are found by 64-bit hashes of the signs, so a path is held against its word.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        arcs = automaton.arcs
        self.size = np.zeros(len(automaton.time), dtype=np.int64)
        self.shorter = np.full(len(automaton.time), -1, dtype=np.int32)
        begun: dict[str, int] = {}  # signs that begin a label -> the longest label they begin with
        for label in sorted(arcs, key=len):
            longest = -1
            for k in range(1, len(label)):
                longest = arcs.get(label[:k], longest)
                begun.setdefault(label[:k], longest)
            token = begun[label] = arcs[label]
            self.size[token], self.shorter[token] = len(label), longest
        # Labels as long as their own length at most: a beginning that is no label stands for the label before it.
        signs, ends = self._signs(list(begun))
        total, inverse = self._sums(signs)
        keys = (total[ends[1:]] - total[ends[:-1]]) * inverse[ends[:-1]]
        self.begun = Numbers(keys, np.array(list(begun.values()), dtype=np.int32) + 1)
        pairs = np.array(list(automaton.merge), dtype=np.int64)
        self.merge = Numbers(self._pair(pairs[:, 0], pairs[:, 1]), np.array(list(automaton.merge.values()), dtype=np.int32))
        names = [automaton.labels.get(i, "") for i in range(len(automaton.time))]
        self.numbers, self.labels = pa.array([str(i) for i in range(len(names))]), pa.array(names)
        own = {i: s for s, i in arcs.items()}
        self.word_labels = pa.array([own.get(i, "") for i in range(len(names))])
        self.entry, self.exit, self.time = (np.array(x, dtype=np.int32) for x in (automaton.entry, automaton.exit, automaton.time))

    @staticmethod
    def _signs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(words).encode("utf-16-le"), dtype=np.uint16), np.cumsum([0, *map(len, words)])

    @staticmethod
    def _sums(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(len(signs) + 1, dtype=W.U)
        np.cumsum(_SIGN_VALUES[signs] * W.powers(_BASE, len(signs)), out=total[1:])
        return total, W.powers(_INVERSE, len(signs) + 1)

    @staticmethod
    def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u.astype(W.U) << W.U(32)) + v.astype(W.U) + W.U(1)

    def longest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of the words: the longest label that stands there, or -1; and the words' ends."""
        signs, ends = self._signs(words)
        total, inverse = self._sums(signs)
        found = np.full(len(signs) + 1, -1, dtype=np.int32)
        at, last, size = np.arange(len(signs)), np.repeat(ends[1:], np.diff(ends)), 1
        while len(at):
            label = self.begun.find((total[at + size] - total[at]) * inverse[at])
            on = label >= 0
            at, last = at[on], last[on]
            found[at] = label[on] - 1
            size += 1
            inside = at + size <= last
            at, last = at[inside], last[inside]
        return found, ends

    def arc(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """As ``Automaton._arc``, after all merges."""
        out, on = np.zeros(len(u), dtype=bool), np.arange(len(u))
        before = np.full(len(u), len(self.automaton.merge), dtype=np.int32)
        while len(on):
            merged = self.merge.find(self._pair(u, v))
            left, right = self.time[u], self.time[v]
            stays = (merged < 0) | (merged >= before)
            signs = (left <= right) & (right < 0)
            out[on[stays & signs]] = True
            further = stays & ~signs
            on, u, v, left, right = (x[further] for x in (on, u, v, left, right))
            first = left > right
            before = np.where(first, left, right + 1)
            u, v = np.where(first, self.exit[u], u), np.where(first, v, self.entry[v])
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The accepted sequences, one after another, and how long each is."""
        words = [w + END for w in words]
        longest, ends = self.longest(words)
        given_up = np.zeros(len(longest), dtype=bool)
        path = np.zeros((len(words), LONG_WORD + 1), dtype=np.int32)
        depth = np.zeros(len(words), dtype=np.int64)
        on, at = np.arange(len(words)), ends[:-1].copy()
        token = longest[at]
        while len(on) > FEW_WORDS:
            steps = depth[on]
            goes = token >= 0
            goes &= ~given_up[at + np.where(goes, self.size[token], 0)]
            inner = np.flatnonzero(goes & (steps > 0))
            goes[inner] = self.arc(path[on[inner], steps[inner] - 1], token[inner])
            back = np.flatnonzero(token < 0)
            # No arc leads on from here.
            given_up[at[back]] = True
            if (steps[back] == 0).any():
                raise ValueError("no sequence of tokens for a word")
            last = path[on[back], steps[back] - 1]
            depth[on[back]] -= 1
            at[back] -= self.size[last]
            forth = np.flatnonzero(goes)
            path[on[forth], steps[forth]] = token[forth]
            depth[on[forth]] += 1
            at[forth] += self.size[token[forth]]
            token = np.where(goes, longest[at], self.shorter[token])
            token[back] = self.shorter[last]
            going = at < ends[on + 1]
            on, at, token = on[going], at[going], token[going]
        for i in on:
            own = self.automaton.encode_word(words[i][:-1])
            path[i, : len(own)], depth[i] = own, len(own)
        return path[np.arange(LONG_WORD + 1) < depth[:, None]], depth

    def both_ways(self, words: list[str]) -> list[tuple[int, str, str]]:
        """``Automaton._word`` of each word."""
        path, depth = self.encode(words)
        ends = pa.array(np.cumsum([0, *depth]).astype(np.int32))
        joined = lambda names, by: pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(path))), by).to_numpy(zero_copy_only=False).tolist()
        made = zip(depth.tolist(), joined(self.numbers, " "), joined(self.labels, " "), strict=True)
        right = map(str.__eq__, joined(self.word_labels, ""), [w + END for w in words])
        return [both if same else self.automaton._word(w) for both, same, w in zip(made, right, words, strict=True)]


class Automaton:
    def __init__(self, definition: str):
        self.definition = definition
        model = json.loads(definition)
        suffix = model["model"]["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["model"]["vocab"]
        self.labels = {i: s for s, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.labels |= {i: s for s, i in self.special.items()}
        size = max(self.labels) + 1
        self.entry, self.exit, self.time = list(range(size)), list(range(size)), [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        made = set()
        for time, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made.add(left + right)
            self._gadget(time, vocabulary[left], vocabulary[right], vocabulary[left + right])
        end = lambda s: s.removesuffix(suffix) + END if s.endswith(suffix) else s
        self.arcs = {end(s): i for s, i in vocabulary.items() if self.time[i] >= 0 or s not in made}
        self.reach: dict[str, int] = {}
        for s in self.arcs:
            for k in (1, 2, 3):
                self.reach[s[:k]] = max(self.reach.get(s[:k], 0), len(s))
        self.signs = byte_signs()
        self.known = Kept(lambda pair: self._arc(*pair, len(self.merge)), KEPT_ARCS)
        self.words = Kept(self._word, KEPT_WORDS)
        self.stretches = Kept(self._plain_split, KEPT_STRETCHES)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        """Merge u and v to w, if u can be followed by v at that time; else there is nothing to merge."""
        accepted = self._arc(u, v, time)
        self.merge.setdefault((u, v), time)
        if accepted and self.time[w] < 0:
            self.entry[w], self.exit[w], self.time[w] = u, v, time

    def forget(self) -> None:
        """Give up what was noted of texts; the automaton stays."""
        for notes in (self.known, self.words, self.stretches):
            notes.forget()

    @cached_property
    def library(self):
        """For texts with unusual signs: the library's own normalizer and pre-tokenizer."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    def _arc(self, u: int, v: int, before: int) -> bool:
        """Undo the later gadget of the two again and again; no merge may have taken the arc away before."""
        while True:
            if self.merge.get((u, v), before) < before:
                return False
            if self.time[u] > self.time[v]:
                before, u = self.time[u], self.exit[u]
            elif self.time[v] >= 0:  # of one merge, the left place is taken first
                before, v = self.time[v] + 1, self.entry[v]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """The accepted sequence of a word of byte signs."""
        word += END
        labels, known, reach = self.arcs.get, self.known, self.reach.get
        n, state, path, ends, given_up = len(word), -1, [], [0], set()
        at, size = 0, reach(word[:3], 2)
        while at < n:
            while size:
                token = labels(word[at : at + size])
                if token is not None and (state < 0 or known[state, token]) and at + size not in given_up:
                    path.append(token)
                    state = token
                    at += size
                    ends.append(at)
                    size = reach(word[at : at + 3], 2)
                    break
                size -= 1
            else:
                given_up.add(at)
                if not path:
                    raise ValueError(f"no sequence of tokens for {word!r}")
                path.pop()
                ends.pop()
                state = path[-1] if path else -1
                size, at = at - ends[-1] - 1, ends[-1]
        return path

    @cached_property
    def abreast(self) -> Abreast:
        return Abreast(self)

    def all_both_ways(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """``both_ways`` of each text.

        No word spans white space, so in texts of plain signs each stretch
        between white space stands for itself and is looked up once; new words
        are encoded together.
        """
        each = texts.to_numpy(zero_copy_only=False).tolist()
        plain = [bool(PLAIN.fullmatch(text)) and not (self.cut and self.cut.search(text)) for text in each]
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.if_else(pa.array(plain), texts, "")))
        coded = lists.flatten().dictionary_encode()
        pieces = [self._pieces(s) for s in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = [w for own in pieces for w in own]
        index = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        words = self._words(list(index))
        size = np.array([w[0] for w in words], dtype=np.int64)
        parts = [pa.array([w[k] for w in words], pa.large_string()) for k in (1, 2)]
        ends = pa.array(np.cumsum([0, *map(len, pieces)]).astype(np.int32))
        # Words are put together to stretches, and these to texts.
        for where, which in ((ends, pa.array([index[w] for w in flat], pa.int32())), (lists.offsets, coded.indices)):
            cuts = where.to_numpy()
            total = np.concatenate([[0], np.cumsum(size[which.to_numpy()])])
            size = total[cuts[1:]] - total[cuts[:-1]]
            parts = [pc.binary_join(pa.ListArray.from_arrays(where, p.take(which)), pa.scalar(" ", pa.large_string())) for p in parts]
        made = [pa.array(size, pa.int64()), *parts]
        if not all(plain):
            rows = list(zip(*(m.to_pylist() for m in made), strict=True))
            rows = [row if own else self.both_ways(text) for row, own, text in zip(rows, plain, each, strict=True)]
            made = [pa.array([row[k] for row in rows], m.type) for k, m in enumerate(made)]
        return tuple(made)

    def _pieces(self, stretch: str) -> list[str]:
        """The words of a stretch."""
        return [stretch.lower()] if stretch.isascii() and stretch.isalpha() else self.stretches[stretch]

    def _words(self, words: list[str]) -> list[tuple[int, str, str]]:
        made = [self.words.seen(w) for w in words]
        new = [k for k, found in enumerate(made) if found is None and len(words[k]) < LONG_WORD]
        for first in range(0, len(new), ABREAST):
            some = new[first : first + ABREAST]
            if len(some) > FEW_WORDS:
                for k, both in zip(some, self.abreast.both_ways([words[k] for k in some]), strict=True):
                    made[k] = both
                    self.words.note(words[k], both)
        return [self.words[w] if both is None else both for w, both in zip(words, made, strict=True)]

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.encode_word(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _plain_split(self, text: str) -> list[str]:
        signs = self.signs
        return [w if w.isascii() else "".join([signs[b] for b in w.encode()]) for w in _SPLIT.findall(text.lower())]

    def split(self, text: str) -> list[str]:
        """Pre-split words of a text without special tokens, in byte signs."""
        if PLAIN.fullmatch(text):
            return self._plain_split(text)
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> list[int]:
        parts = self.cut.split(text) if self.cut else [text]
        return [i for k, p in enumerate(parts) for i in ([self.special[p]] if k % 2 else (t for w in self.split(p) for t in self.encode_word(w)))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: labels are joined by a space."""
        return " ".join([self.labels[i] for i in ids])

    def both_ways(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by a space, decoded text."""
        ids = self.encode(text)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)


_COMPILED: dict[int, Automaton] = {}


def compiled(definition: str) -> Automaton:
    """Compiled once per Python worker."""
    key = hash(definition)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Automaton(definition)
    return _COMPILED[key]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shared.value)
        collects = gc.isenabled()
        gc.disable()  # notes are many, and have no cycles
        try:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                for chunk in W.chunks(batch.column(batch.schema.get_field_index("text")), CHUNK):
                    texts = pa.LargeStringArray.from_buffers(len(chunk.rows), pa.py_buffer(np.ascontiguousarray(chunk.offsets)), pa.py_buffer(chunk.data))
                    columns = automaton.all_both_ways(texts)
                    made = pa.RecordBatch.from_arrays([ids.slice(chunk.rows.start, len(texts)), columns[0], columns[1].cast(pa.string()), columns[2].cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                    # Ids are some times their text: they go back to the JVM some rows at a time.
                    yield from (made.slice(first, GOES_BACK) for first in range(0, len(texts), GOES_BACK))
        finally:
            # The worker lives on, beside those of the operators to come.
            automaton.forget()
            if collects:
                gc.enable()

    return run


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, ids, decoded): ids joined by a space, and their decoding.

    ``vocabulary`` is the path of a tokenizer file; it is read on the driver and
    goes out to the tasks, its size bounded by the vocabulary. Documents are
    worked on one by one. A null text is empty; an empty text has no tokens.
    Any doc_id, null or repeated, is passed on. Other columns are not read. An
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(tidy(_run(shared)), "doc_id long, n_tokens long, ids string, decoded string")
