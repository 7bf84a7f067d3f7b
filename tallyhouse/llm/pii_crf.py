"""Personal data in texts: patterns, and a linear-chain conditional random field over word shapes.

Patterns find what is written in the usual way. The field tags words (``B-`` and
``I-`` of each kind, or ``O``) by their shapes, digits and cue words, with their
neighbours', and finds what patterns leave: numbers that stand side by side,
addresses with the signs spelt out, phones without a country, names after titles.

It is trained in one task from a small table of labelled texts, by gradient
steps on the likelihood of the tags, and decoded by Viterbi's rule. A word whose
score for ``O`` exceeds all others by more than any two transitions could make
up is ``O`` on the best path whatever stands beside it; such words cut a text
into short runs, which are decoded side by side. The result is the best path of
the whole text.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import ship

#: Kinds, in the order in which spans that start together are listed; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Labelled texts that are learnt from at most (the first by hash), and words of one that count.
ROWS, LENGTH = 4000, 64
STEPS, RATE, DECAY, SEED = 100, 0.15, 1e-3, 11
#: A word of the labelled texts counts as itself if it stands there so often.
OFTEN = 4

#: Words that are scored at once.
PIECE = 1 << 13

LABELLED = "text string, spans array<struct<kind:string,start:int,stop:int>>"
SPANS = "doc_id long, spans array<struct<kind:string,start:int,stop:int,base:boolean>>"

# The patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def is_card(text: str) -> bool:
    if len(text) > 2 * 19:
        return False
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and passes_luhn(digits)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, stop) of the patterns' matches, in order.

    An address is looked for from its @ on both sides, and runs of digits are
    taken whole, so no text takes longer than its length.
    """
    found, free = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and is_card(m[0]):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Words as numbers: shape, outline, letters, digits.

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B)]] = ord("A")
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
_CLASS[[*range(0x30, 0x3A)]] = ord("0")
_SIGN = W.mix(np.arange(1000, 1256, dtype=W.U))
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?)]}\"'#$%&*"]] = True
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 10, 12, 14, 16, 17, 20])

#: What a word shows, and the neighbours' places that a tag looks at.
SEEN = ("shape", "outline", "signs", "letters", "digits")
LOOKS = (("signs", 0), ("signs", -1), ("signs", 1), ("shape", 0), ("shape", -1), ("shape", 1), ("outline", 0), ("outline", -1), ("outline", 1), ("outline", -2), ("outline", 2), ("letters", 0), ("letters", -1), ("letters", 1), ("letters", -2), ("letters", 2), ("digits", 0), ("digits", 1), ("digits", -1))


def observe(chunk: W.Chunk) -> tuple[W.Words, dict[str, np.ndarray]]:
    """Words of a chunk and 64-bit numbers for what each shows.

    A shape has letters as A or a and runs of them as one, digits one by one up
    to six; an outline has every run as one; ``signs`` are what is neither.
    ``letters`` is the word in lower case without signs behind it; ``digits``
    their number in steps, and whether they pass the check of card numbers.
    """
    found = W.find_words(chunk)
    data, n = chunk.data, len(found.starts)
    if not n:
        return found, {k: np.zeros(0, W.U) for k in SEEN}
    sort = _CLASS[data]
    # Capitals from U+00C0 to U+00DE.
    sort[:-1][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = ord("A")
    fresh = np.ones(len(data), bool)
    fresh[1:] = sort[1:] != sort[:-1]
    fresh[found.starts] = True
    at = np.arange(len(data))
    since = at - np.maximum.accumulate(np.where(fresh, at, 0))
    digit = sort == ord("0")
    out = {}
    sign = ~digit & (sort != ord("a")) & (sort != ord("A"))
    for name, keep in (("shape", fresh | (digit & (since < 6))), ("outline", fresh), ("signs", sign)):
        before = np.concatenate([[0], np.cumsum(keep)])
        out[name] = W.hash_runs(_SIGN[sort[keep]], before[found.starts], before[found.stops])
    stops = found.stops.copy()
    for _ in range(4):
        stops -= _EDGE[data[stops - 1]] & (stops - found.starts > 1)
    out["letters"] = W.hash_words(chunk, W.Words(found.starts, stops, found.first), fold_case=True)
    before = np.concatenate([[0], np.cumsum(digit)])
    many = before[found.stops] - before[found.starts]
    steps = np.searchsorted(_DIGIT_STEPS, many, side="right").astype(W.U)
    for i in np.flatnonzero((many >= 14) & (many <= 19)):
        steps[i] += W.U(100 * passes_luhn(bytes(data[found.starts[i] : found.stops[i]][digit[found.starts[i] : found.stops[i]]]).decode()))
    out["digits"] = W.mix(steps + W.U(1))
    return found, out


class Field:
    """Weights of a linear-chain field: per look a row for each known value (0: unknown), and transitions."""

    def __init__(self, known: dict[str, np.ndarray], weights: list[np.ndarray], bias: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.known, self.weights, self.bias, self.steps, self.first = known, weights, bias, steps, first

    def places(self, seen: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for name, values in seen.items():
            known = self.known[name]
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            out[name] = np.where(known[at] == values, at + 1, 0)
        return out

    def scores(self, seen: dict[str, np.ndarray], row: np.ndarray) -> np.ndarray:
        """Words x tags; a neighbour in another text counts as unknown."""
        out = np.broadcast_to(self.bias, (len(row), len(TAGS))).astype(np.float32)
        looks = list(_looks(self.places(seen), row))
        # In pieces that stay near the processor.
        part = np.empty((PIECE, len(TAGS)), np.float32)
        for low in range(0, len(row), PIECE):
            own = out[low : low + PIECE]
            for place, weights in zip(looks, self.weights, strict=True):
                own += np.take(weights, place[low : low + PIECE], axis=0, out=part[: len(own)], mode="clip")
        return out

    def slack(self) -> np.ndarray:
        """Per tag: the most that transitions can favour it over O, whatever stands beside."""
        into = np.vstack([self.steps, self.first])
        return (into - into[:, :1]).max(axis=0) + np.maximum((self.steps - self.steps[:1]).max(axis=1), 0)

    def decode(self, score: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best tag of each word."""
        tags = np.zeros(len(row), np.int8)
        unsure = (score[:, 1:] + self.slack()[1:] >= score[:, :1]).any(axis=1)
        at = np.flatnonzero(unsure)
        if not len(at):
            return tags
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
        begin = at[np.concatenate([[0], cut])]
        size = np.diff(np.concatenate([[0], cut, [len(at)]]))
        opens = np.ones(len(begin), bool)
        opens[begin > 0] = row[begin[begin > 0] - 1] != row[begin[begin > 0]]
        after = begin + size
        closes = np.ones(len(begin), bool)
        inner = after < len(row)
        closes[inner] = row[after[inner]] != row[after[inner] - 1]
        order = np.argsort(size, kind="stable")
        first = 0
        while first < len(order):
            longest = int(size[order[first]]) * 2
            last = int(np.searchsorted(size[order], longest, side="right"))
            last = min(last, first + max(1, (1 << 20) // longest))
            self._paths(score, tags, *(x[order[first:last]] for x in (begin, size, opens, closes)))
            first = last
        return tags

    def _paths(self, score, tags, begin, size, opens, closes) -> None:
        """Best paths of runs that ascend by size, so those that go on at a word are the last ones."""
        start = np.where(opens[:, None], self.first, self.steps[0])
        best = start + score[begin]
        longest = int(size.max())
        first = np.searchsorted(size, np.arange(longest), side="right")
        into = np.ascontiguousarray(self.steps.T)
        back = np.zeros((longest, len(begin), len(TAGS)), np.int8)
        for t in range(1, longest):
            live = slice(int(first[t]), None)
            reach = best[live][:, None, :] + into
            came = reach.argmax(axis=2)
            back[t, live] = came
            best[live] = np.take_along_axis(reach, came[:, :, None], axis=2)[:, :, 0] + score[begin[live] + t]
        tag = (best + np.where(closes[:, None], 0, self.steps[:, 0])).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = slice(int(first[t]), None)
            tags[begin[live] + t] = tag[live]
            if t:
                tag[live] = np.take_along_axis(back[t, live], tag[live][:, None], axis=1)[:, 0]


def _looks(places: dict[str, np.ndarray], row: np.ndarray) -> Iterator[np.ndarray]:
    n = len(row)
    for name, by in LOOKS:
        own = places[name]
        if by:
            moved = np.zeros(n, own.dtype)
            here, there = (slice(-by, n), slice(0, n + by)) if by < 0 else (slice(0, max(n - by, 0)), slice(by, n))
            moved[here] = np.where(row[here] == row[there], own[there], 0)
            own = moved
        yield own


# Training.


def _gold(text: str, spans, found: W.Words, chars: np.ndarray, i: int) -> list[int]:
    """A tag per word of text ``i``: the first word of a span begins it."""
    first, last = int(found.first[i]), int(found.first[i + 1])
    out, before = [], None
    for w in range(first, last):
        start, stop = int(chars[found.starts[w]]), int(chars[found.stops[w] - 1]) + 1
        hit = next((k for k, s in enumerate(spans) if s["start"] < stop and start < s["stop"]), None)
        kind = KINDS.index(spans[hit]["kind"]) if hit is not None else None
        out.append(0 if hit is None else 1 + 2 * kind + (hit == before))
        before = hit
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(score: np.ndarray, live: np.ndarray, gold: np.ndarray, steps: np.ndarray, first: np.ndarray):
    """Of padded texts x words x tags: the tags' log-likelihood, and its gradients for scores, steps and first."""
    texts, length, k = score.shape
    forward, backward = np.empty_like(score), np.zeros_like(score)
    forward[:, 0] = first + score[:, 0]
    for t in range(1, length):
        new = _logsum(forward[:, t - 1][:, :, None] + steps, 1) + score[:, t]
        forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = _logsum((backward[:, t + 1] + score[:, t + 1])[:, None, :] + steps, 2)
        backward[:, t] = np.where(live[:, t + 1, None], new, 0)
    total = _logsum(forward[:, -1], 1)
    chance = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
    hot = np.eye(k)[gold] * live[:, :, None]
    pair = np.zeros((k, k))
    gold_pair = np.zeros((k, k))
    for t in range(1, length):
        both = forward[:, t - 1][:, :, None] + steps + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        pair += (np.exp(both) * live[:, t, None, None]).sum(axis=0)
        np.add.at(gold_pair, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
    own = (score * hot).sum() + (steps * gold_pair).sum() + (first * hot[:, 0]).sum()
    return own - total.sum(), hot - chance, gold_pair - pair, (hot - chance)[:, 0].sum(axis=0)


def _common(values: np.ndarray, least: int) -> np.ndarray:
    found, count = np.unique(values, return_counts=True)
    return found[count >= least] if (count >= least).any() else found[:1]


def train(texts: list[str], spans: list) -> Field:
    """A field learnt from labelled texts by gradient steps; the same for the same rows."""
    chunk = next(W.chunks(pa.array([*texts, "word"], pa.large_string()), size=1 << 62))
    found, seen = observe(chunk)
    continues = (chunk.data & 0xC0) == 0x80
    whole = np.cumsum(~continues) - 1
    chars = whole - np.repeat(whole[np.minimum(chunk.offsets[:-1], len(whole) - 1)], np.diff(chunk.offsets))
    known = {k: _common(v, OFTEN if k == "letters" else 1) for k, v in seen.items()}
    n = len(found.starts)
    gold = np.concatenate([np.array(_gold(t, s, found, chars, i), int) for i, (t, s) in enumerate(zip([*texts, "word"], [*spans, []], strict=True))])
    field = Field(known, [np.zeros((len(known[name]) + 1, len(TAGS)), np.float32) for name, _ in LOOKS], np.zeros(len(TAGS)), np.zeros((len(TAGS),) * 2), np.zeros(len(TAGS)))
    looks = list(_looks(field.places(seen), found.row))
    orders = [np.argsort(p, kind="stable") for p in looks]
    firsts = [np.unique(p[o], return_index=True) for p, o in zip(looks, orders, strict=True)]
    counts = np.minimum(found.counts, LENGTH)
    has = np.flatnonzero(counts)
    live = np.arange(counts.max()) < counts[has][:, None]
    word = np.where(live, found.first[:-1][has][:, None] + np.arange(counts.max()), 0)
    sizes = [*(w.shape for w in field.weights), field.bias.shape, field.steps.shape, field.first.shape]
    values = [np.zeros(s) for s in sizes]
    speed, spread = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for step in range(1, STEPS + 1):
        score = np.zeros((n, len(TAGS))) + values[-3]
        for place, weights in zip(looks, values, strict=False):
            score += weights[place]
        _, by_word, by_step, by_first = likelihood(score[word], live, gold[word], values[-2], values[-1])
        flat = np.zeros((n, len(TAGS)))
        flat[word[live]] = by_word[live]
        grads = []
        for (value, first), order, weights in zip(firsts, orders, values, strict=False):
            grad = np.zeros_like(weights)
            grad[value] = np.add.reduceat(flat[order], first, axis=0)
            grad[0] = 0  # what is unknown says nothing
            grads.append(grad)
        grads += [flat.sum(axis=0), by_step, by_first]
        for i, grad in enumerate(grads):
            grad = grad / len(has) - DECAY * values[i]
            speed[i] = 0.9 * speed[i] + 0.1 * grad
            spread[i] = 0.999 * spread[i] + 0.001 * grad * grad
            values[i] += RATE * (speed[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-6)
    *weights, bias, steps, first = values
    return Field(known, [w.astype(np.float32) for w in weights], bias, steps, first)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["text"], str(r["spans"])))
    own = [[s for s in r["spans"] or [] if s and s["kind"] in KINDS and None not in s.values()] for r in rows]
    field = train([r["text"] for r in rows], own)
    arrays = [("known", n, field.known[n].view(np.int64).astype(np.int64), None) for n in SEEN]
    parts = [*field.weights, field.bias, field.steps, field.first]
    yield pa.RecordBatch.from_pylist(
        [{"part": i, "ints": a[2].tolist(), "floats": []} for i, a in enumerate(arrays)]
        + [{"part": len(SEEN) + i, "ints": list(p.shape), "floats": p.astype(np.float64).ravel().tolist()} for i, p in enumerate(parts)],
        pa.schema([("part", pa.int32()), ("ints", pa.list_(pa.int64())), ("floats", pa.list_(pa.float64()))]),
    )


def trained(labelled: DataFrame) -> Field:
    """(text, spans) -> a field. Learnt in one task from ``ROWS`` rows at most; only its weights come to the driver."""
    ship(labelled.sparkSession)
    own = labelled.filter("text is not null").select("text", "spans")
    sample = own.orderBy(F.xxhash64("text"), "text").limit(ROWS).coalesce(1)
    got = {r["part"]: r for r in sample.mapInArrow(_learn, "part int, ints array<long>, floats array<double>").collect()}
    known = {n: np.array(got[i]["ints"], np.int64).view(W.U) for i, n in enumerate(SEEN)}
    *weights, bias, steps, first = (np.array(got[i]["floats"]).reshape(got[i]["ints"]) for i in range(len(SEEN), len(got)))
    return Field(known, [w.astype(np.float32) for w in weights], bias, steps, first)


# The labelled table: made by rule from the pieces below.

_TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
_CUES = {
    "phone": ("", "phone", "phone:", "tel.", "Tel:", "call", "call me at", "mobile:", "fax", "appelez le", "Telefon:", "teléfono"),
    "card": ("", "card", "card number", "card no.", "Visa", "Karte", "carte", "tarjeta", "pay with"),
    "email": ("", "mail", "e-mail:", "write to", "contact", "mailto", "Kontakt:", "correo"),
    "ip": ("", "ip", "IP:", "from host", "server", "ping", "address"),
}
_PLAIN = ("at the dot", "at noon", "point com", "on the phone today", "the card was", "a call at night", "his e-mail", "the address of", "dot by dot", "Dr. who", "the server at home", "the Apache License, Version 2.0", "the GNU General Public License, version 3", "Creative Commons Attribution License", "Und Und Und Und Und", "The The The The", "Of Of Of are are are", "the City of New York", "In General Terms And Conditions")


class _Writer:
    """Random texts with known spans."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def number(self, n: int) -> str:
        return str(self.rng.randrange(1, 10)) + "".join(str(self.rng.randrange(10)) for _ in range(n - 1))

    def word(self) -> str:
        parts = ("th", "e", "an", "on", "st", "re", "in", "ou", "é", "ci", "la", "ü", "er", "ion", "ch", "de", "ó", "ment", "a", "qu")
        return "".join(self.rng.choice(parts) for _ in range(self.rng.randrange(1, 5)))

    def words(self, most: int) -> list[str]:
        """Prose: sentences of any length, one word too, and capitals inside them."""
        out, opens = [], self.rng.random() < 0.4
        for _ in range(self.rng.randrange(most + 1)):
            word = self.word()
            word = word.capitalize() if opens or (out and self.rng.random() < 0.12) else word
            mark = self.rng.choice(("", "", "", "", "", ",", ".", ".", ".", ";", "!", "###", "$$$", "%%%", "&&&", "***", "?", ")", '"', ".###"))
            opens = mark[:1] in (".", "!", "?") if mark else False
            out.append(word + mark)
        return out

    def host(self) -> str:
        name = self.word().replace("é", "e").replace("ü", "u").replace("ó", "o")
        return name + self.rng.choice(("", str(self.rng.randrange(99)))) + self.rng.choice((".example.com", ".com", ".org", ".co.uk", ".de"))

    def card(self) -> str:
        size = self.rng.choice((16, 16, 16, 16, 15, 14, 19))
        body = self.number(size - 1)
        digits = next(body + c for c in "0123456789" if passes_luhn(body + c))
        mark = self.rng.choice(("", "", "", " ", "-", "."))
        return mark.join(digits[i : i + 4] for i in range(0, size, 4)) if mark else digits

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.rng.choice((f"+1 ({a}) {b}-{c}", f"+{self.number(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.number(2)}-{a}-{b}-{c}", f"0{a} {b} {c}", f"+1 ({a}) {b}-{c}"))

    def email(self) -> str:
        user, host = f"{self.word()}.{self.number(2)}", self.host()
        left, last = host.rsplit(".", 1)
        return self.rng.choice((f"{user}@{host}", f"{user}@{host}", f"{user} (at) {host}", f"{user} [at] {left} [dot] {last}", f"{user} (at) {left} (dot) {last}", f"{user} at {left} dot {last}", f"{user}@{left}"))

    def ip(self) -> str:
        four = ".".join(str(self.rng.randrange(1, 256)) for _ in range(4))
        parts = [f"{self.rng.randrange(1 << 16):x}" for _ in range(8)]
        return self.rng.choice((four, four, f"{four}:{self.number(4)}", ":".join(parts), f"{parts[0]}:{parts[1]}::{parts[2]}"))

    def other(self) -> str:
        """What is no personal data, though it looks like it."""
        r = self.rng
        digits = self.number(16)
        while passes_luhn(digits):
            digits = self.number(16)
        return r.choice((
            f"20{self.number(2)}-0{self.number(1)}-{self.number(2)}", f"{self.number(2)}.{self.number(2)}.20{self.number(2)}", f"${self.number(1)},{self.number(3)}.00", f"{self.number(4)}", f"{self.number(1)}", f"{self.number(2)}:{self.number(2)}",
            f"v{self.number(1)}.{self.number(2)}.{self.number(1)}", f"{self.number(1)}.{self.number(1)}.{self.number(1)}", f"{self.number(1)}.{self.number(2)}.{self.number(1)}.{self.number(4)}.{self.number(3)}", f"{self.number(2)}.{self.number(4)}", f"{self.number(3)},{self.number(3)}",
            f'token = "{r.getrandbits(160):040x}"', f"key={r.getrandbits(64):016x}", f"978-{self.number(1)}-{self.number(2)}-{self.number(6)}-{self.number(1)}", f"#{self.number(6)}", f"{self.number(12)}", f"{self.number(24)}", digits, f"{self.number(5)}",
            f"https://{self.host()}/{self.word()}?id={self.number(5)}", f"{self.number(3)} {self.number(3)} {self.number(3)}", f"@{self.word()}", f"{self.number(2)}%", r.choice(_PLAIN), r.choice(_PLAIN), r.choice(_PLAIN), f"{self.number(5)} {self.number(3)}", f"({self.number(4)})", f"({self.number(3)})", f"+{self.number(1)}",
        ))

    def name(self) -> str:
        return " ".join((self.word() + self.word()).capitalize() for _ in range(self.rng.randrange(1, 4)))

    def text(self) -> tuple[str, list[dict]]:
        pieces: list[tuple[str, str | None]] = [(w, None) for w in self.words(12)]
        kind = None
        for _ in range(self.rng.randrange(5)):
            kind = kind if kind and self.rng.random() < 0.5 else self.rng.choice(("phone", "card", "email", "ip", "name", "other", "other"))
            if kind == "other":
                pieces.append((self.other(), None))
            elif kind == "name":
                pieces += [(self.rng.choice((*_TITLES, "my name is", "Regards,", "Sincerely,")), None), (self.name(), kind)]
            else:
                cue = self.rng.choice(_CUES[kind])
                pieces += ([(cue, None)] if cue else []) + [(getattr(self, kind)(), kind)]
            if kind == "name" or self.rng.random() < 0.6:
                more = self.words(6)
                pieces += [(w[:1].lower() + w[1:] if kind == "name" and not i else w, None) for i, w in enumerate(more)]
        text, spans = "", []
        for piece, kind in pieces:
            text += " " if text else ""
            if kind:
                spans.append({"kind": kind, "start": len(text), "stop": len(text) + len(piece)})
            text += piece + (self.rng.choice(("", "", "", ".", ",", "###", ")", "***")) if kind else "")
        return text, spans


def examples(rows: int = 900, seed: int = SEED) -> list[tuple[str, list[dict]]]:
    """Labelled texts made by rule; the same for the same seed."""
    writer = _Writer(seed)
    return [writer.text() for _ in range(rows)]


def labelled_table(spark: SparkSession, rows: int = 900, seed: int = SEED) -> DataFrame:
    """The small labelled table: (text, spans)."""
    return spark.createDataFrame(examples(rows, seed), LABELLED)


# Spans of whole texts.


def _holds(kind: str, text: str) -> bool:
    """What a span of the field must pass besides."""
    if kind == "card":
        return is_card(text.replace(".", " "))
    if kind == "phone":
        return 7 <= len(_digits(text)) <= 15
    if kind == "ip":
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
        return True
    if kind == "email":
        return re.search(r"\S@\S|\bat\b.*\bdot\b|[(\[]at[)\]]", text) is not None
    words = text.split()
    return text[:1].isupper() and len(set(words)) == len(words) <= 5 and not any(c.isdigit() for c in text)


def _trim(kind: str, text: str, start: int, stop: int) -> tuple[int, int]:
    opening = "+(" if kind == "phone" else ":" if kind == "ip" else ""
    while start < stop and not (text[start].isalnum() or text[start] in opening):
        start += 1
    while start < stop and not text[stop - 1].isalnum():
        stop -= 1
    return start, stop


def _good(kind: str, text: str, start: int, stop: int) -> bool:
    start, stop = _trim(kind, text, start, stop)
    return start < stop and _holds(kind, text[start:stop])


def _runs(tags: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place in KINDS, first word, word behind the last) of tagged runs."""
    at = np.flatnonzero(tags)
    if not len(at):
        return
    kind = (tags[at] - 1) // 2
    begins = tags[at] % 2 == 1
    new = np.ones(len(at), bool)
    new[1:] = begins[1:] | (np.diff(at) != 1) | (np.diff(kind) != 0) | (np.diff(row[at]) != 0)
    cuts = np.append(np.flatnonzero(new), len(at))
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(kind[first]), int(at[first]), int(at[last - 1]) + 1


def field_spans(field: Field, chunk: W.Chunk) -> dict[int, list[tuple[int, int, int]]]:
    """Per row of a chunk that has any: (start, place in KINDS, stop) of the field's spans, in code points."""
    found, seen = observe(chunk)
    if not len(found.starts):
        return {}
    row = found.row
    tags = field.decode(field.scores(seen, row), row)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for kind, first, last in _runs(tags, row):
        i = int(row[first])
        low, high = int(found.starts[first]), int(found.stops[last - 1])
        text = chunk.data[low:high].tobytes().decode()
        parts = [(0, len(text))]
        if KINDS[kind] == "card" and not _good("card", text, *parts[0]):
            # What isn't one card may be several, a word each.
            parts = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for start, stop in parts:
            if _good(KINDS[kind], text, start, stop):
                out.setdefault(i, []).append((low, kind, *_trim(KINDS[kind], text, start, stop)))
    if out:
        whole = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        for i, spans in out.items():
            before = whole[chunk.offsets[i]]
            out[i] = [(int(whole[low] - before) + start, kind, int(whole[low] - before) + stop) for low, kind, start, stop in spans]
    return out


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in W.chunks(batch.column(batch.schema.get_field_index("text"))):
                more = field_spans(field, chunk)
                data, rows = chunk.data.tobytes(), []
                for i, (low, high) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)):
                    base = pattern_spans(data[low:high].decode())
                    # Patterns' spans stay; the field's are added where none of them lies.
                    added = _apart(more.get(i, []), base)
                    both = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                    rows.append([{"kind": KINDS[k], "start": a, "stop": b, "base": own} for a, k, b, own in both])
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.rows.start, len(rows)), pa.array(rows, shape)], ["doc_id", "spans"])

    return run


def _apart(spans: list, base: list) -> list:
    """Those spans that no base span overlaps."""
    if not base:
        return spans
    starts = np.array([b[0] for b in base])
    reach = np.maximum.accumulate(np.array([b[2] for b in base]))
    out = []
    for s in spans:
        before = int(np.searchsorted(starts, s[2])) - 1  # the last that starts ahead of its end
        if before < 0 or reach[before] <= s[0]:
            out.append(s)
    return out


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, spans), a row per row.

    ``spans`` lists (kind, start, stop, base) by start, then kind as in
    ``KINDS``: code points, the end exclusive. ``base`` marks the patterns'
    matches; the field's are added where they overlap none of these. Cards must
    pass the check sum, phones have 7 to 15 digits, addresses be well formed.

    ``labelled`` is a table (text, spans of (kind, start, stop)); the default
    is made by rule. ``ROWS`` of its rows at most are learnt from, and of each
    the first ``LENGTH`` words; rows without text and spans of other kinds are left out.

    A null text is empty, an empty text has no spans. Rows that repeat are
    worked on one by one; any doc_id is passed on. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    field = trained(labelled if labelled is not None else labelled_table(spark))
    shared = spark.sparkContext.broadcast(field)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find(shared), SPANS)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the patterns' spans per row, and all spans in writing."""
    written = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
