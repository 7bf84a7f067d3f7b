"""Personal data: patterns against plain expressions, the field against all paths, spans of whole texts."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import pii_crf
from tallyhouse.llm import words as W

# The patterns as the contract has them.
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    texts, spans = zip(*pii_crf.examples(), strict=True)
    return pii_crf.train(list(texts), list(spans))


def test_patterns_against_expressions():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "-", "+", "1", "22", "333", "4465758382889437", " ", "(", ")", "é", "x", "10.0.0.1", "256", "+1 (743) 555-3824", "a.b@c-d.e1.f", "..", "0004", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii_crf.pattern_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1 ", "@a", "a@", "+", "1-"])
def test_patterns_take_linear_time(piece):
    start = time.perf_counter()
    pii_crf.pattern_spans(piece * 200_000)
    assert time.perf_counter() - start < 3


def random_field(rng, n, sharp):
    k = len(pii_crf.TAGS)
    score = rng.normal(size=(n, k)).astype(np.float32) * 2
    score[rng.random(n) < sharp, 0] += 30
    return score, pii_crf.Field({}, [], np.zeros(k), rng.normal(size=(k, k)), rng.normal(size=k))


@pytest.mark.parametrize("sharp", [0, 0.4, 0.9])
def test_decoding_finds_the_best_path(sharp):
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 5, size=3)
        row = np.repeat(np.arange(3), sizes)
        score, field = random_field(rng, len(row), sharp)
        got = field.decode(score, row)
        for i in range(3):
            own = score[row == i].astype(float)
            worth = lambda p: field.first[p[0]] + sum(own[t, x] for t, x in enumerate(p)) + sum(field.steps[x, y] for x, y in itertools.pairwise(p))  # noqa: B023, E731
            best = max(worth(p) for p in itertools.product(range(len(pii_crf.TAGS)), repeat=len(own)))
            assert worth(tuple(got[row == i])) == pytest.approx(best, abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(4)
    k = len(pii_crf.TAGS)
    score, steps, first = rng.normal(size=(3, 4, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    live = np.arange(4) < np.array([4, 2, 1])[:, None]
    gold = rng.integers(0, k, size=(3, 4))
    value, by_score, by_step, by_first = pii_crf.likelihood(score, live, gold, steps, first)
    own = score[1]
    paths = np.exp([first[a] + own[0, a] + steps[a, b] + own[1, b] for a in range(k) for b in range(k)]).sum()
    a, b = gold[1, :2]
    alone = pii_crf.likelihood(score[1:2], live[1:2], gold[1:2], steps, first)[0]
    assert alone == pytest.approx(first[a] + own[0, a] + steps[a, b] + own[1, b] - np.log(paths))
    for array, grad in ((score, by_score), (steps, by_step), (first, by_first)):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in array.shape)
            array[at] += 1e-5
            more = pii_crf.likelihood(score, live, gold, steps, first)[0]
            array[at] -= 1e-5
            assert (more - value) / 1e-5 == pytest.approx(grad[at], abs=1e-3)


def found(field, text):
    spans = pii_crf.field_spans(field, next(W.chunks(pa.array([text, "other"])))).get(0, [])
    return {(pii_crf.KINDS[k], text[a:b]) for a, k, b in spans}


def test_held_out_examples(field):
    right = wrong = missed = 0
    for text, spans in pii_crf.examples(600, seed=99):
        want = set()
        for s in spans:
            a, b = pii_crf._trim(s["kind"], text, s["start"], s["stop"])
            if pii_crf._holds(s["kind"], text[a:b]):
                want.add((s["kind"], text[a:b]))
        got = found(field, text)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.95


def test_what_patterns_leave(field):
    text = "der ein 4465758382889437 4465758382889437 und, +1 (743) 555-3824 4465758382889437 ies."
    assert pii_crf.pattern_spans(text) == []
    assert found(field, text) == {("card", "4465758382889437"), ("phone", "+1 (743) 555-3824")}
    assert ("name", "Thea Stone") in found(field, "the on Mrs. Thea Stone in re")
    assert found(field, "The words are. Plain, and 1999 or 3.14 the! Stand at the dot") == set()


ROWS = [
    (1, None),
    (2, ""),
    (3, "mail é.a@b.com, 8.196.197.208 and 300.1.1.1"),
    (4, "日本 +1 (743) 555-3824 4465758382889437"),
    (4, "日本 +1 (743) 555-3824 4465758382889437"),
    (None, "a@b.c"),
    (5, "the words " * 20_000 + "x@y.zz"),
    (6, "4465758382889437 " * 300),
    (7, "1" * 100_000),
]


def test_rows(spark, docs):
    out = pii_crf.personal_data(docs(*ROWS).repartition(3))
    got = {}
    for r in pii_crf.digests(out).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert len(got) == 8
    for doc_id, text in ROWS:
        base = plain_spans(text or "") if doc_id != 7 else []
        written = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base)
        row = got[doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) - {""} <= set(row.spans.split(","))
    assert got[4].spans == "phone:3:20,card:21:37"
    assert got[6].spans.count("card") == 300
    assert pii_crf.personal_data(docs()).collect() == []


def test_own_labels(spark, docs):
    rows = [("order 77-12 came", [{"kind": "card", "start": 6, "stop": 11}]), (None, None), ("nothing", None), ("x", [{"kind": "other", "start": 0, "stop": 1}])]
    out = pii_crf.personal_data(docs((1, "order 88-13 came")), spark.createDataFrame(rows, pii_crf.LABELLED))
    assert out.select(F.size("spans")).first()[0] == 0  # no card passes without its digits
    assert pii_crf.personal_data(docs((1, "a@b.cc")), spark.createDataFrame([], pii_crf.LABELLED)).first().spans[0].kind == "email"
