"""Ranked search against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import corpus, lower, prose

from tallyhouse.llm import block_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, score long, term long"


def terms(text):
    return TERM.findall(lower(text))


def plain(rows, items, k):
    bags = [(i, Counter(terms(t))) for i, t in rows]
    size = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for (doc_id, bag), n in zip(bags, size, strict=True):
            score = 0
            for t in own & bag.keys():
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def asked(rows, seed=3):
    rng = random.Random(seed)
    out = [(0, None), (1, ""), (2, "nothing-of-this é"), (None, "one two"), (3, "one"), (3, "A b C")]
    for i in range(10, 24):
        own = terms(rng.choice(rows)[1] or "") or ["x"]
        out.append((i, " ".join(rng.sample(own, min(len(own), rng.randrange(1, 40)))) + " ONE w7"))
    out.append((30, " ".join(rng.choice(rows)[1] or "" for _ in range(20))))
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD", 9), ("ENTRIES", 900), ("BLOCK", 2), ("SEEDS", 3)):
        monkeypatch.setattr(block_search, name, value)


@pytest.mark.parametrize(("k", "vocabulary"), [(10, 1 << 17), (3, 1 << 17), (1, 200)])
def test_against_all_documents(spark, docs, small, monkeypatch, k, vocabulary):
    monkeypatch.setattr(block_search, "VOCABULARY", vocabulary)
    rows = corpus()
    items = asked(rows)
    got = block_search.search(docs(*rows).repartition(3), spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, items, k)


def test_ties_and_copies(spark, docs, small):
    text = " ".join(prose("tie", 40, 50))
    rows = [(i, text) for i in range(60, 0, -1)] + [(i, " ".join(prose(i, 30, 60))) for i in range(100, 140)]
    items = [(1, text), (2, " ".join(prose("tie", 3, 50)))]
    got = block_search.search(docs(*rows).repartition(5), spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS))
    assert sorted(map(tuple, got.collect())) == plain(rows, items, 10)
    assert [r.doc_id for r in got.filter("item_id = 1").orderBy("rank").collect()] == list(range(1, 11))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    assert block_search.search(docs((1, "a b")), none).collect() == []
    some = spark.createDataFrame([(1, "a b", 1, 2, 3)], ITEMS)
    assert block_search.search(docs(), some).collect() == []
    assert block_search.search(docs((1, None), (2, "")), some).collect() == []


def test_blocks_hold_each_row_once_and_similar_rows():
    rng = np.random.default_rng(1)
    kinds = rng.standard_normal((4, 24)).astype(np.float32)
    sketch = np.repeat(kinds, 50, axis=0) + 0.01 * rng.standard_normal((200, 24)).astype(np.float32)
    order, ends = block_search.cluster(sketch, 16)
    assert sorted(order) == list(range(200)) and ends[-1] == 200 and np.diff(np.append(0, ends)).max() <= 32
    assert all(len(set(x // 50)) == 1 for x in np.split(order, ends[:-1]))


def test_blocks_are_skipped(spark, docs, monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK", 8)
    rng = random.Random(2)
    kinds = [rng.sample([f"w{i}" for i in range(200)], 40) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(kinds[i % 40], 37))) for i in range(2400)]
    wanted = " ".join(kinds[0][:15])
    pass_ = block_search.Search(docs(*rows), *query(spark, wanted), 3, block_search.Stage(spark, "block-search"))
    found = pass_.run().collect()
    assert {(r.doc_id, r.score) for r in found} >= {(d, s) for _, _, d, s in plain(rows, [(1, wanted)], 3)}
    least = pass_.thresholds()
    known = pass_.known(essential=[[int(t) for t in e] for e in pass_.essential(least)], least=least)
    best, weights = block_search.Best(1, 3), np.zeros(known["size"], np.int64)
    counts = [block_search._search_shard({c: np.array(r[c]) for c in pass_.index.columns}, known, best, weights) for r in pass_.index.collect()]
    met, opened = map(sum, zip(*counts, strict=True))
    assert 0 < opened < met / 2, (opened, met)


def query(spark, text):
    pairs = spark.createDataFrame([(1, text)], "item_id long, text string").mapInArrow(block_search._query_terms, "item_id long, term long").distinct().toPandas()
    return pairs["term"].to_numpy(np.int64), pairs["item_id"].to_numpy(np.int64)
