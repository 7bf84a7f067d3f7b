"""Aligned tokens against a plain Python version that compares all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import corpus, prose
from pyspark.sql import functions as F

from tallyhouse.llm import queries, token_alignment

HOSTILE = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "a"),
    (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, "naïve 日本語 \U0001f600\t\r\n\x00 ok"),
    (7, "one ▁ two"),
    (8, "plain words, plain words; plain words!  "),
    (8, "plain words, plain words; plain words!  "),
    (None, "no id but text"),
    (9, "x" * 5000),
    (10, "é   　 ﻿"),
    (11, "word " * 3000),
]


def plain(rows, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    value = {s: i for i, s in enumerate(token_alignment.byte_signs())}
    spans, found = [], []
    for _, text in rows:
        text = text or ""
        at, own_a, own_b = 0, [], []
        for i in a.encode(" " + text, add_special_tokens=False).ids:
            piece = bytes(value[s] for s in a.id_to_token(i))
            own_a.append((i, at, at + len(piece), piece))
            at += len(piece)
        at = 0
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            piece = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
            own_b.append((i, at, at + len(piece), piece))
            at += len(piece)
        if not text or b"".join(t[3] for t in own_a) != (" " + text).encode() or b"".join(t[3] for t in own_b) != (" " + text).encode():
            own_a, own_b = [], []
        spans.append((own_a, own_b))
        links, first = [], 0
        for x in own_a:
            for y in own_b[max(0, first - 1) :]:
                if y[1] >= x[2]:
                    break
                first += y[2] <= x[1]
                if x[1] < y[2] and y[1] < x[2]:
                    links.append((x[0], y[0]))
        found.append(links)
    count = Counter(p for links in found for p in set(links))
    most = {}
    for (i, _), c in count.items():
        most[i] = max(most.get(i, 0), c)
    out = []
    for (doc_id, _), (own_a, own_b), links in zip(rows, spans, found, strict=True):
        groups, last = [], 0
        for cut in sorted({t[2] for t in own_a} & {t[2] for t in own_b}):
            sides = (",".join(str(t[0]) for t in s if last <= t[1] < cut) for s in (own_a, own_b))
            groups.append("|".join(sides))
            last = cut
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc_id, len(own_a), len(own_b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


@pytest.fixture
def paths():
    return queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")


@pytest.mark.parametrize("head", [0, 40, 1 << 17])
def test_against_all_pairs(docs, paths, head, monkeypatch):
    rows = HOSTILE + corpus()[:25]
    monkeypatch.setattr(token_alignment, "SLICE", 2000)
    got = token_alignment.align(docs(*rows).repartition(3), *paths, head=head).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, *paths)
    none = {r.doc_id: r for r in got if r.doc_id in (1, 7)}
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in none.values())


def test_counts_do_not_depend_on_what_a_task_holds(docs, paths):
    rows = corpus()[:12]
    found = token_alignment.Alignment(docs(*rows).repartition(5), *paths)
    one = {tuple(r) for r in found.counts.select("a", "b", "c").collect()}
    run = token_alignment._count(found.files)
    held, token_alignment.HELD = token_alignment.HELD, 10
    try:
        parts = [b for batch in found.encoded.toArrow().to_batches() for b in run(iter([batch]))]
    finally:
        token_alignment.HELD = held
    total = Counter()
    for part in parts:
        for code, c in zip(part["code"].to_pylist(), part["c"].to_pylist(), strict=True):
            total[code] += c
    assert {(k >> 32, k & 0xFFFFFFFF, c) for k, c in total.items()} == one
    shares = found.links().filter("share = 1").select("a").distinct().count()
    assert shares == len({a for a, _, _ in one})


def test_empty_table(docs, paths):
    got = token_alignment.align(docs().filter(F.lit(True)), *paths)
    assert got.collect() == [] and got.columns[0] == "doc_id"


def test_text_that_tokens_do_not_spell():
    made = token_alignment.Aligned(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(2, int), np.zeros(2, int), np.ones(1, int), np.ones(1, int))
    assert made.texts() == [b"", b""] and made.groups().tolist() == [0, 0]


def test_stretches_give_what_whole_texts_give(paths):
    with open(paths[0], encoding="utf-8") as a, open(paths[1], "rb") as b:
        encoder = token_alignment.Encoder(a.read(), b.read())
    assert encoder.cuts and encoder.sides[0].encode_plain is not encoder.sides[0].encode
    rng = random.Random(6)
    signs = "abcdefghij  \n\t\r.,'sretvmld0123éßÜ-_<|>" + "".join(map(chr, range(33, 127)))
    texts = [" " + "".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += [" " + " ".join(prose(i, 200)) for i in range(40)] + [" " + "ab" * 100_000, " " + " " * 3000 + "\n" * 3000]
    for text, both in zip(texts, encoder.ids(texts), strict=True):
        for side, ids in zip(encoder.sides, both, strict=True):
            assert ids.tolist() == (side.encode(text) if len(text) > 1 else [])
