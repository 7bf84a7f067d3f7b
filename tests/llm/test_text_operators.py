"""Operators on documents against plain Python, on hostile rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import corpus, lower, prose, words
from pyspark.sql import functions as F

from tallyhouse.llm import bpe_automaton, decontaminate, license_scan, maxent_lm, ngram_jaccard, queries, substring_dedup, toxicity


def cut(rows, n):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[s : s + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - n + 1):
            if i is not None and first[tuple(w[s : s + n])] < i:
                gone.update(range(s, s + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("n", [20, 50])
def test_repeats(docs, n):
    rows = corpus()
    got = substring_dedup.cut_repeats(docs(*rows), n).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert ordered(got) == ordered(cut(rows, n))


def test_repeats_keep_columns_and_layout(docs):
    text = " ".join(prose("p", 60))
    out = {r.doc_id: r for r in substring_dedup.cut_repeats(docs((1, text.replace(" ", "  ")), (2, text)), keep_layout=True).collect()}
    assert out[1].kept_text == text.replace(" ", "  ") and out[1].row.n_words == 1
    assert out[2].kept_text == "" and [tuple(s) for s in out[2].repeats] == [(0, 60)]


def test_repeats_across_slices(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    text = " ".join(prose("long", 500))
    got = substring_dedup.cut_repeats(docs((1, text), (2, "x " + text))).select("n_removed").collect()
    assert sorted(r[0] for r in got) == [0, 500]


def components(rows):
    sets = []
    for i, t in rows:
        w = words(lower(t))
        sets.append((i, {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, x) in enumerate(sets):
        if i is not None and x:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(x), least[find(a)] if i is not None and x else i) for a, (i, x) in enumerate(sets)]


def test_near_duplicates(docs):
    rows = corpus()
    got = ngram_jaccard.near_duplicates(docs(*rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(components(rows))


@pytest.mark.parametrize("crowd, block", [(64, 512), (1, 8), (1, 64)])
def test_a_group_of_copies_changed_in_many_places(docs, monkeypatch, crowd, block):
    """Also where pairs are counted in cells, of one block and of several."""
    monkeypatch.setattr(ngram_jaccard, "CROWD", crowd)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    if crowd == 1:
        monkeypatch.setattr(ngram_jaccard, "ROUNDS", 1)
    base, rows = prose("base", 130), []
    for i in range(40):
        own = list(base)
        for k in range(i % 7):
            own[(i * 37 + k * 29) % 130] = f"new{i}"
        rows.append((i, " ".join(own)))
    got = ngram_jaccard.near_duplicates(docs(*rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(components(rows))


def test_one_of_each(docs):
    rows = corpus()
    kept = ngram_jaccard.one_of_each(docs(*rows))
    assert kept.columns == docs(*rows).columns
    want = {r[0] for r in components(rows) if r[0] == r[2]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i in want} | {None: 1, 13: 2})


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 11, "keep"), (2, "a b c d e f", 12, "x"), (3, None, 13, None), (None, "a b c d e f", 14, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc long, _TEXT string")
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert ordered(kept.collect()) == ordered([rows[0], rows[2], rows[3]])


def test_licenses(docs):
    rows = [(1, "Released UNDER the MIT-License; cc by nc cc by nc"), (2, None), (3, "Licensed undr the Apache License, Version 2.O and so on"), (4, "undermit license"), (5, "é under the mit licenseé"), (None, "x under the mit license")]
    got = {r.doc_id: r for r in license_scan.license_labels(license_scan.license_spans(docs(*rows))).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (11, 3, 1, 8, "cc-by-nc,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[3].base_labels == "apache-2" or "apache-2" in got[3].labels
    assert got[4].n_base == 0 and got[5].n_base == 0 and got[None].n_base == 1 and got[None].score == 1.0


def test_every_notice_within_its_edits_is_found():
    for text, label in license_scan.NOTICES.items():
        notice = license_scan.Notice(text, label)
        own = list(f"some words {text} more words")
        for k in range(notice.edits):
            own[11 + 9 * k + 4] = "#"
        assert any(e == notice.edits for _, _, e in notice.matches("".join(own).encode()))


def test_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    texts = [None, "", " \n", "It's I'LL don't", "<|endoftext|>hi<|startoftext|>x", "ÀÉ́ ΟΔΟΣ İstanbul ﬁ ½ x²", "日本語 한국어 😀👍🏽", "a" * 3000, "a\x1cb\x85c\xadd", " ".join(prose(3, 5000))]
    got = bpe_automaton.encode_decode(docs(*enumerate(texts)), queries.vocabulary_path()).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_language_model(docs):
    rows = [(i, t) for i, t in corpus()]
    got = maxent_lm.scored(docs(*rows)).collect()
    tokens = lambda t: [*words(lower(t)), None]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows]
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == ordered(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_rare_tokens_count_alike(docs, monkeypatch):
    rows = corpus()
    whole = maxent_lm.scored(docs(*rows)).select("doc_id", "n_known", F.round("base_score", 6)).collect()
    monkeypatch.setattr(maxent_lm, "TOP", 16)
    assert ordered(maxent_lm.scored(docs(*rows)).select("doc_id", "n_known", F.round("base_score", 6)).collect()) == ordered(whole)


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(maxent_lm, "SHARE", 2000)
    monkeypatch.setattr(maxent_lm, "STEP", 256)
    rows, found = corpus(), []
    for n in (1, 3, 16):
        table = docs(*rows).repartition(n, "n_chars")
        found.append(sorted((repr(r.doc_id), r.n_tokens, r.score) for r in maxent_lm.scored(table).collect()))
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert [x[2] for x in other] == pytest.approx([x[2] for x in found[0]], rel=1e-5)


def test_gradient_steps_follow_the_slope():
    rng = np.random.default_rng(2)
    bias = rng.standard_normal(maxent_lm.N_CLASSES).astype(np.float64)
    weights = rng.standard_normal((3, 8, maxent_lm.N_CLASSES))
    features, kind = rng.integers(0, 8, (3, 40)), rng.integers(0, maxent_lm.N_CLASSES, 40)

    def loss(w):
        logits = maxent_lm._logits(bias, w, features)
        return -(logits[np.arange(40), kind] - np.log(np.exp(logits).sum(axis=1))).sum()

    square, moved = np.zeros_like(weights), weights.copy()
    maxent_lm._descend(bias, moved, square, features, kind)
    slope = np.sqrt(square) * np.sign(weights - moved)  # of a first step
    for _ in range(30):
        at = tuple(rng.integers(0, n) for n in weights.shape)
        near = weights.copy()
        near[at] += 1e-6
        assert (loss(near) - loss(weights)) / 1e-6 == pytest.approx(slope[at], abs=1e-3)
    assert loss(moved) < loss(weights)


def test_buckets_grow_with_the_tokens():
    bits = [maxent_lm.bucket_bits(n) for n in (0, 1 << 18, 1 << 26, 1 << 32, 1 << 60)]
    assert bits == sorted(bits) and bits[0] == 13 and bits[-1] == 16 and bits[3] > bits[1]


def test_leaks(docs, spark):
    item = " ".join(prose("item", 40))
    near = item.replace("w", "v", 3)
    items = spark.createDataFrame([(7, item, 1), (8, "short", 1), (9, None, 1), (None, item, 1)], "item_id long, text string, doc_id int")
    rows = [(1, "before " + item.upper() + " after"), (2, near), (3, " ".join(prose("other", 300))), (4, None), (5, ""), (None, item), (1, "clean")]
    got = [(r.doc_id, r.contaminated, r["items"]) for r in decontaminate.leaks(decontaminate.leaked_regions(docs(*rows), items)).collect()]
    assert ordered(got) == ordered([(1, True, [7]), (2, True, [7]), (3, False, []), (4, False, []), (5, False, []), (None, True, [7]), (1, False, [])])
    kept = decontaminate.without_leaks(docs(*rows), items)
    assert kept.columns == docs(*rows).columns and ordered(r.doc_id for r in kept.select(F.struct("doc_id").alias("doc_id")).collect()) == ordered([(3,), (4,), (5,), (1,)])


def test_alignment_against_all_edits():
    import random

    rng = random.Random(5)

    def least(segment, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(segment):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(200):
        segment = bytes(rng.choice(b"abcd") for _ in range(40))
        own = bytearray(segment)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(2)))
        text = bytes(rng.choice(b"abcd") for _ in range(3)) + bytes(own) + bytes(rng.choice(b"abcd") for _ in range(3))
        found, want = decontaminate.align(segment, text, 4), least(segment, text)
        assert (found[0] if found else None) == (want if want <= 4 else None)


def test_toxicity(docs, spark):
    rows, labels = [], []
    for i in range(300):
        own = prose(i, 60)
        if i % 4 == 0:
            own[i % 60] = f"vequ{i}"
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0), "x"))
    rows += [(1000, None), (1001, ""), (None, "vequx")]
    labels += [(None, 1, "x"), (5000, 1, "x"), (3, None, "x")]
    known = spark.createDataFrame(labels, "doc_id long, toxic int, lang string")
    got = toxicity.toxicity(docs(*rows), known, carry=["doc_id"]).select("row.doc_id", "held_out", "score").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    nothing = toxicity.toxicity(docs(*rows), known.filter("toxic = 5")).collect()
    assert len({round(r.score, 9) for r in nothing}) == 1 and nothing[0].row.n_words == 1


def test_empty_tables(docs, spark):
    empty = docs((1, "x")).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    known = spark.createDataFrame([], "doc_id long, toxic int")
    made = [
        substring_dedup.cut_repeats(empty),
        ngram_jaccard.near_duplicates(empty),
        ngram_jaccard.one_of_each(empty),
        license_scan.license_labels(license_scan.license_spans(empty)),
        bpe_automaton.encode_decode(empty, queries.vocabulary_path()),
        maxent_lm.scored(empty),
        decontaminate.leaks(decontaminate.leaked_regions(empty, items)),
        toxicity.toxicity(empty, known),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_digest_of_kept_words(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert ordered(got) == ordered((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cut(rows, 50))


def by_bins(scores, labels):
    bins = {}
    for x, t in zip(scores, labels, strict=True):
        k = math.floor(math.log(x / (1 - x) / (0.3 / 0.7)) * toxicity.BINS + 1e-9)
        own = bins.setdefault(k, [0, 0, x, x])
        bins[k] = [own[0] + t, own[1] + 1, min(own[2], x), max(own[3], x)]
    return bins


def errors(scores, labels, at):
    return sum((x >= at) != t for x, t in zip(scores, labels, strict=True))


def test_a_language_has_its_own_threshold_only_where_that_is_surely_better():
    rng = np.random.default_rng(3)
    better = worse = 0
    for trial in range(200):
        shift = rng.choice([-4.0, -1.0, 0.0, 0.0, 2.0])
        toxic = rng.random(600) < 0.2
        scores = 1 / (1 + np.exp(-(np.where(toxic, 2.5, -4.0) + shift + rng.standard_normal(600) * 2)))
        limit = toxicity.threshold_of(by_bins(scores[:300], toxic[:300].astype(int)))
        own, common = (errors(scores[300:], toxic[300:], x) for x in (limit, toxicity.THRESHOLD))
        better, worse = better + (own < common), worse + (own > common + 2)
        if limit != toxicity.THRESHOLD:
            first = [errors(scores[:300], toxic[:300], x) for x in (limit, toxicity.THRESHOLD)]
            assert first[0] <= min(errors(scores[:300], toxic[:300], x) for x in [*scores[:300], 2.0]) + 3 and first[1] - first[0] > 2 * sum(first) ** 0.5
    assert better > 20 and worse <= 4
    assert toxicity.threshold_of({0: [5, 9, 0.3, 0.31]}) == toxicity.THRESHOLD
    assert toxicity.threshold_of({-40: [60, 60, 0.1, 0.12], -70: [0, 200, 0.01, 0.05]}) == pytest.approx(0.075)
    assert toxicity.threshold_of({3: [0, 60, 0.4, 0.5], 40: [30, 30, 0.6, 0.7]}) == pytest.approx(0.55)


def test_thresholds_of_languages_in_a_table(spark, monkeypatch):
    """Those of all labelled rows that are not learnt from; null is no language, and not the text None."""
    rows, labels = [], []
    for i in range(600):
        own = prose(i, 40)
        if i % 4 == 0:
            own[i % 40] = f"vequ{i}"
        rows.append((i, " ".join(own), ("None", None, "en")[i % 3]))
        labels.append((i, int(i % 4 == 0)))
    texts, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ROWS", 100)
    monkeypatch.setattr(toxicity, "threshold_of", lambda bins: 0.6 if sum(b[1] for b in bins.values()) > 50 else 0.3)
    model, limits = toxicity.fit(texts, known)
    assert {r.lang: r.threshold for r in limits.collect()} in ({"None": 0.6, "en": 0.6}, {})
    monkeypatch.setattr(toxicity, "fit", lambda *_: (model, spark.createDataFrame([("None", 0.9)], "lang string, threshold double")))
    got = toxicity.toxicity(texts, known, carry=["doc_id", "lang"]).select("row.lang", "threshold", "score", "flagged").collect()
    assert len(got) == 600
    assert {(r.lang, r.threshold) for r in got} == {("None", 0.9), (None, 0.3), ("en", 0.3)}
    assert all(r.flagged == (r.score >= r.threshold) for r in got)


def least_edits(segment, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(segment):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_passages_at_either_end_of_a_text():
    """Items of one segment that lack letters, or have others, where the text begins or ends."""
    import random

    rng = random.Random(11)
    for n in range(300):
        made = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
        item = b" ".join(made[:25])[: rng.randrange(40, 97)].strip()
        own, k = bytearray(item), decontaminate.edit_budget(len(item))
        at, gone = rng.randrange(len(own) - k), rng.randrange(1, k + 1)
        own[at : at + gone] = bytes(rng.choice(b"qxz") for _ in range(rng.choice([0, 0, gone])))
        parts = [bytes(own), *made[25:]] if n % 2 else [*made[25:], bytes(own)]
        text = decontaminate.plain(b" ".join(parts).decode())
        found = [edits for *_, edits, fine in decontaminate.Index([(1, item.decode())]).regions(text) if not fine]
        want = least_edits(item, text)
        assert (min(found) if found else None) == (want if want <= k else None), (n, item, text)


def test_excerpts_at_every_offset():
    size = decontaminate.FINE + decontaminate.FINE_STEP - 1
    item = decontaminate.plain(" ".join(prose("long", 60)))
    before, after = (decontaminate.plain(" ".join(prose(x, 30))) for x in ("before", "after"))
    for own in (item, item[:200], item[: size + 9]):
        index = decontaminate.Index([(1, " ".join(prose("another", 60))), (7, own.decode(errors="ignore"))])
        own = decontaminate.plain(own.decode(errors="ignore"))
        for at in range(len(own) - size + 1):
            text = before + b" " + own[at : at + size] + b" " + after
            found = index.passages(text)
            assert found and all(x[0] == 7 and x[1] < len(before) + 1 + size and x[2] > len(before) for x in found), at
            assert index.passages(own[at : at + size]), at
    assert not index.passages(before + b" " + after)


def test_edited_notices_beside_exact_ones():
    for text in license_scan.NOTICES:
        notice = license_scan.Notice(text, "x")
        own = text.encode()
        edited = own.replace(b"e", b"x", 1)
        for parts in ([edited, own], [own, edited], [edited, own, edited], [edited, edited, own, own, edited]):
            whole = b" " + b" ".join(parts) + b" "
            found = list(notice.matches(whole))
            assert [e for *_, e in found] == [int(p == edited) for p in parts], parts
            assert all(y[0] >= x[1] for x, y in zip(found, found[1:], strict=False))
