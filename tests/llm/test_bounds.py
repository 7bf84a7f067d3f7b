"""What operators hold on disk, on the driver and near the processor doesn't change their results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe_automaton, decontaminate, ngram_jaccard, pii_crf, queries, staging, toxicity
from tallyhouse.llm import words as W


def test_a_fine_segment_inside_a_found_region_is_not_aligned(monkeypatch):
    item = " ".join(f"word{i * i % 97} of{i}" for i in range(60))
    own = decontaminate.plain(item)
    text = b"before " + own[:230] + b"#" + own[231:430] + b" behind"
    index = decontaminate.Index([(1, item)])
    aligned = []
    real = decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda s, t, k: aligned.append(len(s)) or real(s, t, k))
    found = index.passages(text)
    assert found and sum(n == decontaminate.FINE for n in aligned) < 12


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_dense_places_as_counted_one_by_one(width):
    index = decontaminate.Index([])
    index.kinds = [(width, 3), (2 * width, 5)]
    rng = np.random.default_rng(width)
    at = np.sort(rng.choice(2000, 300, replace=False))
    want = set()
    for size, need in index.kinds:
        for p in at:
            inside = at[(at >= p) & (at < p + size)]
            want |= set(inside.tolist()) if len(inside) >= need else set()
    assert index.dense(at).tolist() == sorted(want)


def test_scores_do_not_depend_on_pieces(monkeypatch):
    monkeypatch.setattr(pii_crf, "STEPS", 5)
    field = pii_crf.train(*zip(*pii_crf.examples(60)))
    chunk = next(W.chunks(pa.array([t for t, _ in pii_crf.examples(40, seed=3)])))
    found, seen = pii_crf.observe(chunk)
    whole = field.scores(seen, found.row)
    monkeypatch.setattr(pii_crf, "PIECE", 7)
    assert (field.scores(seen, found.row) == whole).all()
    assert (field.decode(whole, found.row) != 0).any()


def test_passes_split_the_n_grams(spark, docs, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j + (j == i % 3) * 1000}" for j in range(60))) for i in range(30)]
    found = {}
    for passes in (1, 4):
        monkeypatch.setattr(ngram_jaccard, "PASSES", passes)
        seen = []
        real = ngram_jaccard._Join.repeated

        def spy(self, one, turn, real=real, seen=seen):
            got = real(self, one, turn)
            seen.append({r.gram for r in got.select("gram").distinct().collect()})
            return got

        monkeypatch.setattr(ngram_jaccard._Join, "repeated", spy)
        found[passes] = sorted(map(tuple, ngram_jaccard.near_duplicates(docs(*rows)).select("doc_id", "n_shingles", "component_id").collect()))
        monkeypatch.setattr(ngram_jaccard._Join, "repeated", real)
        assert len(seen) == passes and sum(map(len, seen)) == len(set().union(*seen)) > 0
    assert found[1] == found[4]


def test_the_sample_stays_off_the_driver(spark, monkeypatch):
    """The driver trains nothing and gets one row: the weights and the ids."""
    monkeypatch.setattr(toxicity, "train", None)
    rows = [(i, ("vile awful " if i % 3 == 0 else "good day ") * 5 + f"w{i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model, seen = toxicity.learnt(docs, toxicity._known(labels, 2, 4))
    assert model.embed.shape == (toxicity.BUCKETS, toxicity.SIZE) and 0 < len(seen) <= 240
    low, high = model.scores(next(W.chunks(pa.array(["good day", "vile awful"]))))
    assert low < 0.3 < high


def test_texts_go_to_the_classifier_some_at_a_time(spark, docs, monkeypatch):
    """Also where the caller's plan runs later, with the session's own size of batches."""

    def sizes(shared, name="toxicity"):
        def run(batches):
            for batch in batches:
                at = [batch.schema.get_field_index(c) for c in ("row", "lang")]
                made = pa.array([float(batch.num_rows)] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([*map(batch.column, at), made], ["row", "lang", name])

        return run

    monkeypatch.setattr(toxicity, "fit", lambda docs, *_: (None, docs.sparkSession.createDataFrame([], "lang string, threshold double")))
    monkeypatch.setattr(toxicity, "_run", sizes)
    rows = [(i, "some words") for i in range(3000)] + [(i, "long " * 100_000) for i in range(3000, 3040)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = toxicity.toxicity(docs(*rows).coalesce(1), None).select("row.doc_id", "score").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    assert max(r.score for r in got) <= 500 and max(r.score for r in got if r.doc_id >= 3020) <= 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_common_q_grams_alone_are_not_sorted(monkeypatch):
    """A text of an item's q-grams, none with enough others on a diagonal, falls out before bands are sorted."""
    rng = np.random.default_rng(4)
    known = ["".join(chr(97 + k) for k in rng.integers(0, 26, 10)) for _ in range(300)]
    items = [(i, " ".join(known[k] for k in rng.integers(0, 300, 40))) for i in range(20)]
    index = decontaminate.Index(items)
    text = decontaminate.plain(" ".join(known[k] for k in rng.integers(0, 300, 400)))
    values = decontaminate.grams(np.frombuffer(text, dtype=np.uint8))
    assert len(index.dense(np.flatnonzero(index.table[decontaminate._slot(values)]))) > 500
    sorted_ = []
    real = np.unique
    monkeypatch.setattr(decontaminate.np, "unique", lambda x, *a, **k: sorted_.append(len(x)) or real(x, *a, **k))
    assert index.passages(text) == [] and sum(sorted_) < 200
    assert {x[0] for x in index.passages(text + b" " + decontaminate.plain(items[7][1]))} == {7}


def test_hits_beside_each_other_stay():
    index = decontaminate.Index([(i, "a line of some words that is long enough " * 3) for i in range(3)])
    rng = np.random.default_rng(5)
    for n in (3, 60, 4000):
        owner, band = rng.integers(0, 3, n), rng.integers(-40, n // 4, n)
        owner[: n // 3], band[: n // 3] = 1, np.repeat([7, 8], n)[rng.integers(0, 2 * n, n // 3)]
        seen = {}
        for line in zip(owner.tolist(), band.tolist()):
            seen[line] = seen.get(line, 0) + 1
        kept = index.beside(owner, band)
        for k, (o, b) in enumerate(zip(owner.tolist(), band.tolist())):
            beside = max(seen.get((o, b - 1), 0), seen.get((o, b + 1), 0))
            assert kept[k] or seen[o, b] + beside < index.least[o]


def test_texts_go_to_the_n_grams_some_at_a_time(spark, docs, monkeypatch):
    """Both where sets are signed and where they are cut in fragments."""

    def small(real):
        def made(*bounds):
            run = real(*bounds)

            def checked(batches):
                def each():
                    for batch in batches:
                        if batch.num_rows > 500 or batch.num_rows > 20 and batch.nbytes > 12 << 20:
                            raise ValueError(f"{batch.num_rows} rows, {batch.nbytes} bytes")
                        yield batch

                return run(each())

            return checked

        return made

    rows = [(i, f"one two three four five six w{i // 2} seven eight nine") for i in range(2400)]
    rows += [(i, f"w{i // 2} {i // 2} " + "long " * 100_000) for i in range(2400, 2440)]
    table = docs(*rows).coalesce(1)
    want = sorted(map(tuple, ngram_jaccard.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()))
    for name in ("_sign", "_fragments"):
        monkeypatch.setattr(ngram_jaccard, name, small(getattr(ngram_jaccard, name)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(map(tuple, ngram_jaccard.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == want and all(c == i - i % 2 for i, _, c in got if i < 2400)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_worker_keeps_the_automaton_but_not_its_notes(monkeypatch):
    """A worker lives on in the tasks of other operators; its notes of texts are bounded and go with the task."""
    for name in ("KEPT_STRETCHES", "KEPT_WORDS", "KEPT_ARCS"):
        assert getattr(bpe_automaton, name) <= 1 << 16
    with open(queries.vocabulary_path(), encoding="utf-8") as file:
        definition = file.read()

    class Shared:
        value = definition

    texts = [f"some words of number{i} and qxzvwkj{chr(97 + i % 26)}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    made = bpe_automaton._run(Shared)(iter([batch, batch]))
    first = next(made).to_pylist()
    automaton = bpe_automaton.compiled(definition)
    notes = (automaton.known, automaton.words, automaton.stretches)
    assert all(notes) and next(made).to_pylist() == first
    assert list(made) == [] and not any(len(x) + len(x.old) for x in notes)
    assert bpe_automaton.compiled(definition) is automaton
    assert next(bpe_automaton._run(Shared)(iter([batch]))).to_pylist() == first


def test_new_words_are_encoded_side_by_side(monkeypatch):
    """Not one by one, but for a few; as the tokenizers library does it."""
    import random

    from tokenizers import Tokenizer

    with open(queries.vocabulary_path(), encoding="utf-8") as file:
        definition = file.read()
    rng = random.Random(5)
    parts = ["th", "er", "ing", "é", "ß", "qx", "9", "'ll", "-", "A", "ation", "zz", "ou", "s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) + " " + " ".join("".join(rng.choices(parts, k=rng.randint(2, 14))) for _ in range(60)) for _ in range(200)]
    texts += [None, "", " \t\n", "a" * 700, "日本語 <|endoftext|>x", "\n" + "ab" * 31 + " " + "ab" * 32 + " "]

    class Shared:
        value = definition

    automaton, one_by_one, alone = bpe_automaton.compiled(definition), [], bpe_automaton.Automaton.encode_word
    monkeypatch.setattr(bpe_automaton.Automaton, "encode_word", lambda self, word: one_by_one.append(word) or alone(self, word))
    library = Tokenizer.from_str(definition)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for made in bpe_automaton._run(Shared)(iter([batch])):
        for row in made.to_pylist():
            ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
            assert (row["n_tokens"], row["ids"], row["decoded"]) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    assert len(one_by_one) < 500
    words = ["".join(rng.choices(automaton.signs, k=rng.randint(1, 12))) for _ in range(500)]
    assert automaton.abreast.both_ways(words) == [automaton._word(w) for w in words]


def test_a_worker_gives_freed_memory_back_and_sends_some_rows_at_a_time(monkeypatch):
    given = []
    monkeypatch.setattr(staging, "give_back", lambda: given.append(1))
    run = staging.tidy(lambda batches: (b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2] and given == [1]
    monkeypatch.undo()
    staging.give_back()
    with open(queries.vocabulary_path(), encoding="utf-8") as file:
        definition = file.read()

    class Shared:
        value = definition

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["some words"] * 1000)], ["doc_id", "text"])
    sizes = [made.num_rows for made in bpe_automaton._run(Shared)(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 300
