"""Vectors, chats, web records, the pipeline, and the SQL of the queries."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import chat_format, embedding_dedup, oracles, queries, warc
from tallyhouse.llm.components import components
from tallyhouse.llm.staging import Stage

DATA = "/root/testdata/sf0.001"


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((6, 16))
    for i in range(120):
        v = base[i % 6] + rng.standard_normal(16) * (0.12 if i % 2 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in (v if i % 10 else base[0])], i % 3 if i % 11 else None, "x"))
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [math.nan] * 16, [math.inf] * 16, [1.0] * 5]
    rows += [(200 + k, v, 1, "x") for k, v in enumerate(odd)] + [(None, rows[1][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    good = {i: (np.array(v), label) for i, v, label, _ in rows if i is not None and i < 200 and label is not None}
    near = {i: [j for j in good if j != i and good[j][1] == good[i][1] and good[i][0] @ good[j][0] / np.linalg.norm(good[i][0]) / np.linalg.norm(good[j][0]) >= 0.93] for i in good}
    for i in [r[0] for r in rows if r[0] is not None]:
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, [])), min(seen), min(seen) == i)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (200, 201), (300, 300), (100, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long"), Stage(spark, "test")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 201: 100}


def test_layouts(spark):
    records = [
        ('{"messages":[{"role":"human","content":"a"},{"role":"gpt","content":null}],"id":3}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"prompt":"x","completion":"y"}', "prompt and completion", [("user", "x"), ("assistant", "y")]),
        ('{"instruction":"i","input":"j","output":"o"}', "instruction with input", [("user", "i\nj"), ("assistant", "o")]),
        ('{"system":"s","conversations":[{"from":"human","value":"v","extra":1}]}', "conversations with system", [("system", "s"), ("user", "v")]),
        ("nope", None, None),
        (None, None, None),
        ('{"a":1}', None, None),
    ]
    df = spark.createDataFrame([(k, r[0], "x") for k, r in enumerate(records)], "n int, record string, layout string")
    for r in chat_format.canonical_turns(df, "record").collect():
        assert r.layout == records[r.n][1] and (r.turns and [tuple(t) for t in r.turns]) == records[r.n][2]


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"<\/s> <\\s> [\INST] [[INST]]", "", None, "<s></s>é😀\n", "$1 \\1"]
    rows = [(c, t, role, nasty[(c + t) % 6], "x") for c in range(8) for t, role in enumerate(["system", "user", "assistant", None, "assistant"])]
    rows += [(3, 1, "user", "tie"), (3, None, "user", "first")] and [(3, 1, "user", "tie", "x"), (3, None, "user", "first", "x"), (None, 0, "assistant", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    made = chat_format.format_conversations(chat_format.rows_to_records(df))
    for r in chat_format.read_back(made).collect():
        own = sorted(((t, role or "", x or "") for c, t, role, x, _ in rows if c == r.conv_id), key=lambda x: (x[0] is not None, x[0], x[1], x[2]))
        loss = "".join(x for _, role, x in own if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha(whole), len(loss), sha(loss))
    for r in made.collect():
        assert sum(x.chars for x in r.loss) == len(r.formatted)
    assert made.limit(0).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op10_chat_format(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc(spark):
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><!-- no --><p>a &amp; b<b>c</b><p>é\r\n</body>"
    df = spark.createDataFrame([(1, "http://x/\r\ny", page, "z"), (2, None, None, "z"), (None, "u", "", "z"), (1, "http://x/\r\ny", page, "z")], "page_id long, url string, html string, type string")
    sources = {r.record_id: r for r in warc.response_records(df).collect()}
    out = warc.derived_records(warc.response_records(df)).collect()
    assert len(out) == 8 and len({r.record_id for r in out}) == 6
    for r in out:
        source = sources[r.refers_to]
        assert (r.page_id, r.target_uri, r.date) == (source.page_id, source.target_uri, source.date)
        assert f"WARC-Refers-To: {source.record_id}\r\n" in r.header and r.header.endswith("\r\n\r\n") and "\r\n\r\n" not in r.header[:-4]
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
        if r.type == "metadata":
            assert source.payload_digest in r.block and source.block_digest in r.block and "http-Content-Type: text/html" in r.block
    assert {r.block for r in out if r.type == "conversion"} == {"T\na & bc\né", ""}
    assert warc.derived_records(warc.response_records(df.limit(0))).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Stage(spark, "test").put(stage(spark, before, DATA))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert sorted(r.doc_id for r in last.select("doc_id").collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(oracles.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_the_mask_is_read_by_its_lengths(spark):
    rows = [(1, 0, "user", "é</s> hi"), (1, 1, "assistant", "so [/INST] it is"), (1, 2, "assistant", ""), (2, 0, "user", "only"), (3, 0, "assistant", "日本 <s>")]
    made = chat_format.format_conversations(chat_format.rows_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: "so [/INST] it is", 2: "", 3: "日本 <s>"}

    def read(table):
        return {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.read_back(table).collect()}

    assert read(made) == {i: (len(t), sha(t)) for i, t in want.items()}
    # The same mask in other runs, one that marks other texts, and one with other lengths.
    split = made.withColumn("loss", F.expr("flatten(transform(loss, r -> array(named_struct('chars', 0, 'loss', true), r)))"))
    assert read(split) == read(made)
    texts = {1: "é</s> hi", 2: "only", 3: ""}
    other = made.withColumn("loss", F.expr("transform(loss, (r, i) -> named_struct('chars', r.chars, 'loss', i % 3 = 1 and not r.loss))"))
    assert read(other) == {i: (len(t), sha(t)) for i, t in texts.items()}
    first = made.withColumn("loss", F.expr("array(named_struct('chars', 3, 'loss', true))"))
    assert read(first) == {i: (3, sha("<s>")) for i in want}
