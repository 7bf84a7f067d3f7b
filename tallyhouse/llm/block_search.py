"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

Documents are dealt into shards as they lie. In a shard each list that a query
can need is clustered by its documents' similarity (random projections of their
weighted terms), and every block keeps the largest value of each coordinate that
the list's queries have. No document of a block can score above its summary's
score, so a block is skipped if that is below what the tenth best is known to
have, and only then; its documents are scored in full otherwise.

What the tenth best has at least: the documents that hold a query's rarest terms
are scored first. Lists whose largest values together stay below that can't hold
a result alone; they are never walked, only added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm import words as W
from tallyhouse.llm.staging import Stage

#: Bytes of terms in ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Terms of the queries of one pass, about (or one query's own); a larger set is searched in several passes.
VOCABULARY = 1 << 17
#: Documents and entries of a shard; documents of a block; documents scored first per query, about.
SHARD, ENTRIES, BLOCK, SEEDS = 4096, 1 << 20, 32, 64
#: Projections that documents are compared by.
PROJECTIONS = 24

VECTORS = "doc_id long, n long, terms array<int>, times array<int>"
INDEX = (
    "doc_ids array<long>, ends array<int>, terms array<int>, impacts array<int>, "
    "list_terms array<int>, list_ends array<int>, block_ends array<int>, block_docs array<int>, summary_ends array<int>, summary_terms array<int>, summary_most array<int>"
)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(_column(batch, "text")):
            found = W.find_words(chunk, IN_TERM)
            ids = _column(batch, "item_id").to_numpy(zero_copy_only=False)[chunk.rows.start : chunk.rows.stop]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found.row], pa.int64()), W.signed(W.hash_words(chunk, found, fold_case=True))], ["item_id", "term"])


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = _column(batch, "doc_id")
            for chunk in W.chunks(_column(batch, "text")):
                found = W.find_words(chunk, IN_TERM)
                hashes = W.hash_words(chunk, found, fold_case=True)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                pair, times = np.unique(found.row[hit] * len(known) + at[hit], return_counts=True)
                each = np.bincount(pair // len(known), minlength=len(chunk.rows))
                own = [W.lists(pa.array((x).astype(np.int32)), each) for x in (pair % len(known), times)]
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.rows.start, len(chunk.rows)), pa.array(found.counts.astype(np.int64)), *own], ["doc_id", "n", "terms", "times"])

    return run


def _reach(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of some rows stand, and how many each has; ``ends`` begins with 0."""
    counts = ends[rows + 1] - ends[rows]
    return np.repeat(ends[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum()), counts


class Shard:
    """Some documents' values for the queries' terms, by document and by term."""

    def __init__(self, doc_ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.doc_ids, self.ends, self.terms, self.impacts = doc_ids, ends, terms, impacts

    def invert(self) -> None:
        row = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.ends))
        order = np.argsort(self.terms, kind="stable")
        self.held, first = np.unique(self.terms[order], return_index=True)
        self.lists = np.split(row[order], first[1:]) if len(first) else []

    def postings(self, terms: np.ndarray) -> np.ndarray:
        """Documents that hold any of some terms."""
        at = np.searchsorted(self.held, terms)
        has = at < len(self.held)
        has[has] = self.held[at[has]] == terms[has]
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.lists[i] for i in at[has])]))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Full scores of documents that hold some term."""
        at, counts = _reach(self.ends, docs)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at].astype(np.int64), np.cumsum(counts) - counts)


def _shards(batches: Iterator[pa.RecordBatch], shared: dict) -> Iterator[Shard]:
    """Documents of a partition in shards of bounded size; those without a doc_id can't be a result."""
    kept: list[tuple] = []
    docs = entries = 0

    def made() -> Shard:
        ids, n, counts, terms, times = (np.concatenate(x) for x in zip(*kept, strict=True))
        m = 100 - 90 + (90 * n * shared["n_docs"]) // shared["n_terms"]
        times = times.astype(np.int64)
        impacts = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, counts))
        return Shard(ids, np.concatenate([[0], np.cumsum(counts)]), terms, impacts.astype(np.int32))

    for batch in batches:
        ends = _column(batch, "terms").offsets.to_numpy()
        terms, times = (_column(batch, c).values.to_numpy(zero_copy_only=False) for c in ("terms", "times"))
        ids, n = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n"))
        first = 0
        while first < batch.num_rows:
            last = min(batch.num_rows, first + SHARD - docs, max(first + 1, int(np.searchsorted(ends, ends[first] + ENTRIES - entries, side="right")) - 1))
            low, high = ends[first], ends[last]
            kept.append((ids[first:last], n[first:last], np.diff(ends[first : last + 1]), terms[low:high], times[low:high]))
            docs, entries, first = docs + last - first, entries + int(high - low), last
            if docs >= SHARD or entries >= ENTRIES:
                yield made()
                kept.clear()
                docs = entries = 0
    if kept:
        yield made()


class Best:
    """Each query's best documents so far: score descending, then doc_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(queries)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own, others = np.concatenate([self.rows[i][0], scores]), np.concatenate([self.rows[i][1], ids])
        order = np.lexsort((others, -own))[: self.k]
        self.rows[i] = own[order], others[order]

    def least(self, i: int) -> int:
        """What a further document must have at least."""
        own = self.rows[i][0]
        return int(own[-1]) if len(own) == self.k else 1

    def table(self, item_ids: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        keep = [own >= max(int(low), 1) for (own, _), low in zip(self.rows, least, strict=True)]
        ids = np.concatenate([np.zeros(0, np.int64), *(x[1][h] for x, h in zip(self.rows, keep, strict=True))])
        scores = np.concatenate([np.zeros(0, np.int64), *(x[0][h] for x, h in zip(self.rows, keep, strict=True))])
        items = np.repeat(item_ids, [int(h.sum()) for h in keep])
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])


def _seeds(shared, k: int):
    """Each task's best documents among those that hold a query's rarest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = Best(len(known["item_ids"]), k)
        weights = np.zeros(known["size"], np.int64)
        for shard in _shards(batches, known):
            shard.invert()
            for i, terms in enumerate(known["terms"]):
                docs = shard.postings(known["seeds"][i])
                if len(docs):
                    weights[terms] = known["weights"][i]
                    best.add(i, shard.scores(docs, weights), shard.doc_ids[docs])
                    weights[terms] = 0
        yield best.table(known["item_ids"], np.ones(len(known["item_ids"])))

    return run


def cluster(sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in blocks of similar ones, about ``size`` and at most twice that: their order, and where blocks end."""
    n = len(sketch)
    if n <= size:
        return np.arange(n), np.array([n])
    centres = sketch[np.linspace(0, n - 1, -(-n // size)).astype(int)]
    nearest = np.concatenate([(sketch[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, n, 4096)])
    order = np.argsort(nearest, kind="stable")
    place = nearest[order]
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    new = within % (2 * size) == 0
    return order, np.append(np.flatnonzero(new)[1:], n)


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = known["size"]
        # The same in every task.
        directions = np.random.default_rng(7).standard_normal((size, PROJECTIONS)).astype(np.float32)
        local = np.full(size, -1, np.int64)
        for shard in _shards(batches, known):
            shard.invert()
            full = np.diff(shard.ends) > 0
            sketch = np.zeros((len(shard.doc_ids), PROJECTIONS), np.float32)
            if full.any():
                for j in range(PROJECTIONS):
                    sketch[full, j] = np.add.reduceat(directions[shard.terms, j] * (shard.impacts * known["weight"][shard.terms]), shard.ends[:-1][full])
            sketch /= np.maximum(np.sqrt((sketch**2).sum(axis=1, keepdims=True)), 1e-9)
            lists, list_ends, block_ends, docs, summary_ends, summary_terms, summary_most = [], [], [], [], [], [], []
            place = {int(t): i for i, t in enumerate(shard.held)}
            blocks = total = entries = 0
            for term in known["probed"]:
                if term not in place:
                    continue
                own = shard.lists[place[term]]
                order, ends = cluster(sketch[own], BLOCK)
                own = own[order]
                beside = np.unique(np.concatenate([known["terms"][i] for i in known["items_of"][term]]))
                local[beside] = np.arange(len(beside))
                at, counts = _reach(shard.ends, own)
                column = local[shard.terms[at]]
                block = np.repeat(np.searchsorted(ends, np.arange(len(own)), side="right"), counts)
                has = column >= 0
                most = np.zeros(len(ends) * len(beside), np.int32)
                np.maximum.at(most, block[has] * len(beside) + column[has], shard.impacts[at[has]])
                local[beside] = -1
                cell = np.flatnonzero(most)
                lists.append(term)
                block_ends.append(total + ends)
                docs.append(own)
                summary_terms.append(beside[cell % len(beside)])
                summary_most.append(most[cell])
                summary_ends.append(entries + np.cumsum(np.bincount(cell // len(beside), minlength=len(ends))))
                blocks, total, entries = blocks + len(ends), total + len(own), entries + len(cell)
                list_ends.append(blocks)
            if not lists:
                continue
            values = [shard.ends, shard.terms, shard.impacts, lists, list_ends, *(np.concatenate(x) for x in (block_ends, docs, summary_ends, summary_terms, summary_most))]
            one = [pa.array([shard.doc_ids.astype(np.int64)], pa.list_(pa.int64())), *(pa.array([np.asarray(v, np.int32)], pa.list_(pa.int32())) for v in values)]
            names = ["doc_ids", "ends", "terms", "impacts", "list_terms", "list_ends", "block_ends", "block_docs", "summary_ends", "summary_terms", "summary_most"]
            yield pa.RecordBatch.from_arrays(one, names)

    return run


def _search_shard(row: dict, known: dict, best: Best, weights: np.ndarray) -> tuple[int, int]:
    """Adds a shard's best documents; gives how many blocks were met, and how many of these were opened."""
    shard = Shard(row["doc_ids"], row["ends"].astype(np.int64), row["terms"], row["impacts"])
    place = {int(t): i for i, t in enumerate(row["list_terms"])}
    list_ends, block_ends, summary_ends = (np.concatenate([[0], row[c]]).astype(np.int64) for c in ("list_ends", "block_ends", "summary_ends"))
    met = opened = 0
    for i, terms in enumerate(known["terms"]):
        own = [place[t] for t in known["essential"][i] if t in place]
        if not own:
            continue
        weights[terms] = known["weights"][i]
        bounds, blocks = [], []
        for j in own:
            first, last = list_ends[j], list_ends[j + 1]
            low, high = summary_ends[first], summary_ends[last]
            values = weights[row["summary_terms"][low:high]] * row["summary_most"][low:high].astype(np.int64)
            bounds.append(np.add.reduceat(values, summary_ends[first:last] - low))
            blocks.append(np.arange(first, last))
        bounds, blocks = np.concatenate(bounds), np.concatenate(blocks)
        met += len(blocks)
        order = np.argsort(-bounds, kind="stable")
        bounds, blocks = bounds[order], blocks[order]
        seen = np.zeros(len(shard.doc_ids), bool)
        first, step = 0, 8
        while first < len(blocks) and bounds[first] >= max(best.least(i), known["least"][i], 1):
            last = min(first + step, int(np.searchsorted(-bounds, -max(best.least(i), known["least"][i], 1), side="right")))
            at, _ = _reach(block_ends, blocks[first:last])
            docs = np.unique(row["block_docs"][at])
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                best.add(i, shard.scores(docs, weights), shard.doc_ids[docs])
            opened += last - first
            first, step = last, step * 2
        weights[terms] = 0
    return met, opened


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = Best(len(known["item_ids"]), k)
        weights = np.zeros(known["size"], np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: _column(batch, name)[i].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}
                _search_shard(row, known, best, weights)
        yield best.table(known["item_ids"], known["least"])

    return run


class Search:
    """One pass: some queries' terms, known to the driver, against all documents."""

    def __init__(self, docs: DataFrame, pairs: np.ndarray, item_ids: np.ndarray, k: int, stage: Stage):
        self.docs, self.k, self.stage = docs, k, stage
        self.vocabulary, at = np.unique(pairs.view(W.U), return_inverse=True)
        self.item_ids, own = np.unique(item_ids, return_inverse=True)
        order = np.argsort(own, kind="stable")
        self.terms = np.split(at[order], np.flatnonzero(np.diff(own[order])) + 1)

    def share(self, value):
        return self.docs.sparkSession.sparkContext.broadcast(value)

    def weigh(self) -> None:
        """Vectors of all documents, and each term's weight and largest value."""
        self.vectors = self.stage.put(self.docs.mapInArrow(_vectors(self.share(self.vocabulary)), VECTORS))
        whole = self.vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        self.n_docs, self.n_terms = int(whole["docs"]), max(int(whole["terms"] or 0), 1)
        m = F.expr(f"100 - 90 + (90 * n * {self.n_docs}L) div {self.n_terms}L")
        entry = self.vectors.select(m.alias("m"), F.explode(F.arrays_zip("terms", "times")).alias("e")).select("m", "e.terms", F.col("e.times").cast("long").alias("tf"))
        impact = F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
        rows = entry.groupBy(F.col("terms").alias("term")).agg(F.count("*").alias("df"), F.max(impact).alias("most")).toPandas()  # a row per term of the pass
        self.df, self.most = np.zeros(len(self.vocabulary), np.int64), np.zeros(len(self.vocabulary), np.int64)
        self.df[rows["term"].to_numpy(np.int64)], self.most[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64), rows["most"].to_numpy(np.int64)
        self.weight = np.floor(1000 * np.log((2 * self.n_docs + 2) / (2 * self.df + 1))).astype(np.int64)

    def known(self, **more) -> dict:
        base = {"size": len(self.vocabulary), "n_docs": self.n_docs, "n_terms": self.n_terms, "item_ids": self.item_ids, "terms": self.terms, "weights": [self.weight[t] for t in self.terms], "weight": self.weight}
        return base | more

    def thresholds(self) -> np.ndarray:
        """What each query's ``k``-th best document scores at least."""
        seeds = []
        for terms in self.terms:
            rare = terms[(self.df[terms] > 0) & (self.weight[terms] > 0)]
            rare = rare[np.argsort(self.df[rare], kind="stable")]
            seeds.append(np.sort(rare[: int(np.searchsorted(np.cumsum(self.df[rare]), max(SEEDS, self.k))) + 1]))
        rows = self.results().mapInArrow(_seeds(self.share(self.known(seeds=seeds)), self.k), "item_id long, doc_id long, score long")
        place = Window.partitionBy("item_id").orderBy(F.desc("score"))
        last = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") == self.k).select("item_id", "score").toPandas()  # a row per query
        least = np.zeros(len(self.item_ids), np.int64)
        least[np.searchsorted(self.item_ids, last["item_id"].to_numpy(np.int64))] = last["score"].to_numpy(np.int64)
        return least

    def results(self) -> DataFrame:
        """Documents that can be results."""
        return self.vectors.filter("doc_id is not null and size(terms) > 0")

    def essential(self, least: np.ndarray) -> list[np.ndarray]:
        """Each query's terms without those whose lists can't hold a result alone."""
        out = []
        for terms, low in zip(self.terms, least, strict=True):
            bound = self.weight[terms] * self.most[terms]
            order = np.argsort(bound, kind="stable")
            out.append(terms[order[np.cumsum(bound[order]) >= max(int(low), 1)]])
        return out

    def run(self) -> DataFrame:
        self.weigh()
        least = self.thresholds()
        essential = self.essential(least)
        probed = np.unique(np.concatenate([np.zeros(0, np.int64), *essential]))
        items_of: dict[int, list[int]] = {int(t): [] for t in probed}
        for i, terms in enumerate(essential):
            for t in terms:
                items_of[int(t)].append(i)
        probed = [int(t) for t in probed]
        of_list = self.share(self.known(probed=probed, items_of=items_of))
        self.index = self.stage.put(self.results().mapInArrow(_index(of_list), INDEX))
        wanted = self.share(self.known(essential=[[int(t) for t in e] for e in essential], least=least))
        return self.index.mapInArrow(_search(wanted, self.k), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) -> (item_id, rank, doc_id, score): each item's ``k`` best documents.

    Terms are runs of ASCII letters and digits and of all other signs from
    U+0080 on, A-Z in lower case. Scores are whole numbers above 0; of equal
    ones the smaller doc_id comes first. Results are exact.

    Null and empty texts have no terms. Items that share an item_id are one
    item with all their terms; a null item_id has no rows. Rows that share a
    doc_id are documents of their own; a document with a null doc_id counts in
    the statistics and is no result. Other columns are not read. Without items
    or documents the result is empty.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "block-search")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    pairs = stage.put(asked.mapInArrow(_query_terms, "item_id long, term long").distinct())
    many = pairs.count()
    passes = 1 if many <= VOCABULARY else -(-2 * many // VOCABULARY)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for turn in range(passes):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).toPandas()
        if len(mine):
            found = found.union(Search(own, mine["term"].to_numpy(np.int64), mine["item_id"].to_numpy(np.int64), k, stage).run())
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
