"""Jaccard join on word n-grams, by vertical partitioning.

All n-grams have one global order (by hash), cut into fragments. A document's
set is cut along it; what two documents share is counted fragment by fragment
and summed per pair. Documents with equal sets are one class, worked on once.

Which pairs are counted:

* The first fragment of a set x is its first ``|x| - ceil(t|x|) + more(|x|)``
  n-grams. Two sets at threshold t share at least ``more`` of the smaller
  set's n-grams there, so each side may leave out its most frequent ones (one
  less than the least ``more`` a partner can have) and still meet in one that
  is kept. Passages that many documents share fall out this way, and n-grams of
  one class only are never looked at again.
* Classes that meet in a kept n-gram are not all paired. In each round every
  n-gram has a leader (first the class whose n-grams are most common, then one
  by hash), every class is counted against the leader it meets most often, and linked classes get one label.
  N-grams whose classes all have one label are settled. Rounds go on while
  they pay; then *every* pair with different labels that still meets is
  counted, so components are exact. Pairs of an n-gram that few classes have
  are listed. The classes that have crowded ones are dealt into blocks of bounded
  size, those with the same most crowded n-gram together, and each block is packed
  once. Every two blocks that share a crowded n-gram (found by their numbers
  alone) meet once, whatever else they share: a cell, counted as a matrix,
  fragment by fragment; only a forest of the links found leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm import words as W
from tallyhouse.llm.components import components, forest
from tallyhouse.llm.staging import BATCH, Stage, tidy
from tallyhouse.session import conf

FRAGMENT_BITS = 3
#: Passes over the first fragments, a power of two.
PASSES = 4
#: Rounds of leaders before the rest is paired, and the pairs per kept n-gram that count as few.
ROUNDS, FEW = 3, 2
#: Classes that a kept n-gram may have before its pairs are counted in cells; classes and n-grams of a block, about.
CROWD, BLOCK, BLOCK_GRAMS = 64, 512, 1 << 18


def _sets(chunk: W.Chunk, n_words: int) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, in order; a shorter text is one n-gram."""
    found = W.find_words(chunk)
    hashes = W.hash_words(chunk, found, fold_case=True)
    first, counts = found.first, found.counts
    sizes = np.where(counts >= n_words, counts - n_words + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(counts)), sizes)
    start = first[:-1][row] + np.arange(ends[-1] if len(ends) else 0) - (ends - sizes)[row]
    grams = W.hash_runs(hashes, start, np.minimum(start + n_words, first[1:][row]))
    return [np.unique(grams[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _prints(own: np.ndarray) -> tuple[int, int]:
    return int(W.mix(own).sum(dtype=W.U)), int(W.mix(own ^ W.U(0x5851F42D4C957F2D)).sum(dtype=W.U))


class Limits:
    """Prefix lengths for a threshold of ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def more(self, n: int) -> int:
        return max(1, min(self.needed(n), max(48, n // 16)))

    def prefix(self, n: int) -> int:
        return n - self.needed(n) + self.more(n)

    def left_out(self, n: int) -> int:
        return self.more(self.needed(n)) - 1


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sign(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = Limits(percent)
        for batch in batches:
            for chunk in W.chunks(_column(batch, "text")):
                sets = _sets(chunk, n_words)
                prints = np.array([_prints(x) for x in sets], dtype=W.U).reshape(-1, 2)
                heads = [x[: limits.prefix(len(x))] for x in sets]
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(_column(batch, c).slice(chunk.rows.start, len(sets)) for c in ("doc_id", "text_hash")),
                        pa.array(sizes),
                        W.signed(prints[:, 0]),
                        W.signed(prints[:, 1]),
                        pa.array([limits.left_out(int(n)) if n else 0 for n in sizes], pa.int64()),
                        W.lists(W.signed(np.concatenate(heads)), np.array([len(x) for x in heads])),
                    ],
                    ["doc_id", "text_hash", "n", "class", "check", "left_out", "head"],
                )

    return run


def _fragments(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = _column(batch, "class").to_numpy(zero_copy_only=False).view(W.U)
            for chunk in W.chunks(_column(batch, "text")):
                keys, parts, pieces = [], [], []
                for i, own in zip(chunk.rows, _sets(chunk, n_words), strict=True):
                    if _prints(own)[0] != int(wanted[i]):
                        continue
                    part = own >> W.U(64 - FRAGMENT_BITS)
                    cuts = np.flatnonzero(np.diff(part)) + 1
                    for piece in np.split(own, cuts):
                        keys.append(wanted[i])
                        parts.append(int(piece[0] >> W.U(64 - FRAGMENT_BITS)))
                        pieces.append(piece)
                if keys:
                    made = W.lists(W.signed(np.concatenate(pieces)), np.array([len(x) for x in pieces]))
                    yield pa.RecordBatch.from_arrays([W.signed(np.array(keys, dtype=W.U)), pa.array(parts, pa.int32()), made], ["class", "part", "grams"])

    return run


class _Sets:
    """Rows' n-grams of one kind, as (row, n-gram) pairs."""

    def __init__(self, lists: list[np.ndarray]):
        self.rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.grams = np.concatenate([np.zeros(0, np.int64), *lists])
        self.count = len(lists)

    def table(self, known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, self.grams), len(known) - 1)
        has = known[at] == self.grams
        out = np.zeros((self.count, len(known)), dtype=np.float32)
        out[self.rows[has], at[has]] = 1
        return out


def _shared(left: _Sets, right: _Sets, width: int = 4096) -> np.ndarray:
    """How many n-grams each left row has in common with each right row."""
    out = np.zeros((left.count, right.count), dtype=np.float32)
    both = np.intersect1d(left.grams, right.grams)
    for first in range(0, len(both), width):
        known = both[first : first + width]
        out += left.table(known) @ right.table(known).T
    return out


class _Block:
    """Some classes: their labels, crowded n-grams and sets by fragment."""

    def __init__(self, packed: pa.Array):
        rows = packed.values  # of a scalar: its own rows alone
        self.keys, self.labels, self.n = (rows.field(c).to_numpy() for c in ("class", "label", "n"))
        self.crowded = _split(rows.field("crowded"))
        sets = [np.sort(x.view(W.U)) for x in _split(rows.field("grams"))]
        cuts = [np.searchsorted(x, np.arange(1 << FRAGMENT_BITS, dtype=W.U) << W.U(64 - FRAGMENT_BITS)) for x in sets]
        self.parts = [[p.view(np.int64) for p in np.split(x, c[1:])] for x, c in zip(sets, cuts, strict=True)]


def _split(lists: pa.Array) -> list[np.ndarray]:
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _cell(left: _Block, right: _Block | None, percent: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Forest edges of one cell: the links between two blocks, or inside one."""
    single = right is None
    right = left if single else right
    low, high = np.minimum.outer(left.n, right.n), np.maximum.outer(left.n, right.n)
    wanted = (left.labels[:, None] != right.labels) & (low * 100 >= high * percent)
    if single:
        wanted = np.triu(wanted, 1)
    wanted &= _shared(_Sets(left.crowded), _Sets(right.crowded)) > 0
    a, b = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(a):
        return None
    wanted = wanted[np.ix_(a, b)]
    rest_a, rest_b = left.n[a].copy(), right.n[b].copy()
    total = np.add.outer(rest_a, rest_b)
    counts = np.zeros(total.shape, dtype=np.int64)
    for part in range(1 << FRAGMENT_BITS):
        own, other = [left.parts[i][part] for i in a], [right.parts[i][part] for i in b]
        counts += _shared(_Sets(own), _Sets(other)).astype(np.int64)
        rest_a -= [len(x) for x in own]
        rest_b -= [len(x) for x in other]
        most = counts + np.minimum.outer(rest_a, rest_b)
        wanted &= most * 100 >= (total - most) * percent
        if not wanted.any():
            return None
    x, y = np.nonzero(wanted)
    keys = np.concatenate([left.keys, right.keys])
    root = forest(a[x], b[y] + len(left.keys), len(keys))
    hit = np.flatnonzero(root != np.arange(len(keys)))
    return keys[hit], keys[root[hit]]


def _cells(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (_column(batch, c)[i] for c in ("left", "right"))
                found = _cell(_Block(left), _Block(right) if right.is_valid else None, percent)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, n_words: int, percent: int):
        self.docs, self.n_words, self.percent = docs, n_words, percent
        self.stage = Stage(docs.sparkSession, "ngram-jaccard")
        self.roots: DataFrame | None = None

    def far(self, a: str, b: str) -> F.Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def sign(self) -> None:
        shape = "doc_id long, text_hash long, n long, class long, check long, left_out long, head array<long>"
        with conf(self.docs.sparkSession, BATCH):
            self.heads = self.stage.put(self.docs.mapInArrow(tidy(_sign(self.n_words, self.percent)), shape))
        linked = self.heads.filter("n > 0 and doc_id is not null")
        self.classes = self.stage.put(linked.groupBy("n", "class", "check").agg(F.min("doc_id").alias("doc_id")))

    def meet(self) -> None:
        """Kept n-grams of the first fragment that two classes have: (class, n, gram)."""
        one = self.heads.select("doc_id", "class", "n", "left_out", "head").join(self.classes.select("doc_id", "class"), ["doc_id", "class"], "left_semi")
        one = self.stage.put(one.dropDuplicates(["doc_id", "class"]).select("class", "n", "left_out", "head"))
        self.signed = self.stage.put(self.heads.drop("head", "left_out"))
        self.stage.drop(self.heads)
        # N-grams are looked at in passes by their last bits, so the shuffles of one are all that lies on disk.
        hits = [self.stage.put(self.repeated(one, i)) for i in range(PASSES)]
        self.stage.drop(one)
        rarest = Window.partitionBy("class").orderBy(F.desc("times"), F.desc("gram"))
        met = reduce(DataFrame.union, hits).withColumn("place", F.row_number().over(rarest))
        # How common a class's n-grams are: of a group of copies, the one with the fewest changes has most.
        met = met.withColumn("central", F.sum("times").over(Window.partitionBy("class")) / F.col("n"))
        met = met.filter("place > left_out").select("class", "n", "central", "gram")
        self.met = self.stage.put(met)
        for table in hits:
            self.stage.drop(table)
        wanted = self.met.select("class").distinct().join(self.classes.select("class", "doc_id"), "class")
        own = self.docs.join(wanted, "doc_id").mapInArrow(tidy(_fragments(self.n_words)), "class long, part int, grams array<long>")
        with conf(self.docs.sparkSession, BATCH):
            self.fragments = self.stage.put(own.groupBy("class", "part").agg(F.first("grams").alias("grams")))

    def repeated(self, one: DataFrame, turn: int) -> DataFrame:
        """N-grams of one pass that two classes have, with each class: (gram, class, n, left_out, times)."""
        heads = one.select("class", "n", "left_out", F.explode("head").alias("gram"))
        heads = heads.filter(F.col("gram").bitwiseAND(F.lit(PASSES - 1)) == turn)
        often = heads.groupBy("gram").agg(F.count("*").alias("times"), F.min("class").alias("low"), F.max("class").alias("high"))
        often = self.stage.put(often.filter("low <> high").select("gram", "times"))
        return heads.join(often, "gram")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, na, b, nb) -> those at the threshold: overlaps are counted per fragment and summed."""
        left = self.fragments.select(F.col("class").alias("a"), "part", F.col("grams").alias("ga"))
        right = self.fragments.select(F.col("class").alias("b"), "part", F.col("grams").alias("gb"))
        counted = pairs.join(left, "a").join(right, ["b", "part"]).withColumn("c", F.size(F.array_intersect("ga", "gb")))
        total = counted.groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("c"))
        return total.filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * self.percent).select("a", "b")

    def labelled(self) -> DataFrame:
        """Kept n-grams with their classes' labels, without settled ones."""
        met = self.met.join(self.roots.withColumnRenamed("node", "class"), "class", "left")
        met = met.withColumn("label", F.coalesce("root", "class")).drop("root")
        unsettled = met.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        return self.stage.put(met.join(unsettled.select("gram"), "gram"))

    def unpaired(self, met: DataFrame) -> tuple[int, int]:
        """Kept n-grams, and pairs of classes with different labels that meet in them."""
        each = met.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        row = each.agg(F.sum("c").alias("rows"), F.sum((F.col("c") * F.col("c") - F.col("own")) / 2).alias("pairs")).first()
        return int(row["rows"] or 0), int(row["pairs"] or 0)

    def leaders(self, met: DataFrame, turn: int) -> DataFrame:
        rank = F.struct("central", "class") if not turn else F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), "class")
        lead = met.groupBy("gram").agg(F.max_by(F.struct("class", "n", "label"), rank).alias("lead"))
        faced = met.join(lead, "gram").filter((F.col("label") != F.col("lead.label")) & self.far("n", "lead.n"))
        shared = faced.groupBy(F.col("class").alias("a"), F.col("n").alias("na"), F.col("lead.class").alias("b"), F.col("lead.n").alias("nb")).agg(F.count("*").alias("shared"))
        best = shared.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("shared", "b")).alias("best"))
        return best.select("a", "na", "best.b", "best.nb")

    def rest(self, met: DataFrame) -> DataFrame:
        """Pairs with different labels that meet in some n-gram."""
        a, b = (met.select("gram", F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
        b = b.withColumnRenamed("gram", "other")
        apart = (F.col("gram") == F.col("other")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & self.far("na", "nb")
        return a.join(b, apart).select("a", "na", "b", "nb").distinct()

    def blocks(self, crowd: DataFrame) -> DataFrame:
        """(class, block): classes with the same most crowded n-gram in the same blocks, of bounded size."""
        own = crowd.groupBy("class", "n").agg(F.max_by("gram", F.struct("c", "gram")).alias("main"))
        size = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(f"{c}_grams") / BLOCK_GRAMS))
        mains = own.groupBy("main").agg(F.count("*").alias("m"), F.sum("n").alias("m_grams")).withColumn("parts", size("m"))
        mains = self.stage.put(mains)
        # Small ones share blocks.
        few = (F.col("m") * 2 < BLOCK) & (F.col("m_grams") * 2 < BLOCK_GRAMS)
        small = mains.filter(few).agg(F.sum("m").alias("s"), F.sum("m_grams").alias("s_grams")).select(size("s").alias("k")).first()["k"] or 1
        shared = F.struct(F.lit(None).cast("long").alias("main"), F.pmod(F.xxhash64("main"), F.lit(2 * small)).alias("part"))
        alone = F.struct("main", F.pmod(F.xxhash64("class", F.lit(7)), F.col("parts")).alias("part"))
        return own.join(mains, "main").select("class", F.xxhash64(F.when(few, shared).otherwise(alone)).alias("block"))

    def crowded(self, met: DataFrame, sizes: DataFrame) -> DataFrame:
        """(a, b): a forest of the links among classes that share a crowded n-gram."""
        crowd = self.stage.put(met.join(sizes, "gram").select("class", "n", "label", "gram", "c"))
        placed = self.stage.put(self.blocks(crowd))
        own = crowd.groupBy("class", "n", "label").agg(F.collect_list("gram").alias("crowded")).join(placed, "class")
        sets = self.fragments.join(placed, "class", "left_semi").groupBy("class").agg(F.flatten(F.collect_list("grams")).alias("grams"))
        packed = own.join(sets, "class").groupBy("block").agg(F.collect_list(F.struct("class", "n", "label", "crowded", "grams")).alias("rows"))
        packed = self.stage.put(packed)
        held = self.stage.put(crowd.join(placed, "class").select("gram", "block").distinct())
        left, right = held.withColumnRenamed("block", "i"), held.select(F.col("gram").alias("other"), F.col("block").alias("j"))
        pairs = left.join(right, (F.col("gram") == F.col("other")) & (F.col("i") <= F.col("j"))).select("i", "j").distinct()
        cells = pairs.join(packed.select(F.col("block").alias("i"), F.col("rows").alias("left")), "i")
        cells = cells.join(packed.select(F.col("block").alias("j"), F.col("rows").alias("other")), "j")
        cells = cells.select("left", F.when(F.col("i") != F.col("j"), F.col("other")).alias("right"))
        # A row is two blocks: one at a time goes to a worker.
        with conf(met.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
            found = self.stage.put(cells.mapInArrow(tidy(_cells(self.percent)), "a long, b long"))
        for table in (crowd, placed, packed, held):
            self.stage.drop(table)
        return found

    def link_rest(self, met: DataFrame) -> None:
        """Adds all links among classes with different labels."""
        sizes = met.groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") > CROWD)
        sizes = self.stage.put(sizes)
        near = self.rest(met.join(sizes, "gram", "left_anti"))
        self.link(near, self.crowded(met, sizes))

    def link(self, pairs: DataFrame, linked: DataFrame | None = None) -> None:
        """Adds the links among some pairs, and known ones; ``roots`` has the least class that each linked one reaches."""
        pairs = self.stage.put(pairs)
        found = self.stage.put(self.verified(pairs))
        self.stage.drop(pairs)
        read = [t for t in (found, linked, self.roots) if t is not None]
        edges = found if linked is None else found.union(linked)
        if self.roots is not None:
            edges = edges.union(self.roots.select("node", "root"))
        self.roots = components(edges, self.stage)
        for table in read:
            self.stage.drop(table)

    def link_all(self) -> None:
        self.link(self.leaders(self.met.withColumn("label", F.col("class")), 0))
        before, turn = None, 1
        while True:
            met = self.labelled()
            rows, pairs = self.unpaired(met)
            if turn == ROUNDS or pairs <= FEW * rows or (before is not None and pairs > before / 2):
                break
            self.link(self.leaders(met, turn))
            self.stage.drop(met)
            before, turn = pairs, turn + 1
        self.stage.drop(self.met)
        if pairs:
            self.link_rest(met)
        self.stage.drop(met)
        self.stage.drop(self.fragments)

    def run(self) -> DataFrame:
        self.sign()
        self.meet()
        self.link_all()
        named = self.classes.join(self.roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        named = named.withColumnRenamed("doc_id", "class_id")
        least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
        named = self.stage.put(named.join(least, "root"))
        self.stage.drop(self.roots)
        self.stage.drop(self.classes)
        out = self.signed.select("doc_id", "text_hash", "n", "class", "check").join(named, ["n", "class", "check"], "left")
        alone = F.col("component_id").isNull() | F.col("doc_id").isNull()
        return out.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(~alone, F.col("root")).alias("group"),
            "text_hash",
        )


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Documents, all columns: of each component the row with the smallest doc_id.

    Rows that repeat both doc_id and text stay once. Rows without words or
    without a doc_id link with nothing and stay.
    """
    doc, text = _free(docs.columns, "_doc"), _free(docs.columns, "_text")
    found = near_duplicates(docs, n_words, percent).filter("doc_id = component_id")
    first = found.filter("group is not null").groupBy("group", "doc_id").agg(F.min("text_hash").alias(text))
    kept = first.select(F.col("doc_id").alias(doc), text).union(found.filter("group is null").select("doc_id", "text_hash").distinct())
    kept = Stage(docs.sparkSession, "ngram-jaccard").put(kept)
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string"))})
    stays = keyed.join(kept, [doc, text], "left_semi").dropDuplicates([doc, text])
    return stays.unionByName(keyed.filter(F.col(doc).isNull())).select(*[f"`{c}`" for c in docs.columns])


def _free(columns: list[str], name: str) -> str:
    """A column name that a table doesn't have."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_shingles, component_id, class_id, group, text_hash), a row per row.

    ``component_id`` is the smallest doc_id reachable by links (sets at a
    Jaccard similarity of ``percent`` / 100 or more); ``class_id`` the smallest
    with an equal set. ``group`` names the component also where rows share a
    doc_id, and is null for rows that link with nothing by rule.

    A text with fewer than ``n_words`` words is one shingle. Null and empty
    texts have no shingles and link with nothing. A row with a null doc_id
    links with nothing and has a null component. Rows that repeat a doc_id are
    judged one by one. Other columns are not read. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return _Join(docs, n_words, percent).run()
