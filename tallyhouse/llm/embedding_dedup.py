"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors of a label are one class. In each table a class falls into the
bucket of its signs against that table's hyperplanes. A bucket is cut into
blocks of at most about ``BLOCK`` classes, and every pair of blocks is a cell of
its own, so a bucket with a third of all vectors is many bounded cells. In a
cell all cosines are taken in double precision. A pair that meets in several
tables counts in the first of them only, so links are counted without ever
being listed; each cell gives one count per class and, for the components, the
edges of a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyhouse.llm.components import components, forest
from tallyhouse.llm.staging import Stage

BLOCK = 1024
#: Share of pairs right at the threshold that no table brings together, at most.
MISSED = 0.0005


def plan_tables(classes: int, threshold: float, per_bucket: int = 64) -> tuple[int, int]:
    """Signs per table and number of tables, for as many classes under one label."""
    signs = min(24, max(6, math.ceil(math.log2(max(1, classes) / per_bucket))))
    met = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(MISSED) / math.log(1 - met))


def planes(dimension: int, signs: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dimension, signs, tables]).standard_normal((dimension, signs * tables))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sign(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _column(batch, "vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                side = _matrix(_column(part, "vector")) @ planes(int(size), signs, tables) > 0
                codes = (side.reshape(len(side), tables, signs) * (1 << np.arange(signs))).sum(axis=2).astype(np.int64)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "codes"])

    return run


def _cell(rows: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Counts and forest edges of one cell: block ``side`` 0 against block 1, or one block with itself."""
    keys = rows["class"].to_numpy()
    weight, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
    vectors, codes = _matrix(rows["vector"].combine_chunks()), _matrix(rows["codes"].combine_chunks()).astype(np.int64)
    table = int(rows["table"][0].as_py())
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    own = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1)
    single = not len(other) and not rows["split"][0].as_py()
    if single:
        other = own
    if not len(own) or not len(other):
        return None
    close = (vectors[own] @ vectors[other].T) / np.outer(norms[own], norms[other]) >= threshold
    if single:
        close = np.triu(close, 1)
    a, b = np.nonzero(close)
    a, b = own[a], other[b]
    for t in range(table):
        first = codes[a, t] != codes[b, t]
        a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.zeros(len(keys), dtype=np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    root = forest(a, b, len(keys))
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(links[hit]), pa.array(keys[root[hit]])], ["class", "links", "near"])


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            cell = rows["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1 and (out := _cell(rows.slice(a, b - a), threshold)) is not None:
                    yield out
            rest = rows.slice(cuts[-1])
        if rest is not None and rest.num_rows > 1 and (out := _cell(rest, threshold)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), a row per row.

    Vectors are linked when their labels are equal and not null and their cosine
    is ``threshold`` or more. Null, empty and zero vectors, those with null or
    non-finite components, and those without a vec_id or label link with
    nothing. Vectors of different lengths are not compared. Rows with equal
    vectors and labels link with each other, also under one vec_id. A null
    vec_id has a null component and is not kept. Other columns are not read.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "embedding-dedup")
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("class", F.when(usable, F.xxhash64("label", "vector")))
    classes = rows.filter("class is not null").groupBy("class", "label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = stage.put(classes)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = plan_tables(most, threshold)
    shape = StructType([*classes.schema, StructField("codes", ArrayType(LongType()))])
    signed = stage.put(classes.mapInArrow(_sign(signs, tables), shape))
    placed = signed.select("class", "label", "vector", "copies", "codes", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "table", "code"]
    sizes = stage.put(placed.groupBy(*bucket).count().filter("count > 1").select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    met = placed.join(sizes, bucket)
    block = F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "facing"), F.greatest("block", "facing")
    cells = met.select(
        F.xxhash64(*bucket, F.size("vector"), low, high).alias("cell"),
        "class",
        "copies",
        "vector",
        "codes",
        "table",
        (low != high).alias("split"),
        F.when(F.col("block") == low, 0).otherwise(1).alias("side"),
    )
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_cells(threshold), "class long, links long, near long")
    counted = stage.put(counted)
    links = counted.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(counted.select(F.col("class").alias("a"), F.col("near").alias("b")), stage)
    known = classes.select("class", "vec_id", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
    known = stage.put(known.withColumn("root", F.coalesce("root", "class")))
    least = stage.put(known.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    known = stage.put(known.join(least, "root").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    component = F.coalesce("component_id", "vec_id")
    return (
        rows.select("vec_id", "class")
        .join(known, "class", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    )

