"""Vector search over a stored inverted file: cells of near vectors, searched block by block on the cluster.

Centres are fitted on a bounded sample; every vector is stored once, under its cell and a part of at most about ``PART``
vectors. Queries are dealt into parts too, and a part of queries meets a part of a cell in one task as two matrices. The
exact search visits all cells, the approximate one the nearest cells of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators import skew
from engramlake.session import work_path

#: Vectors of a cell and queries that meet in one task; vectors the centres are fitted on; most cells.
PART, QUERY_PART, SAMPLE, MOST_CELLS = 4096, 1024, 20_000, 4096
#: Share of the neighbours that an approximate search is to find.
RECALL = 0.95


def centroids(vec: DataFrame, group: str) -> DataFrame:
    """Mean vector per group; partial sums per (group, position) combine before the shuffle."""
    e = vec.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype("float64")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class VectorIndex(NamedTuple):
    """Vectors (cell, part, vec_id, embedding), parts of each cell (cell, parts), the centres, and the cells a query visits."""

    rows: DataFrame
    parts: DataFrame
    centres: np.ndarray
    probes: int


def _fit_centres(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the first rows of the sample; an empty cell keeps its centre."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _probes(sample: np.ndarray, centres: np.ndarray, target: float, queries: int = 256, k: int = 10) -> int:
    """Cells a query has to visit so that ``target`` of its nearest ``k`` neighbours in the sample lie in them."""
    q = sample[-queries:]
    cell = (sample @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    at = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(at[max(0, int(np.ceil(target * len(at))) - 1)]) + 1 if len(at) else 1


def _nearest(centres: np.ndarray, key: str, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_unit(b.column(1)) @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.record_batch([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], names=[key, "embedding", "cell"])

    return run


def _vectors(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).filter("size(embedding) > 0")


def store_vectors(vec: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, target: float = RECALL) -> VectorIndex:
    """Write the inverted file of a vector table once.  Vectors without an embedding are left out.

    ``cells`` defaults to half the root of the number of vectors; the centres are fitted on at most ``sample`` vectors,
    those of least digest of the id. On the same sample the number of cells is measured that an approximate search has to
    visit to find ``target`` of the neighbours; it depends on how far the vectors cluster.
    """
    v = _vectors(vec, "vec_id")
    first = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    n = v.count()
    cells = min(cells or max(1, round(n**0.5 / 2)), MOST_CELLS, max(1, first.num_rows))
    unit = _unit(first["embedding"]) if n else np.zeros((1, 1))
    centres = _fit_centres(unit, cells)
    placed = f"{path}/placed"
    v.mapInArrow(_nearest(centres, "vec_id", 1), "vec_id long, embedding array<double>, cell int").write.parquet(placed)
    spark = vec.sparkSession
    rows = spark.read.parquet(placed)
    rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).write.parquet(f"{path}/parts")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, embedding array<double>").write.parquet(f"{path}/centres")
    spark.createDataFrame([(_probes(unit, centres, target),)], "probes int").write.parquet(f"{path}/probes")
    return open_vectors(spark, path)


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """The stored inverted file below ``path``."""
    parts = spark.read.parquet(f"{path}/parts")
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").select("embedding").toArrow()
    # At most MOST_CELLS rows, so the table of parts may be broadcast.
    rows = spark.read.parquet(f"{path}/placed").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    return VectorIndex(rows, parts, np.array(centres["embedding"].to_pylist()), spark.read.parquet(f"{path}/probes").first()[0])


def _meet(k: int, threshold: float | None):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        scores = np.round(_unit(queries["embedding"]) @ _unit(vectors["embedding"]).T, 9)
        ids, vid = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
        # Equal scores go by id, so columns are put in order of id and sorted stably.
        by = np.argsort(vid, kind="stable")
        scores, vid = scores[:, by], vid[by]
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out = np.take_along_axis(scores, best, 1).ravel()
        keep = np.ones(len(out), bool) if threshold is None else out >= threshold
        return pa.table([pa.array(np.repeat(ids, best.shape[1])[keep]), pa.array(vid[best.ravel()][keep]), pa.array(out[keep])], schema=schema)

    return run


def search(qv: DataFrame, index: VectorIndex, k: int, threshold: float | None = None, probes: int | None = None, block: int = QUERY_PART) -> DataFrame:
    """query_id, vec_id, score, rank of the ``k`` nearest vectors by cosine; exact unless ``probes`` limits the cells of a query.

    A task holds one part of the queries and one part of a cell, and hands on the ``k`` best rows per query.
    """
    q = _vectors(qv, "query_id")
    shares = max(1, -(-q.count() // block))
    cells = len(index.centres)
    if probes is None or probes >= cells:
        q = q.crossJoin(F.broadcast(index.parts))  # every cell of the exact search: at most MOST_CELLS rows
    else:
        q = q.mapInArrow(_nearest(index.centres, "query_id", probes), "query_id long, embedding array<double>, cell int").join(F.broadcast(index.parts), "cell")
    q = q.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    v = index.rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    keys = ["cell", "part", "share"]
    got = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_meet(k, threshold), "query_id long, vec_id long, score double")
    return skew.top_k(got, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def knn(qv: DataFrame, vec: DataFrame | VectorIndex, k: int, threshold: float | None = None, block: int = QUERY_PART) -> DataFrame:
    """Exact cosine neighbours of each query vector, ``block`` queries to a task; a plain table is stored first."""
    index = vec if isinstance(vec, VectorIndex) else store_vectors(vec, work_path(vec.sparkSession, "vectors"))
    return search(qv, index, k, threshold, block=block)


def ann(qv: DataFrame, vec: DataFrame | VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """Approximate neighbours from the nearest cells of each query, by default as many as the index measured."""
    index = vec if isinstance(vec, VectorIndex) else store_vectors(vec, work_path(vec.sparkSession, "vectors"))
    return search(qv, index, k, probes=probes or index.probes)


def recall_of(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, found, expected, recall: the share of the exact neighbours that the approximate search has."""
    a = approx.select("query_id", "vec_id", F.lit(1).alias("hit"))
    j = exact.select("query_id", "vec_id").join(a, ["query_id", "vec_id"], "left")
    return j.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("expected")).withColumn("recall", F.col("found") / F.col("expected"))
