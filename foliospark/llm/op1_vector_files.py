"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import apart
from ._registry import keep, query, table

#: Vectors in a block of the file, and queries in a block that scans it.
BLOCK, QUERY_BLOCK = 2048, 512
#: Bytes of queries, about, that a task holds beside one block of the file.
LOT_BYTES = 32 << 20
CELLS = 256
K = 5


def valid(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def cell_edges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension count, the smallest and largest value of each component: one row per component."""
    parts = vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("i", "x"))
    rows = parts.groupBy("dim", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        out.setdefault(r["dim"], ([], []))
        out[r["dim"]][0].append(r["lo"])
        out[r["dim"]][1].append(r["hi"])
    return {d: (np.array(lo, np.float64), np.array(hi, np.float64)) for d, (lo, hi) in out.items()}


#: Of vectors without components.
_NO_EDGES = (np.empty(0), np.empty(0))


def _blocks(edges, size: int):
    """Pack rows ``id, v, least`` into blocks: cells of one byte a component, and exact values beside them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim):
            ids, values, least = zip(*held.pop(dim), strict=True)
            exact = np.array(values, np.int64).reshape(len(ids), dim)
            lo, hi = edges.get(dim, _NO_EDGES)
            cells = np.clip((exact - lo) * (CELLS / np.maximum(hi - lo + 1, 1)), 0, CELLS - 1).astype(np.uint8)
            place = (ids[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([place], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([least], pa.list_(pa.float64())), pa.array([cells.tobytes()], pa.binary()),
                 pa.array([exact.tobytes()], pa.binary())],
                ["dim", "place", "ids", "least", "cells", "exact"],
            )

        for batch in batches:
            rows = batch.to_pydict()
            for i, v, least in zip(rows["id"], rows["v"], rows["least"], strict=True):
                held.setdefault(len(v), []).append((i, v, least))
                if len(held[len(v)]) == size:
                    yield flush(len(v))
        for dim in sorted(held):
            yield flush(dim)

    return pack


_BLOCK_SCHEMA = "dim int, place long, ids array<long>, least array<double>, cells binary, exact binary"


def _bounds(queries: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Lower and upper bounds of the inner products of every query with every vector of a block."""
    width = np.maximum(hi - lo + 1, 1) / CELLS
    low = lo + np.floor(cells * width)
    high = np.minimum(lo + np.ceil((cells + 1.0) * width), hi)
    low = np.minimum(low, high)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    # Room for rounding: the products of a bound are whole numbers, their sums may be rounded beyond 2**53.
    slack = 1e-12 * np.abs(queries).sum(1, keepdims=True) * max(1.0, float(np.abs(np.stack([lo, hi])).max(initial=0))) + 0.5
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def _matrices(row, edges):
    """Query ids, least scores and values, and ids, cells and edges of one pair of blocks."""
    dim, asked, ids = row["dim"], np.array(row["query_ids"]), np.array(row["ids"])
    queries = np.frombuffer(row["query_values"], np.int64).reshape(len(asked), dim)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
    return asked, np.array(row["query_least"], float), queries, ids, cells, *edges.get(dim, _NO_EDGES)


def _lower_bounds(edges, k: int):
    """First scan: of every query, the ``k`` largest lower bounds in the blocks of a task."""

    def largest(bounds: np.ndarray) -> np.ndarray:
        rest = max(0, bounds.shape[1] - k)
        return np.partition(bounds, rest, axis=1)[:, rest:] if rest else bounds

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                asked, _, queries, ids, cells, lo, hi = _matrices(batch.slice(at, 1).to_pylist()[0], edges)
                lower, _ = _bounds(queries.astype(float), cells, lo, hi)
                lower[asked[:, None] == ids[None, :]] = -np.inf
                key, found = asked.tobytes(), largest(lower)
                best[key] = largest(np.hstack([best[key], found])) if key in best else found
        for key, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.frombuffer(key, np.int64), found.shape[1])), pa.array(found.reshape(-1))],
                ["query_id", "bound"],
            )

    return scan


def _exact_scores(edges, k: int):
    """Second scan: exact vectors in the order of their bounds, until none left can be among the best ``k``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                asked, least, queries, ids, cells, lo, hi = _matrices(row, edges)
                exact = np.frombuffer(row["exact"], np.int64).reshape(len(ids), row["dim"])
                _, upper = _bounds(queries.astype(float), cells, lo, hi)
                upper[asked[:, None] == ids[None, :]] = -np.inf
                out = []
                for q in np.flatnonzero((upper >= np.maximum(least, -1e300)[:, None]).any(1)):
                    order = np.flatnonzero((upper[q] >= least[q]) & np.isfinite(upper[q]))
                    order = order[np.argsort(-upper[q, order], kind="stable")]
                    found: list[tuple[int, int]] = []
                    for start in range(0, len(order), 16):
                        part = order[start : start + 16]
                        if len(found) >= k and upper[q, part[0]] < -found[k - 1][0]:
                            break
                        scores = (exact[part] * queries[q]).sum(1)
                        found = sorted(found + [(-int(s), int(i)) for s, i in zip(scores, ids[part], strict=True)])[:k]
                    out += [(int(asked[q]), i, -s) for s, i in found]
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "id", "score"])

    return scan


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` vectors with the largest inner product for every query, exactly.

    ``vectors``, ``queries``: ``id, v`` (array of long); a query finds no row
    of its own id. Returns ``query_id, rank, id, score``, ties to the smaller
    id; fewer rows where there are fewer vectors, none for empty tables.
    Vectors meet queries of their own length only. Null ids take no part. Rows
    repeated in ``vectors`` are candidates of their own; a query id given twice
    counts once, with the smaller vector. Scores are 64-bit sums.

    The file holds blocks of cells, one byte a component, and beside them the
    exact values. The first scan reads cells alone: the k-th largest lower
    bound over all blocks is a score that k vectors are sure to reach. The
    second reads exact vectors of a block in the order of their bounds, best
    first, and stops where no bound reaches that score or the k-th exact one
    found so far. The file is dealt over groups of blocks by key, the query
    blocks are repeated for each group, and every pair of blocks meets in an
    equi-join of shuffled rows: nothing is broadcast, since the repeated query
    blocks grow with the queries, however small their files are. A task holds
    one block of the file and the query blocks of one lot, about ``LOT_BYTES``;
    only where queries fill several lots is the file repeated for each.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("id is not null").select("id", "v", F.lit(None).cast("double").alias("least"))
    queries = queries.filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    edges = cell_edges(vectors.select("id", "v").unionByName(queries))
    file = keep(vectors.mapInArrow(_blocks(edges, BLOCK), _BLOCK_SCHEMA), "vector-file")
    groups = max(1, min(file.count(), 8 * spark.sparkContext.defaultParallelism))
    dealt = file.drop("least").withColumn("group", F.pmod("place", F.lit(groups)))
    asked = keep(queries, "vector-queries")
    lots = 1 + asked.count() * 8 * max(edges, default=0) // LOT_BYTES
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def pairs(asked: DataFrame, columns: list[str]) -> DataFrame:
        packed = asked.mapInArrow(_blocks(edges, QUERY_BLOCK), _BLOCK_SCHEMA).select(
            "dim", F.col("ids").alias("query_ids"), F.col("least").alias("query_least"), F.col("exact").alias("query_values"),
            F.pmod("place", F.lit(lots)).alias("lot"), numbers(groups).alias("group"),
        )
        parts = dealt.select("dim", "group", numbers(lots).alias("lot"), "ids", *columns)
        return parts.join(apart(packed), ["dim", "group", "lot"]).drop("group", "lot")

    bounds = pairs(asked.withColumn("least", F.lit(0.0)), ["cells"]).mapInArrow(
        _lower_bounds(edges, k), "query_id long, bound double"
    )
    top = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    kth = (
        bounds.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k)
        .groupBy("query_id").agg(F.min("bound").alias("bound"), F.count("*").alias("n"))
    )
    least = F.when(F.col("n") == k, F.col("bound")).otherwise(F.lit(float("-inf")))
    armed = keep(
        asked.join(kth, F.col("id") == F.col("query_id"), "left").select(
            "id", "v", F.coalesce(least, F.lit(float("-inf"))).alias("least")
        ), "vector-armed",
    )
    scored = pairs(armed, ["cells", "exact"]).mapInArrow(
        _exact_scores(edges, k), "query_id long, id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_vector_files", ORACLE)
def op1_vector_files(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter(valid(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v")
    )
    return top_k(rows, rows.filter(F.col("id") % 50 == 0)).withColumnRenamed("id", "vec_id")
