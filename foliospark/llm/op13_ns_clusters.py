"""Centroid clustering with distance bounds loosened by total displacement (ns-bounds).

Every vector keeps an upper bound of the distance to its centroid and, for
each group of centroids, a lower bound of the distance to the nearest other
one, each with the round it was computed in. The centroids of all rounds are
kept, so a bound of round t is loosened by how far its centroid lies from
where it was at t, not by the sum of the steps between. Where the loosened
bounds overlap, exact integer distances are computed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._registry import keep, query, table

DIM, K, ROUNDS, SEED = 64, 40, 5, "2"
#: Centroids that share a lower bound: 3 bytes per vector and group.
GROUP = 2
#: Vectors of one block, a row of the tables between rounds.
BLOCK_ROWS = 8192
#: Components are held within plus and minus this, so that distances fit in 64 bits.
LIMIT = 1 << 26
_STATE = "ids array<bigint>, x binary, kind string, own binary, ub binary, ut binary, lb binary, lt binary, scans bigint, sums binary, sizes binary"


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows with exactly ``dim`` components, none null or non-finite."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & fine)


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256 * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` and centroids ``c``, both int64.

    Below 2**53 the double-precision product has no rounding, whatever its order.
    """
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    a, b = (x.astype(np.float64), c.astype(np.float64)) if x.shape[1] * (2 * int(most)) ** 2 < 1 << 53 else (x, c)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def _down(x):
    """Lower bounds in two bytes, rounded down; larger ones than two bytes hold are cut, which keeps them bounds."""
    return np.nextafter(np.minimum(x, 60000).astype(np.float16), np.float16(-np.inf))


def _up(x):
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def grouped(c: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """Near centroids together: farthest-first seeds, then the nearest seed of each."""
    n = -(-len(c) // size)
    seeds = [0]
    while len(seeds) < n:
        seeds.append(int(squared(c, c[seeds]).min(1).argmax()))
    own = squared(c, c[seeds]).argmin(1)
    return [np.flatnonzero(own == g) for g in range(n) if (own == g).any()]


class Bounds:
    """One block of vectors with its assignment and bounds."""

    def __init__(self, x: np.ndarray, n_groups: int):
        n = len(x)
        self.x, self.own, self.scans = x, np.full(n, -1, np.int32), 0
        self.ub, self.ut = np.zeros(n, np.float32), np.zeros(n, np.uint8)
        self.lb, self.lt = np.zeros((n, n_groups), np.float16), np.zeros((n, n_groups), np.uint8)

    def assign(self, history: list[np.ndarray], groups: list[np.ndarray]) -> None:
        """Nearest centroid of the newest round for every vector; equal distances go to the smaller number."""
        now = len(history) - 1
        c = history[now]
        if now == 0:
            self._rescan(np.arange(len(self.x)), np.ones((len(self.x), len(groups)), bool), np.zeros((len(self.x), len(groups))), c, groups, 0)
            return
        moved = np.sqrt([((c - old).astype(np.float64) ** 2).sum(1) for old in history]) * (1 + 1e-9)
        by_group = np.stack([moved[:, g].max(1) for g in groups], 1)
        upper = self.ub + moved[self.ut, self.own]
        lower = self.lb.astype(np.float64) - by_group[self.lt, np.arange(len(groups))[None, :]]
        rows = np.flatnonzero(lower.min(1) <= upper)
        if not rows.size:
            return
        self.scans += rows.size
        exact = ((self.x[rows] - c[self.own[rows]]) ** 2).sum(1)
        self.ub[rows], self.ut[rows] = _up(np.sqrt(exact)), now
        near = lower[rows] <= self.ub[rows, None]
        some = near.any(1)
        self._rescan(rows[some], near[some], lower[rows[some]], c, groups, now, exact[some])

    def _rescan(self, rows, near, lower, c, groups, now, exact=None) -> None:
        """Exact distances of ``rows`` to the groups marked in ``near``, then new bounds of those groups."""
        if not rows.size:
            return
        before = self.own[rows]
        best = before.copy()
        least = np.full(rows.size, np.iinfo(np.int64).max) if exact is None else exact.copy()
        found = []
        for g, members in enumerate(groups):
            pick = np.flatnonzero(near[:, g])
            d = squared(self.x[rows[pick]], c[members])
            self.scans += d.size
            found.append((pick, d))
            if pick.size:
                at = d.argmin(1)
                low, number = d[np.arange(pick.size), at], members[at]
                better = (low < least[pick]) | ((low == least[pick]) & (number < best[pick]))
                least[pick[better]], best[pick[better]] = low[better], number[better]
        self.own[rows], self.ub[rows], self.ut[rows] = best, _up(np.sqrt(least)), now
        for g, ((pick, d), members) in enumerate(zip(found, groups, strict=True)):
            if pick.size:
                others = np.where(members[None, :] == best[pick, None], np.inf, np.sqrt(d))
                self.lb[rows[pick], g], self.lt[rows[pick], g] = _down(others.min(1)), now
            if exact is not None:
                left = np.flatnonzero(~near[:, g] & (best != before) & np.isin(before, members))
                if left.size:
                    self.lb[rows[left], g] = _down(np.minimum(lower[left, g], np.sqrt(exact[left])))
                    self.lt[rows[left], g] = now

    def distances(self, c: np.ndarray) -> np.ndarray:
        return ((self.x - c[self.own]) ** 2).sum(1)

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.own, kind="stable")
        numbers, first = np.unique(self.own[order], return_index=True)
        out, sizes = np.zeros((k, self.x.shape[1]), np.int64), np.bincount(self.own, minlength=k)
        if numbers.size:
            out[numbers] = np.add.reduceat(self.x[order], first, axis=0)
        return out, sizes


def _narrow(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32)


def _row(ids: pa.Array, b: Bounds, k: int) -> pa.RecordBatch:
    sums, sizes = b.sums(k)
    x = _narrow(b.x)
    cells = [ids, x.tobytes(), x.dtype.str, b.own.tobytes(), b.ub.tobytes(), b.ut.tobytes(), b.lb.tobytes(), b.lt.tobytes(), b.scans, sums.tobytes(), sizes.tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        + [pa.array([v], pa.int64() if isinstance(v, int) else pa.string() if isinstance(v, str) else pa.binary()) for v in cells[1:]],
        [f.split()[0] for f in _STATE.split(", ")],
    )


def _held(row: dict, dim: int, n_groups: int) -> Bounds:
    x = np.frombuffer(row["x"], row["kind"]).reshape(-1, dim).astype(np.int64)
    b = Bounds(x, n_groups)
    b.own, b.ub = np.frombuffer(row["own"], np.int32).copy(), np.frombuffer(row["ub"], np.float32).copy()
    b.ut, b.scans = np.frombuffer(row["ut"], np.uint8).copy(), row["scans"]
    b.lb = np.frombuffer(row["lb"], np.float16).reshape(-1, n_groups).copy()
    b.lt = np.frombuffer(row["lt"], np.uint8).reshape(-1, n_groups).copy()
    return b


def _totals(state: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int]]:
    """Sums and sizes of all clusters: k * (dim + 1) numbers, summed in Spark, come to the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for sums, sizes in zip(batch.column(0), batch.column(1), strict=True):
                total[:, :dim] += np.frombuffer(sums.as_py(), np.int64).reshape(k, dim)
                total[:, dim] += np.frombuffer(sizes.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["cell", "n"])

    rows = state.select("sums", "sizes").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n")
    )
    flat = [0] * (k * (dim + 1))
    for row in rows.collect():
        flat[row["cell"]] = int(row["n"])
    lines = [flat[j * (dim + 1) : (j + 1) * (dim + 1)] for j in range(k)]
    return [line[:dim] for line in lines], [line[dim] for line in lines]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED):
    """``(assigned, centroids, scans)`` for ``vectors (vec_id, embedding)``.

    Vectors whose length is not ``dim``, or with null or non-finite components,
    take no part; components beyond +-2**18 count as that. The first centroids
    are the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (rows
    without an id start none; repeated ids go by their components), fewer when
    there are fewer. ``assigned`` holds ``vec_id, cluster, distance`` per row,
    repeated rows each; it is empty, without centroids, for an empty table.
    ``scans`` counts the exact distances that were computed.
    """
    if not 1 <= rounds <= 250:
        raise ValueError("rounds are held in one byte")
    spark = vectors.sparkSession
    vectors = usable(vectors, dim).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    drawn = vectors.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = drawn.orderBy("h", "embedding").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.empty((0, dim), np.int64), 0
    history = [whole(np.array([r["embedding"] for r in first], np.float64))]
    k = len(first)
    groups = grouped(history[0])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                b = Bounds(whole(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)), len(groups))
                b.assign(history[:1], groups)
                yield _row(part.column("vec_id"), b, k)

    state = keep(vectors.mapInArrow(start, _STATE), "clusters")
    for _ in range(rounds):
        totals, sizes = _totals(state, k, dim)
        moved = [[s // n for s in line] if n else [int(v) for v in old] for line, n, old in zip(totals, sizes, history[-1], strict=True)]
        history.append(np.array(moved, np.int64))
        so_far = list(history)

        def again(batches: Iterator[pa.RecordBatch], so_far=so_far) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.to_pylist()):
                    b = _held(row, dim, len(groups))
                    b.assign(so_far, groups)
                    yield _row(batch.column("ids")[i].values, b, k)

        state = keep(state.mapInArrow(again, _STATE), "clusters")
    last = history[-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                b = _held(row, dim, len(groups))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(b.own, pa.int32()), pa.array(b.distances(last), pa.int64())],
                    ["vec_id", "cluster", "distance"],
                )

    assigned = state.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint")
    return assigned, last, int(state.agg(F.sum("scans")).first()[0])


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with ``cluster_inertia, inertia, centroid_sha256``; one row per cluster is joined, at most ``k``."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    per = {r["cluster"]: int(r["s"]) for r in sums.collect()}
    most = (1 << 63) - 1
    lines = [
        (j, min(per.get(j, 0), most), min(sum(per.values()), most), hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest())
        for j, c in enumerate(centroids)
    ]
    facts = spark.createDataFrame(lines, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out, every distance computed."""
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS INTEGER) AS j, x
        FROM v WHERE vec_id IS NOT NULL QUALIFY j < {K})""",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, j, d FROM (SELECT v.r, c.j, {dist} AS d,
        row_number() OVER (PARTITION BY v.r ORDER BY {dist}, c.j) AS n FROM v, c{t} c) q WHERE n = 1)""")
        if t < ROUNDS:
            parts.append(f"""m{t} AS (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT a.j, unnest(v.x) AS e,
            generate_subscripts(v.x, 1) AS i FROM a{t} a JOIN v ON v.r = a.r) q GROUP BY j, i)""")
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(g.x, c.x) AS x FROM c{t} c LEFT JOIN
            (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{t} GROUP BY j) g ON g.j = c.j)""")
    return f"""WITH {", ".join(parts)}
    SELECT v.vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance,
      CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN c{ROUNDS} c ON c.j = a.j"""


@query("op13_ns_clusters", _oracle())
def op13_ns_clusters(spark, sf_dir):
    assigned, centroids, _ = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return with_inertia(assigned, centroids)
