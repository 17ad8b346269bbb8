"""Clusters by integer k-means whose vectors look for their centroid in a vantage-point tree.

Each round builds a tree over the centroids, sends it to every task, and each vector searches it best-first. Leaf distances
are exact integers; what a tree can't rule out by more than rounding is looked at, so ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stage

#: Components of a vector, centroids and rounds; what a component is multiplied by before it is floored.
DIM, K, ROUNDS, SCALE = 64, 40, 5, 256
#: Components from here on would let distances outgrow a long.
LARGEST = float(1 << 18)
#: Centroids in a leaf at most, and vectors that search together.
LEAF, BLOCK = 4, 4096
#: Relative slack of bounds, far above what rounding of square roots can do.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes by number; an inner node has a centroid as its vantage point, and children with the range of their distances to it."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def add(self, ids: np.ndarray) -> int:
        at = len(self.vantage)
        self.vantage.append(-1)
        self.members.append(ids)
        self.children.append([])
        if len(ids) <= LEAF:
            return at
        point, rest = ids[0], ids[1:]
        far = np.sqrt(squares(self.centroids[rest], self.centroids[point]).astype(float))
        order = np.argsort(far, kind="stable")
        self.vantage[at], self.members[at] = int(point), ids[:0]
        for half in np.array_split(order, 2):
            self.children[at].append((self.add(rest[half]), far[half].min(), far[half].max()))
        return at

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` the smallest squared distance and the smallest centroid number that has it.

        Every row has a queue of its own, a row of ``bound`` with the least distance that each open node may hold;
        it takes its best node until that one lies beyond its best distance. Rows at one node are measured together.
        """
        best, arg = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.centroids))
        bound = np.full((len(q), len(self.vantage)), np.inf)
        bound[:, 0] = 0
        active = np.arange(len(q))
        while len(active):
            pick = bound[active].argmin(1)
            low = bound[active, pick]
            alive = np.isfinite(low) & (low * (1 - SLACK) <= np.sqrt(best[active].astype(float)))  # inclusive: equal distances are looked at
            active, pick, low = active[alive], pick[alive], low[alive]
            bound[active, pick] = np.inf
            for node in np.unique(pick):
                here = pick == node
                rows, least = active[here], low[here]
                point = self.vantage[node]
                for c in self.members[node] if point < 0 else [point]:
                    d = squares(q[rows], self.centroids[c])
                    better = (d < best[rows]) | ((d == best[rows]) & (c < arg[rows]))
                    best[rows[better]], arg[rows[better]] = d[better], c
                if point >= 0:
                    far = np.sqrt(d.astype(float))
                    for child, lo, hi in self.children[node]:
                        bound[rows, child] = np.maximum(least, np.maximum(lo - far, far - hi) - SLACK * (far + hi))
        return arg.astype(np.int32), best


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def tree_over(centroids: np.ndarray) -> Tree:
    t = Tree(centroids)
    t.add(np.arange(len(centroids)))
    return t


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that count, as doubles."""
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>")).filter(F.size("embedding") == DIM)
    return kept.filter(fits)


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids; equal ids go by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(name, "embedding").limit(k).collect()
    return _integers(np.array([r["embedding"] for r in rows], dtype=float).reshape(-1, DIM))


def _integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64)


def _searched(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            q = _integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))
            yield part.column("vec_id"), q, *tree.nearest(q)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each task sums its vectors for each cluster, Spark adds up the sums."""
    tree = kept.sparkSession.sparkContext.broadcast(tree_over(centroids))
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        for _, q, cluster, _ in _searched(batches, tree.value):
            np.add.at(total, cluster, q)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = kept.mapInArrow(sums, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums"))
    rows = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # k times DIM at most
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    tree.unpersist()
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, written and read again."""
    tree = kept.sparkSession.sparkContext.broadcast(tree_over(centroids))
    kind = kept.schema["vec_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _searched(batches, tree.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = stage(kept.mapInArrow(search, f"vec_id {kind}, cluster int, distance long"))
    tree.unpersist()
    return out


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that counts, the final centroids).

    A vector counts if it has exactly 64 components, none null or non-finite and none from 2^18 on, which no long could
    hold the distances of; others give no row. Components are floored after multiplying by 256. Fewer vectors than ``k``
    give as many centroids; repeated vectors may give equal ones, of which the smaller number takes all. Empty clusters
    keep their centroid. A null id counts as an empty string where the first centroids are chosen. No vectors, no rows.
    """
    spark = vectors.sparkSession
    kept = whole(vectors)
    with arrow_batches(spark, BLOCK):
        centroids = first_centroids(kept, k, salt)
        for _ in range(rounds if len(centroids) else 0):
            centroids = moved(kept, centroids)
        out = assigned(kept, centroids) if len(centroids) else kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return out, centroids


def cluster_report(vectors: DataFrame) -> DataFrame:
    """Each vector's cluster with the inertia of the cluster and of all, and the hash of its centroid."""
    rows, centroids = cluster_vectors(vectors)
    totals = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    facts = [(c, t, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in totals.items()]
    small = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql() -> str:
    """The same by plain SQL: every vector against every centroid, round by round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x) AND abs(x) < {LARGEST:.0f}, false))) = {DIM})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c, v FROM kept QUALIFY c < {K})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{i} c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS MATERIALIZED (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, generate_subscripts(k.v, 1) AS j, unnest(k.v) AS x FROM a{i} a JOIN kept k USING (r)) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c) m USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (r) JOIN c{ROUNDS} c ON c.c = a.c"""
