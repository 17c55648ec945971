"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on at most `SAMPLE` vectors, those with the smallest hash; every vector is indexed. A node splits at
the median along the widest of some random directions between sampled vectors. A query walks all trees through one queue,
ordered by how far the query lies beyond the hyperplanes on the way, and opens leaves until they hold `reach` times the
rows of the table and at least `LEAST` rows, all trees together; so a table of up to `LEAST` / `TREES` vectors is searched whole. The
opened leaves' vectors are ranked by their exact distance.

Equal vectors are one entry that keeps as many of its smallest ids as a result can show. Leaves meet their queries in
groups of `TOGETHER` neighbours: the vectors of a group that outgrows `CHUNK` rows are dealt out, and so are the queries
where there are more than `ASKED`; a query's vector comes to a group once, with the leaves it opened there. So a task holds at
most about CHUNK vectors and ASKED queries, and 256 x CHUNK distances at a time. Trees, leaf sizes and the sample are bounded
by parameters, whatever the table holds.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than most.
Rows without an id take no part; repeated rows count once; equal ids with other vectors are candidates of their own, but
never for a query of that id; ties go to the smaller id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_batches, written

TREES = 8
LEAF = 128
SAMPLE = 32_768
REACH = 1.3
TOP = 10
DIRECTIONS = 32
CHUNK = 32_768
TOGETHER = 16
LEAST = 40_000
ASKED = 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding")
    # a null vector fails every test
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(size.select("n")), F.size("v") == F.col("n")).select("vec_id", "v").distinct()


class Forest:
    def __init__(self, normals: list[list[np.ndarray]], bounds: list[list[np.ndarray]]):
        self.normals, self.bounds = normals, bounds
        self.depth = len(normals[0])

    @classmethod
    def grown(cls, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11) -> "Forest":
        random = np.random.default_rng(seed)
        normals, bounds = [], []
        for _ in range(trees):
            groups, own_n, own_b = [np.arange(len(sample))], [], []
            for _ in range(depth):
                n, b, below = [], [], []
                for g in groups:
                    if len(g) < 2:
                        w, m, side = np.zeros(sample.shape[1]), 0.0, np.zeros(len(g), bool)
                    else:
                        tries = sample[random.choice(g, DIRECTIONS)] - sample[random.choice(g, DIRECTIONS)]
                        tries /= np.maximum(np.linalg.norm(tries, axis=1, keepdims=True), 1e-300)
                        w = tries[(sample[g[:2048]] @ tries.T).var(axis=0).argmax()]
                        p = (sample[g] * w).sum(axis=1)
                        m = float(np.median(p))
                        side = p > m
                    n.append(w)
                    b.append(m)
                    below += [g[~side], g[side]]
                groups = below
                own_n.append(np.array(n))
                own_b.append(np.array(b))
            normals.append(own_n)
            bounds.append(own_b)
        return cls(normals, bounds)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.zeros((len(vectors), len(self.normals)), np.int32)
        for t, (normals, bounds) in enumerate(zip(self.normals, self.bounds)):
            node = np.zeros(len(vectors), np.int64)
            for n, b in zip(normals, bounds):
                node = node * 2 + ((vectors * n[node]).sum(axis=1) > b[node])
            out[:, t] = node
        return out

    def opened(self, query: np.ndarray, sizes: np.ndarray, rows: float) -> list[tuple[int, int]]:
        """Leaves in the order of the shared queue, until they hold `rows` rows. `sizes` is (trees, leaves)."""
        queue = [(0.0, t, 0, 0) for t in range(len(self.normals))]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < rows:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                d = float(self.normals[t][level][node] @ query - self.bounds[t][level][node])
                other, node = (node * 2, node * 2 + 1) if d > 0 else (node * 2 + 1, node * 2)
                level += 1
                heapq.heappush(queue, (max(far, abs(d)), t, level, other))
            if sizes[t, node]:
                out.append((t, node))
                held += sizes[t, node]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _indexer(forest):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.value.leaves(_matrix(b.column("v")))
                own = pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32), leaves.ravel())
                yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("v"), own], names=["ids", "v", "leaves"])

    return index


def _walker(plan):
    schema = pa.schema([("query_id", pa.int64()), ("n", pa.int64()), ("tree", pa.int32()), ("g", pa.int32()), ("leaves", pa.list_(pa.int32()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes, rows = plan.value
        for b in batches:
            for q, n, v in zip(b.column("vec_id").to_pylist(), b.column("n").to_pylist(), _matrix(b.column("v")) if b.num_rows else []):
                groups: dict[tuple[int, int], list[int]] = {}
                for t, x in forest.opened(v, sizes, rows):
                    groups.setdefault((t, x // TOGETHER), []).append(x)
                yield from arrow_batches({"query_id": [q] * len(groups), "n": [n] * len(groups), "tree": [t for t, _ in groups],
                                          "g": [g for _, g in groups], "leaves": list(groups.values())}, schema)

    return walk


def _ranker(top: int):
    def rank(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The nearest `top` of each query among the vectors of the leaves it opened here.

        Squared distances from inner products, all queries at once, choose what is measured exactly: everything up to the
        place that could matter, with room for rounding.
        """
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(index) and len(queries):
            vectors, leaf = np.stack(index["v"].to_numpy()).astype(np.float64), index["leaf"].to_numpy()
            held = index["ids"].map(len).to_numpy()
            ids, first = np.concatenate(index["ids"].to_numpy()), np.concatenate(([0], np.cumsum(held)[:-1]))
            asked = queries["query_id"].to_numpy()
            points = np.stack(queries["v"].to_numpy()).astype(np.float64)
            low = int(leaf[0]) // TOGETHER * TOGETHER
            opened = np.zeros((len(asked), TOGETHER), bool)
            opened[np.repeat(np.arange(len(asked)), queries["leaves"].map(len)), np.concatenate(queries["leaves"].to_numpy()) - low] = True
            norms = (vectors * vectors).sum(axis=1)
            parts = []
            for at in range(0, len(asked), 256):
                q = points[at:at + 256]
                size = (q * q).sum(axis=1)[:, None] + norms[None, :]
                near = np.where(opened[at:at + 256][:, leaf - low], size - 2 * (q @ vectors.T), np.inf)
                # one entry may be the query's own vector, whose ids need not last
                limit = np.partition(near, top, axis=1)[:, top] if near.shape[1] > top + 1 else np.full(len(q), np.inf)
                row, col = np.nonzero((near <= limit[:, None] + 1e-9 * size) & np.isfinite(near))
                d = np.sqrt(((vectors[col] - q[row]) ** 2).sum(axis=1))
                n = held[col]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                parts.append((np.repeat(row + at, n), ids[np.repeat(first[col], n) + step], np.repeat(d, n)))
            row, found, d = (np.concatenate(x) for x in zip(*parts))
            other = found != asked[row]
            row, found, d = row[other], found[other], d[other]
            order = np.lexsort((found, d, row))
            row, found, d = row[order], found[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            best = place < top
            out = {"query_id": asked[row[best]], "vec_id": found[best], "score": d[best]}
        return pd.DataFrame(out)

    return rank


def nearest(vectors: DataFrame, queries: Column | None = None, top: int = TOP, reach: float = REACH, trees: int = TREES,
            leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of every row of `vectors` (vec_id, embedding) that `queries` picks."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top + 1)
    entries = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v"), "entries")
    n = entries.count()
    share = min(1.0, 1.3 * sample / max(n, 1))
    order = F.xxhash64("v")
    picked = entries.filter(order <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).orderBy(order, "ids").limit(sample).select("v").toPandas()
    kind = dict(entries.dtypes)["v"]
    points = np.stack(picked["v"].to_numpy()).astype(np.float64) if len(picked) else np.zeros((1, 1))
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    depth = min(depth, int(np.log2(max(len(points) / 8, 1))))
    forest = Forest.grown(points, depth, trees)
    index = written(entries.mapInArrow(_indexer(spark.sparkContext.broadcast(forest)), f"ids array<bigint>, v {kind}, leaves array<int>"), "index")
    placed = index.select("ids", "v", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in placed.groupBy("tree", "leaf").count().toLocalIterator():
        sizes[r["tree"], r["leaf"]] = r["count"]
    together = np.add.reduceat(sizes, np.arange(0, sizes.shape[1], TOGETHER), axis=1)
    parts = max(1, int(np.ceil(together.max() / CHUNK)))
    asked = rows.filter(queries if queries is not None else F.col("vec_id") % 100 == 0).withColumn("n", F.xxhash64("v"))
    dealt = max(1, int(np.ceil(asked.count() / ASKED)))
    wanted = max(reach * n, LEAST)
    walk = asked.repartition("vec_id").mapInArrow(_walker(spark.sparkContext.broadcast((forest, sizes, wanted))), "query_id bigint, n bigint, tree int, g int, leaves array<int>")
    group = (F.col("leaf") / TOGETHER).cast("int")
    each = lambda k, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias(name)
    left = placed.select("ids", "v", "tree", "leaf", group.alias("g"), F.pmod(F.xxhash64("ids"), F.lit(parts)).alias("part"), each(dealt, "deal"))
    # how much a walk gives can't be estimated, so it is never broadcast
    right = walk.join(asked.select(F.col("vec_id").alias("query_id"), "n", "v").hint("merge"), ["query_id", "n"]).select(
        "query_id", "v", "tree", "g", "leaves", F.pmod(F.xxhash64("query_id", "n"), F.lit(dealt)).alias("deal"), each(parts, "part"))
    keys = ["tree", "g", "part", "deal"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _ranker(top), "query_id bigint, vec_id bigint, score double").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
