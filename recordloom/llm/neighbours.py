"""Nearest neighbours by inner product with a vantage-point tree per shard.

Inner product becomes distance by one more coordinate: sqrt(M^2 - |x|^2) for a stored vector, 0 for a query, M
being the shard's largest norm. A tree splits its vectors at the median distance from a vantage point. A search
visits the nearer side first; the other side is skipped if relax * (its least possible distance) exceeds the
distance of the k-th best so far. With relax = 1 that is the triangle inequality and the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.work import materialize

#: Vectors in one tree, queries in one block, blocks that meet one copy of a tree: a task holds one tree and one block.
SHARD, BLOCK, BLOCKS = 8192, 2048, 16
LEAF = 512
#: What rounding may do to a score, as a share of the product of norms.
ROUNDING = 1e-9


class Tree:
    """Distinct vectors of a shard in the order of the leaves.

    Rows of nodes are lo, hi, row of the vantage point, median distance, inner, outer; inner is -1 for a leaf.
    """

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray):
        self.vectors, self.nodes = vectors, nodes
        self.top = float((vectors**2).sum(axis=1).max()) if len(vectors) else 0.0

    @staticmethod
    def build(vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and for each of its rows the row of the given vectors."""
        norms = (vectors**2).sum(axis=1)
        extra = np.sqrt(np.maximum((norms.max() if len(norms) else 0.0) - norms, 0))
        order, nodes = np.arange(len(vectors)), []

        def split(lo: int, hi: int) -> int:
            at = len(nodes)
            nodes.append([lo, hi, -1, 0.0, -1, -1])
            if hi - lo <= LEAF:
                return at
            own = order[lo:hi]
            mean = vectors[own].mean(axis=0)
            far = own[np.argmax(((vectors[own] - mean) ** 2).sum(axis=1))]  # an outlying point separates best
            distance = np.sqrt(((vectors[own] - vectors[far]) ** 2).sum(axis=1) + (extra[own] - extra[far]) ** 2)
            ranked = np.argsort(distance, kind="stable")
            middle = (hi - lo) // 2
            order[lo:hi] = own[ranked]
            nodes[at][2:] = [far, distance[ranked[middle]], split(lo, lo + middle), split(lo + middle, hi)]
            return at

        if len(vectors):
            split(0, len(vectors))
        placed = np.empty(len(vectors), np.int64)
        placed[order] = np.arange(len(vectors))
        table = np.array(nodes, np.float64).reshape(-1, 6)
        inside = table[:, 4] >= 0
        table[inside, 2] = placed[table[inside, 2].astype(np.int64)]
        return Tree(vectors[order], table), order

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs sorted by query: the k best rows of each query and all that may tie with the last of them."""
        n = len(queries)
        self._q, self._relax = queries, relax
        norms = (queries**2).sum(axis=1)
        self._squares = norms + self.top
        self._slack = ROUNDING * np.sqrt(norms * self.top)
        self._score = np.full((n, min(k, max(1, len(self.vectors)))), -np.inf)
        self._found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.nodes) and n:
            self._visit(0, np.arange(n))
        query, row, score = (np.concatenate([f[i] for f in self._found] or [np.zeros(0)]) for i in range(3))
        query, row = query.astype(np.int64), row.astype(np.int64)
        use = score >= self._score.min(axis=1)[query] - self._slack[query]
        order = np.argsort(query[use], kind="stable")
        return query[use][order], row[use][order]

    def _visit(self, node: int, active: np.ndarray) -> None:
        lo, hi, vantage, median, inner, outer = self.nodes[node].tolist()
        if inner < 0:
            found = self._q[active] @ self.vectors[int(lo) : int(hi)].T
            k = self._score.shape[1]
            best = -np.partition(-np.concatenate([self._score[active], found], axis=1), k - 1, axis=1)[:, :k]
            self._score[active] = best
            q, row = np.nonzero(found >= (best.min(axis=1) - self._slack[active])[:, None])  # the bound only rises
            self._found.append((active[q], row + int(lo), found[q, row]))
            return
        dot = self._q[active] @ self.vectors[int(vantage)]
        distance = np.sqrt(np.maximum(self._squares[active] - 2 * dot, 0))  # the query's own extra coordinate is 0
        inside = distance < median
        for near, far, who in ((inner, outer, inside), (outer, inner, ~inside)):
            if who.any():
                self._visit(int(near), active[who])
                least = np.abs(distance[who] - median) * self._relax
                bound = self._score[active[who]].min(axis=1) - self._slack[active[who]]
                worst = np.sqrt(np.maximum(self._squares[active[who]] - 2 * bound, 0))
                again = active[who][~(least > worst + 1e-9)]
                if len(again):
                    self._visit(int(far), again)


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


CELL = "shard long, lot long, kind int, dim int, ids binary, vectors binary, starts binary, nodes binary"


def _planted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row: the tree of a shard's distinct vectors, and the ascending ids of each of them."""
    table = table.sort_by("vec_id")
    ids = table.column("vec_id").to_numpy()
    distinct, which = np.unique(_matrix(table.column("vector")), axis=0, return_inverse=True)
    tree, order = Tree.build(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place[which.ravel()]
    by_place = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[by_place], np.arange(len(order) + 1))
    return _cell(key, 0, ids[by_place], tree.vectors, starts, tree.nodes)


def _blocked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row: the queries of a block."""
    table = table.sort_by("vec_id")
    return _cell(key, 1, table.column("vec_id").to_numpy(), _matrix(table.column("vector")), np.zeros(0), np.zeros(0))


def _cell(key, kind: int, ids, vectors, starts, nodes) -> pa.Table:
    packed = [np.ascontiguousarray(x).astype(t).tobytes() for x, t in ((ids, "<i8"), (vectors, "<f8"), (starts, "<i8"), (nodes, "<f8"))]
    long = lambda v: pa.array([v], pa.int64())
    return pa.table([long(key[0].as_py()), long(0), pa.array([kind], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]], names=[c.split()[0] for c in CELL.split(", ")])


def _searcher(k: int, relax: float):
    """Rows of cells, each cell's tree before its blocks of queries, to the k best of the tree for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = tree = ids = starts = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                numbers = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                own = (row["shard"], row["lot"], row["dim"])
                if row["kind"] == 0:
                    cell, ids, starts = own, numbers, np.frombuffer(row["starts"], "<i8")
                    tree = Tree(vectors, np.frombuffer(row["nodes"], "<f8").reshape(-1, 6))
                elif own == cell:
                    yield _best(tree, ids, starts, numbers, vectors, k, relax)

    return run


def _best(tree: Tree, ids: np.ndarray, starts: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> pa.RecordBatch:
    query, row = tree.search(queries, k + 1, relax)  # one vector may be the query's own
    bounds = np.searchsorted(query, np.arange(len(queries) + 1))
    out: list[list] = [[], [], []]
    for q, query_id in enumerate(query_ids.tolist()):
        rows = row[bounds[q] : bounds[q + 1]]
        exact = np.add.accumulate(tree.vectors[rows] * queries[q], axis=1)[:, -1]  # term by term, in order
        members = [ids[starts[r] : starts[r + 1]][: k + 1] for r in rows.tolist()]
        own = np.concatenate([np.zeros(0, np.int64), *members])
        said = np.repeat(exact, [len(m) for m in members])
        own, said = own[own != query_id], said[own != query_id]
        best = np.lexsort((own, -said))[:k]
        out[0].extend([query_id] * len(best))
        out[1].extend(own[best])
        out[2].extend(said[best])
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    relax: float = 1.1,
    shard_rows: int = SHARD,
    block_rows: int = BLOCK,
    lot_blocks: int = BLOCKS,
) -> DataFrame:
    """The k best rows of vectors for each row of queries: query_id, rank, vec_id, score.

    Every vector is indexed, in shards of about shard_rows; a shard's tree is built once and stored. Every block of
    about block_rows queries meets every shard: lots of lot_blocks blocks stream past a copy of the tree. Equal vectors
    of a shard are stored once. Scores are inner products in double precision, added in order, so equal vectors have
    equal scores; ties go to the smaller id, whatever their number. A row isn't its own neighbour (rows with equal ids
    count as the same row). relax = 1 searches exactly; larger values prune more.

    Null ids, null, empty or zero vectors and vectors with null or non-finite components take no part. Vectors meet
    those of the same length only. Repeated rows with one id are reported once each. Empty tables give no rows.
    """
    usable = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)

    def chosen(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        return own.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))

    stored, asked = chosen(vectors), chosen(queries)
    n, m = stored.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    lots = -(-blocks // lot_blocks)
    part = lambda df, parts: df.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    trees = materialize(part(stored, shards).groupBy("part", "dim").applyInArrow(_planted, CELL), "vp-trees").withColumn("lot", each(lots))
    asked = materialize(part(asked, blocks).groupBy("part", "dim").applyInArrow(_blocked, CELL), "vp-queries")
    asked = asked.withColumn("lot", F.pmod("shard", F.lit(lots))).withColumn("shard", each(shards))
    cells = trees.unionByName(asked).repartition("shard", "lot").sortWithinPartitions("shard", "lot", "dim", "kind")
    found = cells.mapInArrow(_searcher(k, relax), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
