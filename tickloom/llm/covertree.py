"""Exact top-k inner-product search with dual cover trees.

The table is dealt into cells around pivots - the first level of the tree, chosen farthest-first from a bounded sample - and cells
that hold many rows into blocks.  Queries are grouped the same way.  A query group first searches the block that it comes from,
which gives each of its queries a k-th score to beat; then it goes to every block whose bound reaches its worst k-th score.
Within a block, cover trees over the group's queries and the block's vectors are walked together, best bound first; a pair of nodes
is left out if no pair of theirs can reach the worst k-th score of the query node:

    max q.x <= cq.cx + |cq| rx + |cx| rq + rq rx        (centres c, covering radii r)
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut, hash_bucket

LEAF = 256
FAN = 16  # children of a node at most
SHRINK = 0.9  # a node is split if its children's radius is at most this part of its own
EXACT = 1 << 53  # below it, sums of products are exact in doubles
SLACK = 1e-9  # relative; bounds are doubles, scores exact integers


class CoverTree:
    """Nodes of a cover tree over the rows of a matrix: centres, covering radii, children, and rows.  Children of a node are centres that
    lie further apart than the radius within which they cover its rows: they are taken farthest-first, until that radius is half
    the node's or there are FAN of them.  Rows that no such centres bring nearer stay one leaf: in many dimensions all rows lie about
    equally far apart, and then deeper nodes would tell nothing."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows.astype(np.float64)
        self.square = np.einsum("ij,ij->i", self.rows, self.rows)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        stack = [(np.arange(len(rows)), self.rows.mean(axis=0), -1)] if len(rows) else []
        while stack:
            members, centre, parent = stack.pop()
            apart = np.sqrt(((self.rows[members] - centre) ** 2).sum(axis=1))
            me = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(apart.max()))
            self.norm.append(float(np.sqrt(centre @ centre)))
            self.children.append([])
            self.members.append(members)
            if parent >= 0:
                self.children[parent].append(me)
            if len(members) > LEAF:
                stack += [(x, c, me) for x, c in self._split(members, apart)]

    def _split(self, members: np.ndarray, apart: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and centre of each child; none if the rows stay together."""
        scale, rows, square = apart.max(), self.rows[members], self.square[members]
        at, near, owner, centres = int(apart.argmax()), np.full(len(members), np.inf), np.zeros(len(members), np.int64), []
        while len(centres) < FAN and (not centres or near.max() > scale / 2):
            far = np.sqrt(np.maximum(square - 2 * (rows @ rows[at]) + square[at], 0))
            owner[far < near] = len(centres)
            near = np.minimum(near, far)
            centres.append(rows[at])
            at = int(near.argmax())
        if near.max() > SHRINK * scale or len(centres) < 2:
            return []
        return [(members[owner == k], c) for k, c in enumerate(centres) if (owner == k).any()]


class _Best:
    """The best k (score, id) of each query; ties to smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.worst = k, floor.astype(np.float64)
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.r_[self.row, row], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
        last = nth == self.k - 1
        self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last])
        keep = nth < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]


def search(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray, seen: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's best k here, ties to smaller ids, its own id left out.  floor: scores that a query
    has k of already; only what reaches them is looked for.  seen counts pairs of rows: all, and those that were multiplied."""
    if not len(q) or not len(x):
        return []
    qt, xt = CoverTree(q), CoverTree(x)
    best = _Best(len(q), k, floor)
    exact = float(np.sqrt(qt.square.max() * xt.square.max())) < EXACT / 2
    norms = np.sqrt(qt.square)

    def bound(a: int, b: int) -> float:
        top = float(qt.centre[a] @ xt.centre[b]) + qt.norm[a] * xt.radius[b] + xt.norm[b] * qt.radius[a] + qt.radius[a] * xt.radius[b]
        return top + SLACK * (1 + abs(top) + qt.norm[a] * xt.norm[b])

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        mine = qt.members[a]
        if -top < best.worst[mine].min():
            continue
        if qt.children[a] and (not xt.children[b] or qt.radius[a] >= xt.radius[b]):
            below = [(c, b) for c in qt.children[a]]
        elif xt.children[b]:
            below = [(a, c) for c in xt.children[b]]
        else:
            # a bound of each query's own, then all products of the leaves at once
            own = qt.rows[mine] @ xt.centre[b]
            mine = mine[own + norms[mine] * xt.radius[b] + SLACK * (1 + np.abs(own) + norms[mine] * xt.norm[b]) >= best.worst[mine]]
            for theirs in np.array_split(xt.members[b], -(-len(xt.members[b]) // 4096)):
                if not len(mine):
                    break
                scores = qt.rows[mine] @ xt.rows[theirs].T if exact else q[mine] @ x[theirs].T
                if seen is not None:
                    seen["multiplied"] = seen.get("multiplied", 0) + scores.size
                strange = q_ids[mine][:, None] != x_ids[theirs][None, :]
                scores[~strange] = -(1 << 62)
                least = best.worst[mine]
                if scores.shape[1] > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                i, j = np.nonzero((scores >= least[:, None]) & strange)
                best.add(mine[i], scores[i, j].astype(np.int64), x_ids[theirs[j]])
            continue
        for pair in below:
            if (limit := bound(*pair)) >= best.worst[qt.members[pair[0]]].min():
                heapq.heappush(heap, (-limit, *pair))
    if seen is not None:
        seen["all"] = seen.get("all", 0) + len(q) * len(x)
    return list(zip(q_ids[best.row].tolist(), best.id.tolist(), best.score.tolist(), strict=True))


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v ARRAY<LONG>, dim): floor(scale * x) of each component.  Vectors null, empty or with a null or non-finite component
    are left out, as are rows without an id."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.forall("w", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), wide.alias("w")).where(F.col("id").isNotNull() & F.col("w").isNotNull() & (F.size("w") > 0) & fit)
    return rows.select("id", F.transform("w", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.size("w").alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def choose_pivots(rows: DataFrame, sample: int, pivots: int) -> dict[int, np.ndarray]:
    """For each dimension, pivots taken farthest-first from a sample of at most `sample` rows, those with the smallest id hashes."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    out: dict[int, np.ndarray] = {}
    for dim in sorted({r.dim for r in some}):
        m = np.array([r.v for r in some if r.dim == dim], np.float64)
        chosen, far = [0], np.full(len(m), np.inf)
        while len(chosen) < min(pivots, len(m)):
            far = np.minimum(far, ((m - m[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        out[dim] = m[chosen]
    return out


def _cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell: the number of the nearest pivot of the row's dimension (0 if it has none)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in pivots:
                    m = _matrix(batch.column(1).take(pa.array(at)), dim).astype(np.float64)
                    cell[at] = ((pivots[dim] ** 2).sum(axis=1)[None, :] - 2 * m @ pivots[dim].T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(each, "id long, v array<bigint>, dim int, cell int")


def _summary(table: pa.Table) -> pa.Table:
    dim, m = table.column("dim")[0].as_py(), None
    m = _matrix(table.column("v"), dim).astype(np.float64)
    centre = m.mean(axis=0)
    radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))
    return pa.table({"dim": table.column("dim")[:1], "cell": table.column("cell")[:1], "block": table.column("block")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})


def _searcher(k: int):
    def each(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            x_ids, x = data.column("id").to_numpy(), _matrix(data.column("v"), dim)
            q_ids, first = np.unique(queries.column("q_id").to_numpy(), return_index=True)
            floor = queries.column("floor").to_numpy()[first]
            out = search(q_ids, _matrix(queries.column("q_v"), dim)[first], x_ids, x, k, floor)
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    return each


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, most_pivots: int = 1024, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with other rows, ties to smaller ids.

    is_query is a condition on the column `id`.  Only vectors of a query's own length are its candidates.  Rows that repeat an id are
    candidates each, but never of a query with that id; as queries they count once (one of them, where vectors differ).  Other columns
    are not read.  A pivot for each block_rows rows, `most_pivots` at most, is taken from a sample of 16 rows a pivot, which only
    places rows: results are exact.
    """
    many = integers(vectors, id_col, vector_col, scale).count()
    pivots = int(min(most_pivots, max(2, -(-many // block_rows))))
    sample = 16 * max(16, pivots)
    rows = cut(_cells(integers(vectors, id_col, vector_col, scale), choose_pivots(integers(vectors, id_col, vector_col, scale), sample, pivots)))
    sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("many")).select(F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell"), "many")
    spread = F.greatest(F.lit(1), F.ceil(F.col("many") / block_rows))
    dealt = rows.join(sizes, (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell"))).select("id", "v", "dim", "cell", F.pmod(F.xxhash64("id"), spread).cast("int").alias("block"))
    data = cut(dealt.repartition("dim", "cell", "block"))
    blocks = data.groupBy("dim", "cell", "block").applyInArrow(_summary, "dim int, cell int, block int, centre array<double>, radius double")
    blocks = cut(blocks.select(F.col("dim").alias("b_dim"), F.col("cell").alias("b_cell"), F.col("block").alias("b_block"), "centre", "radius"))  # a row for block_rows vectors
    queries = data.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "v", "cell", F.col("block").alias("q_block"))).alias("q")).select("id", "q.*")
    groups = queries.groupBy("dim", "cell", "q_block").applyInArrow(_group_of, "dim int, cell int, q_block int, q_centre array<double>, q_radius double")
    # query groups against block summaries: rows for blocks, not for vectors
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    top = dot + norm("q_centre") * F.col("radius") + norm("centre") * F.col("q_radius") + F.col("radius") * F.col("q_radius")
    pairs = groups.join(blocks, F.col("dim") == F.col("b_dim")).select("dim", "cell", "q_block", "b_cell", "b_block", (top * F.when(top > 0, 1 + 1e-9).otherwise(1 - 1e-9) + 1e-6).alias("top"))
    own = (F.col("cell") == F.col("b_cell")) & (F.col("q_block") == F.col("b_block"))
    pairs = cut(pairs.withColumn("first", own))

    def visit(sent: DataFrame) -> DataFrame:
        return data.groupBy("dim", "cell", "block").cogroup(sent.groupBy("q_dim", "b_cell", "b_block")).applyInArrow(_searcher(k), FOUND)

    route = pairs.select(F.col("dim").alias("r_dim"), F.col("cell").alias("r_cell"), F.col("q_block").alias("r_block"), "b_cell", "b_block", "top", "first")
    lowest = -(1 << 62)
    sent = queries.join(route, (F.col("dim") == F.col("r_dim")) & (F.col("cell") == F.col("r_cell")) & (F.col("q_block") == F.col("r_block"))).select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("dim").alias("q_dim"), "b_cell", "b_block", "top", "first")
    first = cut(visit(sent.where("first").withColumn("floor", F.lit(lowest).cast("long"))))
    floors = first.groupBy(F.col("query_id").alias("f_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    later = sent.where("not first").join(floors, F.col("q_id") == F.col("f_id"), "left").where(F.col("kth").isNull() | (F.col("top") >= F.col("kth")))
    rest = visit(later.select("q_id", "q_v", "q_dim", "b_cell", "b_block", F.coalesce("kth", F.lit(lowest).cast("long")).alias("floor")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")




def _group_of(table: pa.Table) -> pa.Table:
    got = _summary(table.rename_columns(["block" if c == "q_block" else c for c in table.column_names]))
    return got.rename_columns(["dim", "cell", "q_block", "q_centre", "q_radius"])
