"""Most similar vectors for every vector (problem 5).

A vantage-point tree splits vectors by their angle to a vantage point at the median.  The
upper levels, fitted on a bounded sample, deal all vectors to cells; each cell, or each
part of a cell that is too large, is a shard with a tree of its own.  A query goes down a
side only if the triangle inequality lets a vector within the search radius lie there:
``|angle to the vantage point - median| * factor`` against the radius.  Factor 1 is exact;
a larger factor prunes more and can lose neighbours at the borders.  The radius is that of
a least cosine, or without one the query's own: the ``k`` best of its own cell bound it.
Leaves are compared by one matrix product for all queries that reach them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from treemill.plans.session import cut

#: Numbers in the vectors on which the upper levels are fitted, at most (64 MB of floats): 262,144 vectors of 64, enough for 65,536 cells.
SAMPLE_NUMBERS = 1 << 24
#: Sampled vectors a cell, and keys that a hot vector's copies are spread over.
SAMPLE_A_CELL, SALTS = 4, 32
#: Vectors that a shard and a block of its queries hold, about.
SHARD_ROWS = 16_384
LEAF = 192
#: Pruning factor of the queries; 1 is exact.  README has the recall measured against brute force.
FACTOR = 5.0
#: Cosine whose margin is enough within a query's own cell, where any ``k`` vectors bound the radius.
HOME_FLOOR = 0.4


@dataclass
class Node:
    """A split: the vantage point, the median angle, and the two sides (a cell's number or rows at the leaves)."""

    vantage: np.ndarray | None = None
    middle: float = 0.0
    near: Node | None = None
    far: Node | None = None
    rows: np.ndarray | None = None
    cell: int = 0


def angles(vectors: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ vantage, -1.0, 1.0))


def build(vectors: np.ndarray, rows: np.ndarray, depth: int, leaf: int, rng: np.random.Generator) -> Node:
    """A tree over ``vectors[rows]``; of some vantage points the one whose angles spread most is taken."""
    if depth == 0 or len(rows) <= leaf:
        return Node(rows=rows)
    probe = rng.choice(rows, min(len(rows), 128), replace=False)
    tried = rng.choice(rows, min(len(rows), 8), replace=False)
    spread = [angles(vectors[probe], vectors[t]).std() for t in tried]
    vantage = vectors[tried[int(np.argmax(spread))]]
    turn = angles(vectors[rows], vantage)
    middle = float(np.median(turn))
    inside = turn <= middle
    if inside.all():
        return Node(rows=rows)
    near = build(vectors, rows[inside], depth - 1, leaf, rng)
    return Node(vantage, middle, near, build(vectors, rows[~inside], depth - 1, leaf, rng))


def number_cells(node: Node, start: int = 0) -> int:
    """Numbers the leaves from ``start``; the next free number."""
    if node.vantage is None:
        node.cell = start
        return start + 1
    return number_cells(node.far, number_cells(node.near, start))


def visits(node: Node, queries: np.ndarray, which: np.ndarray, margins: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves and the queries that may have a neighbour there, by each query's margin; margin 0 gives each vector its own leaf only."""
    if not len(which):
        return
    if node.vantage is None:
        yield node, which
        return
    turn, margin = angles(queries[which], node.vantage), margins[which]
    yield from visits(node.near, queries, which[turn - margin <= node.middle], margins)
    yield from visits(node.far, queries, which[turn + margin > node.middle], margins)


def margins_of(floors: np.ndarray, factor: float) -> np.ndarray:
    """How far to look beyond a split for cosines of the floors or more."""
    return np.arccos(np.clip(floors, -1.0, 1.0)) / factor


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray, margins: np.ndarray, leaf: int = LEAF) -> pd.DataFrame:
    """The ``k`` most similar other vectors of each query with a cosine of its floor or more, from one shard."""
    rng = np.random.default_rng(len(ids))
    tree = build(vectors, np.arange(len(ids)), 64, leaf, rng)
    q_all, x_all, c_all = [], [], []
    for node, which in visits(tree, queries, np.arange(len(query_ids)), margins):
        for at in range(0, len(which), 4096):
            part = which[at : at + 4096]
            for low in range(0, len(node.rows), 4096):
                rows = node.rows[low : low + 4096]
                close = queries[part] @ vectors[rows].T
                q, x = np.nonzero(close >= floors[part][:, None] - 1e-5)
                q, x = part[q], rows[x]
                keep = query_ids[q] != ids[x]
                q, x = q[keep], x[keep]
                cosine = np.einsum("ij,ij->i", queries[q].astype(np.float64), vectors[x].astype(np.float64))
                q, x, cosine = _best(q, x, cosine, ids, k, floors)
                q_all.append(q)
                x_all.append(x)
                c_all.append(cosine)
    if not q_all:
        return pd.DataFrame({"query": query_ids[:0], "other": ids[:0], "cosine": np.empty(0)})
    q, x, cosine = _best(np.concatenate(q_all), np.concatenate(x_all), np.concatenate(c_all), ids, k, floors)
    return pd.DataFrame({"query": query_ids[q], "other": ids[x], "cosine": cosine})


def _best(q: np.ndarray, x: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = cosine >= floors[q]
    q, x, cosine = q[keep], x[keep], cosine[keep]
    order = np.lexsort((ids[x], -cosine, q))
    q, x, cosine = q[order], x[order], cosine[order]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < k
    return q[top], x[top], cosine[top]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: rows with a direction.  Null and empty vectors, those with a null number and all-zero ones are left out."""
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<float>").alias("v"))
    return rows.filter("id is not null and v is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x))")


def first_copies(rows: DataFrame, n: int) -> DataFrame:
    """``id, v, h``: of equal vectors the ``n`` smallest ids.  Spark limits the copies before it shuffles, so a hot vector never meets in one task."""
    hashed = rows.withColumn("h", F.xxhash64("v"))
    return hashed.withColumn("copy", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).filter(F.col("copy") <= n).drop("copy")


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """``id, dim, vec``: directions as packed floats.

    Of equal vectors the ``k + 1`` smallest ids stay: with ties going to smaller ids, no
    other copy is among the ``k`` most similar of any row.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = first_copies(usable(df, id_col, vector_col), k + 1).select("id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, v in zip(batch["id"], batch["v"]):
                v = np.asarray(v, dtype=np.float64)
                size = np.linalg.norm(v)
                if np.isfinite(size) and size > 0:
                    out.append((key, len(v), (v / size).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["id", "dim", "vec"])

    return rows.mapInPandas(run, f"id {kind}, dim int, vec binary")


def _matrix(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(-1, dim)


class Cells:
    """The upper levels of the tree, fitted on a sample of ``units``, and the search of queries in the cells they reach."""

    def __init__(self, units: DataFrame, kind: str, k: int, factor: float):
        self.units, self.kind, self.k, self.factor = units, kind, k, factor
        self.spark = units.sparkSession
        total, numbers = units.agg(F.count("*"), F.max("dim")).first()
        self.target = max(1024, min(SHARD_ROWS, total // (2 * self.spark.sparkContext.defaultParallelism)))
        cells = 1 << max(0, math.ceil(math.log2(max(1, total) / self.target)))
        size = min(max(SHARD_ROWS, SAMPLE_A_CELL * cells), SAMPLE_NUMBERS // max(1, numbers or 1))
        share = min(1.0, 1.5 * size / max(1, total))  # a smaller table to take the first hashes from
        near = units.filter(F.abs(F.xxhash64("id") % 1_000_003) < share * 1_000_003) if share < 0.5 else units
        sample = near.orderBy(F.xxhash64("id"), "id").limit(size).toPandas()
        routers: dict[int, Node] = {}
        for dim, own in sample.groupby("dim"):
            depth = max(0, math.ceil(math.log2(max(1, total * len(own) / len(sample)) / self.target)))
            routers[int(dim)] = build(_matrix(own["vec"], int(dim)), np.arange(len(own)), depth, SAMPLE_A_CELL, np.random.default_rng(int(dim)))
            number_cells(routers[int(dim)])
        self.shared = self.spark.sparkContext.broadcast(routers)  # a vantage point a cell

    def best(self, queries: DataFrame, home: bool = False) -> DataFrame:
        """``query, other, cosine``: the ``k`` best of each query with a cosine of its ``floor`` or more.

        ``queries`` has ``id, dim, vec, floor``.  ``home`` looks into each query's own cell
        only.  Cells and queries meet in parts of bounded size.
        """
        shared, factor, k, kind, target = self.shared, self.factor, self.k, self.kind, self.target

        def route(batch: pd.DataFrame, asking: bool) -> Iterator[tuple[int, int, np.ndarray]]:
            """Dimension, cell, and the rows there: those at home, or with ``asking`` the queries that reach it."""
            for dim, own in batch.groupby("dim"):
                tree = shared.value.get(int(dim), Node(rows=np.empty(0)))
                vectors, at = _matrix(own["vec"], int(dim)), own.index.to_numpy()
                margins = margins_of(own["floor"].to_numpy(), factor) if asking and not home else np.zeros(len(at))
                for node, which in visits(tree, vectors, np.arange(len(at)), margins):
                    yield int(dim), node.cell, at[which]

        def counts(asking: bool):
            def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                sums: dict[tuple[int, int], int] = {}
                for batch in batches:
                    for dim, cell, rows in route(batch.reset_index(drop=True), asking):
                        sums[dim, cell] = sums.get((dim, cell), 0) + len(rows)
                yield pd.DataFrame([(*key, asking, n) for key, n in sums.items()], columns=["dim", "cell", "asking", "n"])

            return count

        schema = "dim int, cell int, asking boolean, n long"
        held = self.units.select("id", "dim", "vec")
        counted = held.mapInPandas(counts(False), schema).unionByName(queries.select("id", "dim", "vec", "floor").mapInPandas(counts(True), schema))
        sizes: dict[tuple[int, int], list[int]] = {}
        for r in counted.groupBy("dim", "cell", "asking").agg(F.sum("n").alias("n")).collect():  # two rows a cell
            sizes.setdefault((r.dim, r.cell), [0, 0])[r.asking] = r.n
        layout = self.spark.sparkContext.broadcast({at: (max(1, -(-n // (2 * target))), max(1, -(-asks // (8 * target)))) for at, (n, asks) in sizes.items() if n and asks})

        def deals(asking: bool):
            def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    batch = batch.reset_index(drop=True)
                    salt = pd.util.hash_array(batch["id"].to_numpy()).astype(np.uint64)
                    pieces = []
                    for dim, cell, rows in route(batch, asking):
                        if (dim, cell) not in layout.value:  # nobody asks there, or nothing is there
                            continue
                        shards, blocks = layout.value[dim, cell]
                        own, other = (blocks, shards) if asking else (shards, blocks)
                        mine = (salt[rows] % np.uint64(own)).astype(np.int32)
                        for n in range(other):
                            piece = batch.loc[rows, ["id", "dim", "vec"]]
                            floor = batch.loc[rows, "floor"] if asking else 0.0
                            pieces.append(piece.assign(cell=np.int32(cell), shard=np.int32(n) if asking else mine, block=mine if asking else np.int32(n), is_query=asking, floor=floor))
                    if pieces:
                        yield pd.concat(pieces)[["id", "dim", "vec", "cell", "shard", "block", "is_query", "floor"]]

            return deal

        def one(own: pd.DataFrame) -> pd.DataFrame:
            dim = int(own["dim"].iloc[0])
            asks = own["is_query"].to_numpy()
            here, asking = own[~asks], own[asks]
            if here.empty or asking.empty:
                return pd.DataFrame({"query": own["id"][:0], "other": own["id"][:0], "cosine": np.empty(0)})
            floors = asking["floor"].to_numpy(dtype=float)
            margins = margins_of(np.maximum(floors, HOME_FLOOR) if home else floors, factor)
            return search(_matrix(here["vec"], dim), here["id"].to_numpy(), _matrix(asking["vec"], dim), asking["id"].to_numpy(), k, floors, margins)

        schema = f"id {kind}, dim int, vec binary, cell int, shard int, block int, is_query boolean, floor double"
        dealt = held.mapInPandas(deals(False), schema).unionByName(queries.select("id", "dim", "vec", "floor").mapInPandas(deals(True), schema))
        found = dealt.groupBy("dim", "cell", "shard", "block").applyInPandas(one, f"query {kind}, other {kind}, cosine double")
        return best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of each query; ties go to the smaller id."""
    order = W.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query", "other", "cosine")


def nearest(
    df: DataFrame, id_col: str, vector_col: str, k: int = 10, least: float | None = 0.9, factor: float = FACTOR, asking: str | None = None, all_copies: bool = True
) -> DataFrame:
    """``query, other, cosine``: of every row the ``k`` most similar other rows by direction.

    Only cosines of at least ``least`` count; with ``least`` None all do, and every row has
    ``k`` others where there are as many of its length.  Ties go to the smaller id.
    ``asking``, SQL over ``id``, limits the rows that ask, never those that are searched.
    Copies of a vector beyond the first ``k + 1`` get the first ``k`` of them as their
    list, unless ``all_copies`` is off: no row has them in its own list, so a mutual
    search does not need them.  Vectors of different length are not similar.  An empty
    table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    units = cut(unit_vectors(df, id_col, vector_col, k))
    cells = Cells(units, kind, k, factor)
    queries = units.filter(F.expr(asking) if asking else F.lit(True)).withColumn("floor", F.lit(-2.0 if least is None else float(least)))
    if least is None:
        # k others of the own cell bound the radius; without as many there is no bound
        at_home = cut(cells.best(queries, home=True))
        worst = at_home.groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
        bound = worst.filter(F.col("n") == k).select(F.col("query").alias("id"), (F.col("worst") - 1e-6).alias("bound"))
        queries = cut(queries.join(bound, "id", "left").withColumn("floor", F.coalesce("bound", "floor")).drop("bound"))
        near = best_of(cells.best(queries).unionByName(at_home).dropDuplicates(["query", "other"]), k)
    else:
        near = cells.best(queries)
    if not all_copies or least is not None and least > 1:
        return near
    rows = usable(df, id_col, vector_col)
    tops = first_copies(rows, k + 2).groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") == k + 2)
    salted = tops.select("h", "v", F.slice("ids", 1, k).alias("others"), F.slice("ids", 1, k + 1).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = rows.filter(F.expr(asking) if asking else F.lit(True)).select(F.col("id").alias("query"), F.col("v"), F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = rest.join(salted, ["h", "salt", "v"]).filter(~F.array_contains("first", F.col("query")))
    return near.unionByName(copies.select("query", F.explode("others").alias("other"), F.lit(1.0).alias("cosine")))


def mutual(near: DataFrame) -> DataFrame:
    """``id_a, id_b``, smaller first: pairs that are in each other's lists."""
    ends = near.select(F.least("query", "other").alias("id_a"), F.greatest("query", "other").alias("id_b"), (F.col("query") < F.col("other")).alias("up"))
    both = ends.groupBy("id_a", "id_b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    return both.filter("up and down").select("id_a", "id_b")
