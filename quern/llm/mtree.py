"""Exact top-k search by largest integer inner product, with M-trees searched best first.

Components become floor(256 * x). Largest inner product is made a metric search: with M the largest norm of all,
a vector x gets one more coordinate sqrt(M^2 - |x|^2) and a query a zero there; then |q - x|^2 is
|q|^2 + M^2 - 2 q.x, so the nearest vector is the one of the highest score.

Rows are dealt to the nearest of at most ``PIVOTS`` routing vectors (a bounded sample, by hash of the id), and the
rows of a routing vector are dealt to trees of about ``TREE`` rows. A tree is one row of the index, a table that is
written once: pages of ``PAGE`` entries under two levels of nodes, each node with its routing vector, its covering
radius and its distance to its parent, each entry with its distance to its page's vector. A query first visits one tree of its nearest
routing vector. What it finds there bounds the rest: only routing vectors whose covering ball can hold a better
vector get it, and in a tree it takes the node of the least lower bound next until that is beyond its bound.
Lower bounds come from |d(q, parent) - d(node, parent)| - radius before a distance is computed, and from
|d(q, page) - d(entry, page)| for entries. Bounds only prune with a margin for rounding; scores are exact integers, by
doubles where no norm's square reaches 2^53, and by longs beyond.

Queries meet trees in blocks: about ``QUERIES`` of the queries that a tree gets, and the tree, in a task at once. The work is queries times
trees that no bound excludes, which for vectors without structure is all of them; the result is k rows a query.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query or as
candidate; missing trailing components count as zero; ties go to the smaller id; a row is not its own candidate, but
another row of the same id is; a null id takes no part; scores must fit a long, and components 2^31. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import cut, read_table

SCALE, TOP, EVERY = 256, 5, 50
PIVOTS, TREE, PAGE, FAN, QUERIES = 1024, 2048, 64, 8, 1024


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, v array<long>): the rows that take part. ``row`` tells apart rows of one id."""
    known = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    known = known.where(F.coalesce(finite, F.lit(False)))
    return known.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the norm sqrt(most)."""
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def dealt(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Routing vectors among the rows of x for groups of about ``size``, and the group of each row."""
    n = max(1, -(-len(x) // size))
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:  # each next the farthest from those chosen
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen), distances(x, x[chosen]).argmin(1)


class Tree:
    """One M-tree: nodes of inner pages, each over pages of entries."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, v: np.ndarray, most: float):
        x = lifted(v, most)
        self.nodes, self.pages = [], []
        tops, of_top = dealt(x, PAGE * FAN)
        self.top = x[tops]
        for k, top in enumerate(tops):
            own = np.flatnonzero(of_top == k)
            to_top = distances(x[own], x[top : top + 1])[:, 0]
            inner, of_inner = dealt(x[own], PAGE)
            route = x[own][inner]
            children = []
            for j in range(len(inner)):
                member = own[of_inner == j]
                to_page = distances(x[member], route[j : j + 1])[:, 0]
                children.append(len(self.pages))
                self.pages.append((row[member], vec_id[member], v[member], to_page, float(to_page.max(initial=0))))
            radii = np.array([self.pages[c][4] for c in children])
            self.nodes.append((route, to_top[inner], radii, children, float(to_top.max(initial=0))))
        self.radii = np.array([n[4] for n in self.nodes])

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self.__dict__, protocol=5))

    @staticmethod
    def unpack(blob: bytes, exact: bool) -> Tree:
        """exact: doubles hold all scores."""
        out = Tree.__new__(Tree)
        out.__dict__ = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        kind = np.float64 if exact else np.int64
        out.pages = [(r, i, v.astype(kind), t, far) for r, i, v, t, far in out.pages]
        return out

    def search(self, query: np.ndarray, own_row: int, best: list[tuple[int, int, int]], k: int, most: float) -> None:
        """Adds to ``best`` (score, -vec_id, row), a heap of the k best so far. query: of the pages' type."""
        q = np.append(query.astype(np.float64), 0.0)
        whole = float(q @ q) + most
        slack = 1e-6 * (1.0 + whole) ** 0.5

        def reach() -> float:
            return max(0.0, whole - 2.0 * best[0][0]) ** 0.5 + slack if len(best) >= k else float("inf")

        to_top = distances(q[None], self.top)[0]
        queue = [(max(0.0, d - r), 0, i, d) for i, (d, r) in enumerate(zip(to_top.tolist(), self.radii.tolist(), strict=True))]
        heapq.heapify(queue)
        while queue:
            bound, kind, i, d = heapq.heappop(queue)
            far = reach()
            if bound > far:
                return
            if kind == 0:
                route, to_parent, radii, children, _ = self.nodes[i]
                close = np.flatnonzero(np.abs(d - to_parent) - radii <= far)
                if len(close):
                    own = distances(q[None], route[close])[0]
                    for c, x, r in zip(close.tolist(), own.tolist(), radii[close].tolist(), strict=True):
                        if x - r <= far:
                            heapq.heappush(queue, (max(0.0, x - r), 1, children[c], x))
                continue
            rows, ids, v, to_page, _ = self.pages[i]
            close = np.flatnonzero(np.abs(d - to_page) <= far)
            score = v[close] @ query
            if len(best) >= k:
                keep = score >= best[0][0]
                close, score = close[keep], score[keep]
            for s, vec, r in sorted(zip(score.tolist(), (-ids[close]).tolist(), rows[close].tolist(), strict=True), reverse=True)[: k + 1]:
                if r == own_row:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (int(s), vec, r))
                elif (int(s), vec, r) > best[0]:
                    heapq.heapreplace(best, (int(s), vec, r))
                else:
                    break


FOUND = "q_row long, query_id long, v array<long>, home int, rows array<long>, ids array<long>, scores array<long>"


def index(placed: DataFrame, width: int, most: float) -> DataFrame:
    """(tree, blob) of rows (tree, row, vec_id, x)."""

    def build(table: pa.Table) -> pa.Table:
        v = matrix(table.column("x").combine_chunks(), width)
        for kind in (np.int16, np.int32):
            if not v.size or (np.iinfo(kind).min <= v.min() and v.max() <= np.iinfo(kind).max):
                v = v.astype(kind)
                break
        made = Tree(table.column("row").to_numpy(), table.column("vec_id").to_numpy(), v, most)
        return pa.table({"tree": table.column("tree").slice(0, 1), "blob": pa.array([made.pack()], pa.binary())})

    return placed.groupBy("tree").applyInArrow(build, "tree int, blob binary")


def visits(trees: DataFrame, queries: DataFrame, width: int, most: float, k: int) -> DataFrame:
    """The k best of each query in the tree that it is sent to. queries: tree, part, q_row, query_id, v, home, scores."""
    exact = most < 1 << 53

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("rows", "ids", "scores")}
        q = matrix(right.column("v").combine_chunks(), width) if right.num_rows else np.zeros((0, width))
        q = q.astype(np.float64) if exact else q
        made = Tree.unpack(left.column("blob")[0].as_py(), exact) if left.num_rows and right.num_rows else None
        floor = right.column("scores").to_pylist()
        for i, own in enumerate(right.column("q_row").to_pylist()):
            # what the query has found elsewhere bounds this visit; those places hold no row of this tree
            best = [(s, -(1 << 62), -1) for s in floor[i]] if len(floor[i]) >= k else []
            heapq.heapify(best)
            if made:
                made.search(q[i], own, best, k, most)
            kept = sorted((b for b in best if b[2] >= 0), reverse=True)
            out["rows"].append([b[2] for b in kept])
            out["ids"].append([-b[1] for b in kept])
            out["scores"].append([b[0] for b in kept])
        lists = pa.list_(pa.int64())
        return pa.table({"q_row": right.column("q_row"), "query_id": right.column("query_id"), "v": right.column("v"), "home": right.column("home"), **{n: pa.array(x, lists) for n, x in out.items()}})

    parts = queries.select(F.col("tree").alias("at"), F.col("part").alias("block")).distinct()
    placed = trees.join(parts, F.col("tree") == F.col("at")).groupBy("at", "block")
    return placed.cogroup(queries.groupBy("tree", "part")).applyInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score). ``vectors``: as from ``whole_vectors``, written (``cut``); queries: some of its rows."""
    stored = vectors
    n, most, width = stored.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))), F.max(F.size("v"))).first()
    most, width = float(most or 0.0), int(width or 0)
    sample = stored.orderBy(F.xxhash64("row"), "row").limit(max(1, min(PIVOTS, int(n) // (TREE // 2)))).select("v").collect()
    pivots = sorted({tuple(r["v"]) + (0,) * (width - len(r["v"])) for r in sample})
    route = lifted(np.array(pivots, np.int64).reshape(len(pivots), width), most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), width)
            far = distances(lifted(v, most), route)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], names=[*batch.schema.names, "pivot", "far"])

    near = cut(stored.select("row", "vec_id", "v").mapInArrow(assign, "row long, vec_id long, v array<long>, pivot int, far double"))
    balls = {r["pivot"]: (r["n"], r["radius"]) for r in near.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    first, total = {}, 0
    for p, (count, _) in sorted(balls.items()):
        first[p] = total
        total += -(-count // TREE)
    radius = np.array([balls[p][1] if p in balls else -np.inf for p in range(len(pivots))])
    start = F.create_map([F.lit(x) for p in first for x in (p, first[p])]) if first else F.create_map().cast("map<int,int>")
    several = F.create_map([F.lit(x) for p in balls for x in (p, -(-balls[p][0] // TREE))]) if balls else F.create_map().cast("map<int,int>")
    place = start[F.col("pivot")] + F.pmod(F.xxhash64("row"), several[F.col("pivot")]).cast("int")
    trees = cut(index(near.select(place.alias("tree"), F.col("row").alias("row"), F.col("vec_id").alias("vec_id"), F.col("v").alias("x")), width, most))
    asked = near.join(queries.select(F.col("row").alias("asked")), F.col("row") == F.col("asked"), "left_semi")
    part = lambda most_parts: F.pmod(F.xxhash64("q_row", F.lit(7)), most_parts).cast("int")
    at_home = asked.groupBy(place.alias("home_tree")).agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    none = F.array().cast("array<long>")
    homes = asked.select(place.alias("tree"), F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("v"), place.alias("home"), none.alias("scores"))
    homes = homes.join(at_home, F.col("tree") == F.col("home_tree")).withColumn("part", part(F.col("parts"))).drop("home_tree", "parts")
    begun = cut(visits(trees, homes, width, most, k))
    first_tree = np.array([first.get(p, -1) for p in range(len(pivots))])
    n_trees = np.array([-(-balls[p][0] // TREE) if p in balls else 0 for p in range(len(pivots))])

    def bounded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(query, routing vector) whose covering ball can hold a better vector."""
        v = matrix(batch.column(2), width).astype(np.float64)
        scores = batch.column(6).to_pylist()
        whole = (v * v).sum(1) + most
        worst = np.array([s[-1] if len(s) >= k else -np.inf for s in scores])
        far = np.sqrt(np.maximum(0.0, whole - 2 * worst)) + 1e-6 * np.sqrt(1.0 + whole)
        bound = distances(np.hstack([v, np.zeros((len(v), 1))]), route) - radius[None]
        return np.nonzero(bound <= far[:, None])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(pivots), np.int64)
        for batch in batches:
            many += np.bincount(bounded(batch)[1], minlength=len(pivots))
        yield pa.RecordBatch.from_pydict({"pivot": pa.array(np.arange(len(pivots)), pa.int32()), "n": pa.array(many)})

    asked_of = {r["pivot"]: r["n"] for r in begun.mapInArrow(count, "pivot int, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect()}
    parts_of = np.array([max(1, -(-asked_of.get(p, 0) // QUERIES)) for p in range(len(pivots))], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes, (q, p) = batch.column(3).to_numpy(zero_copy_only=False), bounded(batch)
            parts = np.repeat(parts_of[p], n_trees[p])
            q, tree = np.repeat(q, n_trees[p]), np.repeat(first_tree[p] - np.cumsum(n_trees[p]) + n_trees[p], n_trees[p]) + np.arange(n_trees[p].sum())
            other = tree != homes[q]
            q, tree, parts = pa.array(q[other]), tree[other], parts[other]
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), *(batch.column(c).take(q) for c in (0, 1, 2, 3, 6)), pa.array(parts)], names=["tree", "q_row", "query_id", "v", "home", "scores", "parts"])

    rest = begun.mapInArrow(spread, "tree int, q_row long, query_id long, v array<long>, home int, scores array<long>, parts long").withColumn("part", part(F.col("parts"))).drop("parts")
    more = visits(trees, rest, width, most, k)
    every = begun.select("q_row", "query_id", "ids", "scores").unionByName(more.select("q_row", "query_id", "ids", "scores").where(F.size("ids") > 0))
    hits = every.select("q_row", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("q_row", "query_id", F.struct((-F.col("x.scores")).alias("s"), F.col("x.ids").alias("vec_id")).alias("x"))
    best = hits.groupBy("q_row", "query_id").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k).alias("x"))
    return best.select("query_id", F.posexplode("x").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(whole_vectors(read_table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
