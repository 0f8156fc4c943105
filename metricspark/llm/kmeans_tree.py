"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row goes down to its leaf. A query goes
down to its nearest leaf and keeps the branches that it passed in a priority queue; the best
of them is next. How many leaves are visited is calibrated: for a sample of queries the
true neighbours are found by brute force, and visits are widened until the target share of
them lies in leaves visited. Leaves meet their queries in blocks of bounded size, first
those at the head of each queue, whose scores then keep most of the others' rows out.

Equal vectors are told from one another by id alone: of each the first few ids stay, and
of equal queries one is searched for, so that copies cost no more than their rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.llm.common import by_group, cut, discard, join_hot, sampled
from metricspark.llm.neighbours import by_length, margin, matrix, usable


@dataclass(frozen=True)
class Search:
    """neighbours: of a query; branch: of a node at most; leaf: rows of a leaf aimed at; sample, sample_bytes: of the fit at
    most, about; least: sampled rows of a leaf; rounds: of k-means; audited: queries of the calibration; recall: its target;
    rows, queries: of a block; first: share of the visits that come first."""

    neighbours: int = 5
    branch: int = 16
    leaf: int = 256
    sample: int = 65_536
    sample_bytes: int = 1 << 26
    least: int = 16
    rounds: int = 8
    audited: int = 256
    recall: float = 0.97
    rows: int = 8192
    queries: int = 4096
    first: float = 0.1


@dataclass
class Tree:
    """Nodes by number, the root first: centroids, children and, of a node without any, its leaf."""

    centroids: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of unit vectors, by greedy descent."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centroids[kids].T).argmax(axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, products: list[float], most: int, sizes: list[int], need: int) -> list[int]:
        """Leaves in the order of best-bin-first traversal: ``most`` of them, and more until they hold ``need`` rows."""
        queue, out, rows = [(-2.0, 0)], [], 0
        while queue and (len(out) < most or rows < need):
            node = heapq.heappop(queue)[1]
            while kids := self.children[node]:
                node = max(kids, key=products.__getitem__)
                for kid in kids:
                    if kid != node:
                        heapq.heappush(queue, (-products[kid], kid))
            out.append(self.leaf[node])
            rows += sizes[self.leaf[node]]
        return out


def k_means(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, the nearest of each row) of unit vectors."""
    centers = x[np.sort(random.choice(len(x), k, replace=False))]
    near = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        member = np.zeros((k, len(x)), dtype=np.float32)
        member[near, np.arange(len(x))] = 1
        total = member @ x
        length = np.linalg.norm(total, axis=1)
        some = length > 1e-6
        centers = centers.copy()
        centers[some] = total[some] / length[some, None]
    return centers, (x @ centers.T).argmax(axis=1)


def grow(x: np.ndarray, leaf: float, p: Search) -> Tree:
    """A tree over unit vectors whose leaves hold about ``leaf`` of them."""
    random = np.random.default_rng(12)
    centroids, children, leaves = [np.zeros(x.shape[1], dtype=np.float32)], [[]], [-1]
    todo, n = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        k = min(p.branch, len(rows), round(len(rows) / leaf))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if k > 1:
            centers, near = k_means(x[rows], k, p.rounds, random)
            parts = [(centers[i], rows[near == i]) for i in range(k) if (near == i).any()]
        if len(parts) < 2:
            leaves[node], n = n, n + 1
            continue
        for center, own in parts:
            children[node].append(len(children))
            todo.append((len(children), own))
            centroids.append(center)
            children.append([])
            leaves.append(-1)
    return Tree(np.array(centroids, dtype=np.float32), children, leaves)


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in single precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, in double precision; powers of two, which change no digit, keep them in range."""

    def scaled(v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])

    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def doubles(column, number) -> np.ndarray:
    return matrix(column, number).astype(np.float64)


def leaves_of(points: DataFrame, trees: dict[int, Tree], number) -> DataFrame:
    """(id, v, size, leaf) of all rows. Vectors of a length that no tree was fitted for share one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in by_length(batch.column("v")):
                part = batch.take(pa.array(places))
                v = doubles(part.column("v"), number)
                tree = trees.get(v.shape[1])
                leaf = np.zeros(len(v), dtype=np.int64) if tree is None else tree.assign(units(v))
                size = pa.array(np.full(len(v), v.shape[1], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), size, pa.array(leaf)], names=["id", "v", "size", "leaf"])

    return points.mapInArrow(run, "id long, v binary, size long, leaf long")


def visited(queries: DataFrame, trees: dict[int, Tree], sizes: dict[int, list[int]], visits: dict[int, int], number, k: int) -> DataFrame:
    """(q, size, leaf, turn): the leaves that each query visits, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in by_length(batch.column("v")):
                part = batch.take(pa.array(places))
                q, v = part.column("q").to_numpy(), doubles(part.column("v"), number)
                tree = trees.get(v.shape[1])
                for at in range(0, len(v), 256):
                    some = slice(at, at + 256)
                    if tree is None:
                        own = [[0]] * len(q[some])
                    else:
                        products = (units(v[some]) @ tree.centroids.T).tolist()
                        own = [tree.visits(x, visits[v.shape[1]], sizes[v.shape[1]], k + 1) for x in products]
                    count = [len(x) for x in own]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(q[some], count)), pa.array(np.full(sum(count), v.shape[1], dtype=np.int64)),
                            pa.array(np.array([x for o in own for x in o], dtype=np.int64)), pa.array(np.concatenate([np.arange(c) for c in count])),
                        ],
                        names=["q", "size", "leaf", "turn"],
                    )

    return queries.select("q", "v").mapInArrow(run, "q long, size long, leaf long, turn long")


FOUND = "q long, other long, score double"


def nearest(q: np.ndarray, qv: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch | None:
    """The k rows nearest to each query with a score of ``floor`` or more; single precision chooses, doubles decide."""
    light, slack = units(v), 2 * margin(v.shape[1])
    out = []
    for at in range(0, len(q), 512):
        some = slice(at, at + 512)
        s = units(qv[some]) @ light.T
        least = floor[some].astype(np.float32)
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
        i, j = np.nonzero(s >= (least - np.float32(slack))[:, None])
        score = np.concatenate([cosines(qv[some][i[g : g + 65536]], v[j[g : g + 65536]]) for g in range(0, len(i), 65536)] or [np.zeros(0)])
        good = score >= floor[some][i]
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((q[some][i[keep]], ids[j[keep]], score[keep]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else []
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "other", "score"]) if columns and len(columns[0]) else None


def scanned(points: DataFrame, queries: DataFrame, visits: DataFrame, counts: DataFrame, p: Search, number) -> DataFrame:
    """What queries (q, v, floor) find in the leaves that they visit."""
    asked = visits.groupBy("size", "leaf").agg(F.ceil(F.count(F.lit(1)) / p.queries).alias("qblocks"))
    cells = cut(counts.join(asked, ["size", "leaf"]).select("size", "leaf", F.ceil(F.col("n") / p.rows).alias("rblocks"), "qblocks"))
    own = lambda c, n: F.pmod(F.xxhash64(F.lit(12), c), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = points.join(cells, ["size", "leaf"]).select(
        "size", "leaf", own("id", "rblocks").alias("rblock"), every("qblocks").alias("qblock"), F.lit(False).alias("asked"), "id", "v", F.lit(0.0).alias("floor")
    )
    right = visits.join(queries, "q").join(cells, ["size", "leaf"]).select(
        "size", "leaf", every("rblocks").alias("rblock"), own("q", "qblocks").alias("qblock"), F.lit(True).alias("asked"), F.col("q").alias("id"), "v", "floor"
    )

    def run(_, t: pa.Table) -> pa.RecordBatch | None:
        asked = t.column("asked").to_numpy()
        ids, v, floor = t.column("id").to_numpy(), doubles(t.column("v"), number), t.column("floor").to_numpy()
        if asked.all() or not asked.any():
            return None
        return nearest(ids[asked], v[asked], floor[asked], ids[~asked], v[~asked], p.neighbours + 1)

    return by_group(left.unionByName(right), ["size", "leaf", "rblock", "qblock"], run, FOUND)


def first_few(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def true_neighbours(points: DataFrame, queries: list, p: Search, number) -> DataFrame:
    """(q, other, score, leaf) by brute force over all rows, for at most ``audited`` queries; leaf is that of the neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in by_length(batch.column("v")):
                part = batch.take(pa.array(places))
                v, ids, leaf = doubles(part.column("v"), number), part.column("id").to_numpy(), part.column("leaf").to_numpy()
                mine = [x for x in queries if len(x["v"]) == len(part.column("v")[0].as_py())]
                if not mine:
                    continue
                q = np.array([x["q"] for x in mine])
                qv = np.stack([np.frombuffer(x["v"], dtype=number).astype(np.float64) for x in mine])
                found = nearest(q, qv, np.full(len(q), -2.0), np.arange(len(v)), v, p.neighbours + 1)
                at = found.column(1).to_numpy()
                columns = [found.column(0), pa.array(ids[at]), found.column(2), pa.array(leaf[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "other", "score", "leaf"])

    return first_few(points.mapInArrow(run, FOUND + ", leaf long"), p.neighbours + 1)


def calibrated(points: DataFrame, queries: DataFrame, trees: dict[int, Tree], p: Search, number) -> tuple[dict[int, int], float]:
    """(visits of each tree, the recall that they give): widened until the target share of the audited queries' true neighbours is in reach."""
    sample = queries.orderBy(F.xxhash64(F.lit(13), "q"), "q").limit(p.audited).select("q", "id", "v").collect()
    ids, true = {x["q"]: x["id"] for x in sample}, {x["q"]: [] for x in sample}
    for r in true_neighbours(points, sample, p, number).orderBy(F.col("score").desc(), "other").collect():  # audited times one more than neighbours
        if r["other"] != ids[r["q"]] and len(true[r["q"]]) < p.neighbours:
            true[r["q"]].append(r["leaf"])
    turns: dict[int, list[int]] = {size: [] for size in trees}
    for x in sample:
        v = np.frombuffer(x["v"], dtype=number).astype(np.float64)[None]
        if v.shape[1] in trees:
            tree = trees[v.shape[1]]
            order = tree.visits((units(v) @ tree.centroids.T)[0].tolist(), tree.leaves, [1] * tree.leaves, 0)
            place = {leaf: i for i, leaf in enumerate(order)}
            turns[v.shape[1]] += [place[leaf] for leaf in true[x["q"]]]
    visits, hit, total = {}, 0, 0
    for size, tree in trees.items():
        own = sorted(turns[size])
        # Without audited queries of this length all leaves are visited.
        visits[size] = own[max(0, math.ceil(p.recall * len(own)) - 1)] + 1 if own else tree.leaves
        hit, total = hit + sum(x < visits[size] for x in own), total + len(own)
    return visits, hit / total if total else 1.0


def search(df: DataFrame, is_query: Column, p: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, visits, calibrated_recall): the nearest rows found for each query, by cosine in double precision.

    Nearest first, ties to the smaller id; never a row of the query's own id. There are
    ``neighbours`` of them, fewer only where there are fewer candidates. The fit reads about
    ``sample`` rows at most, every row is indexed, and scores are exact. ``visits`` is the number
    of leaves visited at least, ``calibrated_recall`` the audited queries' share of true neighbours in them.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite
    components take no part. Vectors of different lengths have no cosine and never meet.
    Rows that repeat id and vector are one; an id with several vectors is a query and a
    candidate with each. An empty table gives no rows.
    """
    single = df.schema[vector_col].dataType.elementType.typeName() == "float"
    number, kind = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    source = df.select(
        df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{vector_col}`"].cast(kind).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    ).filter(usable(F.col("x")) & F.col("id").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x.values, dtype=number).tobytes() for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(v, pa.binary()), batch.column("is_query")], names=["id", "v", "is_query"])

    rows = cut(source.mapInArrow(pack, "id long, v binary, is_query boolean"))
    copy = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    points = rows.select("id", "v").withColumn("copy", copy).filter(F.col("copy") <= p.neighbours + 1)
    points = cut(points.groupBy("v", "id").agg(F.lit(0)).select("id", "v"))
    asked = rows.filter("is_query").select("id", "v").distinct()
    # A vector's number is a hash, as an id may have several vectors: among 10**8 of them two agree with a chance of 0.0003.
    queries = cut(asked.groupBy("v").agg(F.min("id").alias("id")).withColumn("q", F.xxhash64(F.lit(14), "v")))
    total = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("v")).alias("bytes")).first()
    share = min(1.0, p.sample / max(1, total["n"]), p.sample_bytes / max(1, total["bytes"] or 0))
    trees: dict[int, Tree] = {}
    held = [r["v"] for r in points.filter(sampled(F.col("id"), 15, share)).select("v").collect()]  # ``sample`` rows, about, at most
    for size in sorted({len(v) for v in held}):
        own = np.stack([np.frombuffer(v, dtype=number) for v in held if len(v) == size]).astype(np.float64)
        trees[own.shape[1]] = grow(units(own), max(p.leaf * share, p.least if share < 1 else 1), p)
    indexed = cut(leaves_of(points, trees, number))
    counts = cut(indexed.groupBy("size", "leaf").agg(F.count(F.lit(1)).alias("n")))
    sizes = {size: [0] * tree.leaves for size, tree in trees.items()}
    for r in counts.filter(F.col("size").isin(list(trees))).collect():  # one row for each leaf of the trees
        sizes[r["size"]][r["leaf"]] = r["n"]
    visits, recall = calibrated(indexed, queries, trees, p, number)
    every = cut(visited(queries, trees, sizes, visits, number, p.neighbours))
    most = max(1, math.ceil(p.first * max(visits.values(), default=1)))
    few = p.neighbours + 1
    begun = queries.select("q", "v", F.lit(-2.0).alias("floor"))
    near = cut(first_few(scanned(indexed, begun, every.filter(F.col("turn") < most), counts, p, number), few))
    floors = near.groupBy("q").agg(F.when(F.count(F.lit(1)) == few, F.min("score")).alias("floor"))
    going = queries.join(floors, "q", "left").select("q", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    more = scanned(indexed, going, every.filter(F.col("turn") >= most), counts, p, number)
    lists = first_few(near.unionByName(more), few).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), F.col("other")))).alias("near")
    )
    answers = cut(queries.join(lists, "q").select("v", "near"))
    discard(points, every)
    own = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, p.neighbours)
    out = join_hot(asked, answers, "v").select("id", F.posexplode(own).alias("pos", "x"))
    return out.select(
        F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.other").alias("vec_id"), (-F.col("x.d")).alias("score"),
        F.lit(max(visits.values(), default=0)).cast("long").alias("visits"), F.lit(float(recall)).alias("calibrated_recall"),
    )
