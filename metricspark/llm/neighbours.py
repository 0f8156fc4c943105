"""Near-duplicate embeddings by NN-descent.

Leaves of random-projection trees give every vector a first list of neighbours. Rounds of
neighbours-of-neighbours joins then refine the lists, as long as they find anything. Two
vectors that are linked and have a link in common lie within twice the threshold's angle
of it, so lists hold neighbours within that angle only: strangers are not passed on. The
joins are made on ids; single-precision vectors travel to where lists have news, and
doubles only to pairs about the threshold. A list that is full of links is too short to
show them all: it is enlarged to its whole component, compared in blocks. An audit against
brute force for a sample of vectors measures the recall of links; while it is below the
target, further trees and rounds follow, twice as many trees each time. Where they would
cost more than all pairs, or have been tried often enough, all pairs are compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.llm.common import blocks, by_group, components, cut, discard, join_hot, join_salted


@dataclass(frozen=True)
class Descent:
    """Parameters.

    neighbours: length of a list; trees: trees of the first attempt at least; reach: share
    of the pairs at the threshold that its trees bring together; leaf: vectors of a leaf on
    average; rounds: refinements of one attempt at most; news: share of new neighbours
    below which they end; audited, audited_any: vectors that the audit compares with all,
    of each kind and of those without a near neighbour; recall: its target; attempts: at
    most, before all pairs are compared; block: vectors of a block; hub: incoming
    neighbours that meet at once.
    """

    threshold: float = 0.9
    neighbours: int = 10
    trees: int = 4
    reach: float = 0.85
    leaf: int = 1024
    rounds: int = 4
    news: float = 0.001
    audited: int = 256
    audited_any: int = 2048
    recall: float = 0.97
    attempts: int = 3
    block: int = 1024
    hub: int = 64

    @property
    def floor(self) -> float:
        """Cosine of twice the threshold's angle."""
        return 2 * self.threshold**2 - 1 if self.threshold > 0 else -1.0

    def depth(self, n: int) -> int:
        """Planes of a tree over n vectors."""
        return max(0, math.ceil(math.log2(max(1, n / self.leaf))))

    def trees_of(self, n: int, attempt: int) -> int:
        """Trees of an attempt: a plane parts vectors with their angle over pi, so they follow the depth."""
        together = (1 - math.acos(self.threshold) / math.pi) ** self.depth(n)
        needed = math.log(1 - self.reach) / math.log1p(-together) if together < 1 else 1
        return max(self.trees, math.ceil(needed)) << attempt


def matrix(column, dtype=np.float32) -> np.ndarray:
    """Rows of numbers from a column of packed vectors of one length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1)


def margin(size: int) -> float:
    """What the single-precision product of two unit vectors is off at most, rounding of the vectors included."""
    return (size + 4) * 2.0**-23


def by_length(column) -> Iterator[np.ndarray]:
    """Places of the vectors of each length."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def best(node: np.ndarray, v: np.ndarray, k: int, low: float, floor=None, fresh=None) -> tuple[np.ndarray, ...]:
    """(u, v, cosine) of the k nearest others of every row, from ``low`` on and above the row's floor.

    Pairs of rows that are not ``fresh`` have met before and are left out.
    """
    s = v @ v.T
    np.fill_diagonal(s, -2)
    if fresh is not None:
        s[np.ix_(~fresh, ~fresh)] = -2
    rows = np.flatnonzero((s >= low).any(axis=1))
    k = min(k, len(node) - 1)
    if k <= 0 or not len(rows):
        return node[:0], node[:0], np.zeros(0)
    near = np.argpartition(-s[rows], k - 1, axis=1)[:, :k]
    row = np.repeat(rows, k)
    near = near.ravel()
    sim = s[row, near].astype(np.float64)
    keep = (sim >= low) & (sim > (-2 if floor is None else floor[row]))
    return node[row[keep]], node[near[keep]], sim[keep]


def hubs(node: np.ndarray, v: np.ndarray, links: float) -> tuple[np.ndarray, ...]:
    """(u, v, cosine): every row and the smallest of the nodes it is linked with."""
    order = np.argsort(node)
    s = v[order] @ v[order].T
    np.fill_diagonal(s, -2)
    first = (s >= links).argmax(axis=1)
    sim = s[np.arange(len(s)), first].astype(np.float64)
    some = sim >= links
    return node[order][some], node[order][first[some]], sim[some]


def edge_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    u, v, s = (np.concatenate(x) for x in zip(*parts))
    if not len(u):
        return None
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "s"])


EDGES = "u long, v long, s double"


#: Planes of a tree at most; so many leave only near copies together.
PLANES = 60


def tree_edges(vectors: DataFrame, n: int, p: Descent, attempt: int) -> DataFrame:
    """Nearest neighbours within the leaves of random-projection trees."""
    depth, trees = p.depth(n), p.trees_of(n, attempt)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in by_length(batch.column("v")):
                part = batch.take(pa.array(places))
                v = matrix(part.column("v"))
                for t in range(trees):
                    planes = np.random.default_rng([4, attempt, t, v.shape[1]]).standard_normal((v.shape[1], PLANES))
                    code = ((v @ planes) > 0) @ (1 << np.arange(PLANES, dtype=np.int64))
                    tree = np.full(len(v), (v.shape[1] << 20) + t, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree), part.column("node"), pa.array(code)], names=["tree", "node", "code"]
                    )

    def leaf(planes: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), planes.cast("int")) - 1
        return F.xxhash64(F.lit(attempt), "tree", planes.cast("int"), F.col("code").bitwiseAND(mask))

    most = 4 * p.block
    rows = cut(vectors.select("node", "v").mapInArrow(codes, "tree long, node long, code long"))
    rows = rows.withColumn("key", leaf(F.lit(depth)))
    large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most))
    if large.isEmpty():
        rows = rows.select("node", "key", F.lit(0).cast("long").alias("part"))
    else:
        # A leaf with a crowd is split on further planes, each branch until it is small.
        hot = join_salted(rows, large.select("key"), ["key"], "inner").select("tree", "node", "code")
        deeper = F.array(*(F.lit(d) for d in sorted({*range(depth + 2, PLANES, 2), PLANES})))
        split = hot.withColumn("planes", F.explode(deeper)).withColumn("key", leaf(F.col("planes")))
        sizes = split.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        small = join_salted(split, sizes.filter(F.col("size") <= most), ["key"], "inner")
        ends = small.groupBy("tree", "node").agg(F.min("planes").alias("planes"))
        rows = rows.drop("key").join(hot.select("tree", "node", F.lit(True).alias("hot")), ["tree", "node"], "left")
        rows = rows.join(ends, ["tree", "node"], "left")
        rows = rows.withColumn("planes", F.coalesce("planes", F.when(F.col("hot"), PLANES).otherwise(depth)))
        rows = cut(rows.select("tree", "node", leaf(F.col("planes")).alias("key")))
        # Near copies that no plane splits are dealt into parts that overlap, otherwise in every tree.
        whole = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
        rows = join_salted(rows, whole.select("key", F.ceil(F.col("size") / p.block).alias("parts")), ["key"], "left")
        part = F.pmod(F.xxhash64(F.lit(44), "key", "node"), F.coalesce("parts", F.lit(1)))
        both = F.array_distinct(F.array(part, F.pmod(part + 1, F.coalesce("parts", F.lit(1)))))
        rows = rows.select("node", "key", F.explode(both.cast("array<long>")).alias("part"))
    at = rows.groupBy("node").agg(F.collect_list(F.struct("key", "part")).alias("at")).join(vectors.select("node", "v"), "node")
    at = at.select(F.explode("at").alias("at"), "node", "v").select("at.key", "at.part", "node", "v")

    def leaf_edges(_, t: pa.Table) -> pa.RecordBatch | None:
        node, v = t.column("node").to_numpy(), matrix(t.column("v"))
        near = best(node, v, p.neighbours, p.floor)
        # Lists full of links may not connect a tight group; a common neighbour does.
        crowd = np.bincount(np.searchsorted(np.sort(node), near[0][near[2] >= p.threshold]), minlength=1)
        full = crowd.max() >= p.neighbours
        return edge_batch([near, hubs(node, v, p.threshold)] if full else [near])

    return cut(by_group(at, ["key", "part"], leaf_edges, EDGES))


def lists(edges: DataFrame, k: int) -> DataFrame:
    """(u, near): the k nearest of each vector, as an array of (cosine negated, v, fresh), nearest first.

    edges: u, v, s and fresh; a pair found again is as fresh as it was first. The edges of
    a vector are bounded by the number of lists that it was found in.
    """
    found = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("v"), F.col("fresh"))))
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return cut(once.groupBy("u").agg(F.slice(found, 1, k).alias("near")))


def refine(near: DataFrame, vectors: DataFrame, p: Descent) -> DataFrame:
    """One neighbours-of-neighbours join: (u, v, s) of pairs of which one has not been passed on, better edges only."""
    k = p.neighbours
    floor = F.when(F.size("near") < k, F.lit(-2.0)).otherwise(-F.element_at("near", -1)["d"])
    out = near.select(F.col("u").alias("at"), F.explode("near").alias("x")).select("at", F.col("x.v").alias("node"), "x.fresh")
    # At every vector meet those that list it, in parts of bounded size, and those it lists.
    into = out.select(F.col("node").alias("at"), F.col("at").alias("node"), "fresh")
    crowded = into.groupBy("at").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > p.hub)
    crowded = cut(crowded.select("at", F.ceil(F.col("d") / p.hub).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    into = join_salted(into, crowded, ["at"], "left").select(
        "at", F.pmod(F.xxhash64(F.lit(45), "node"), parts).cast("long").alias("part"), "node", "fresh"
    )
    out = out.join(crowded, "at", "left").select("at", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "node", "fresh")
    members = F.collect_set(F.struct("node", "fresh"))
    meeting = into.unionByName(out).groupBy("at", "part").agg(members.alias("m"))
    meeting = meeting.filter((F.size("m") > 1) & F.exists("m", lambda x: x["fresh"]))
    meeting = cut(meeting.select("at", "part", F.explode("m").alias("x")).select("at", "part", "x.node", "x.fresh"))
    own = near.select(F.col("u").alias("node"), floor.alias("floor"))
    own = vectors.join(own, "node").select("node", "v", "floor")
    meeting_v = join_hot(meeting, own, "node")

    def meet(_, t: pa.Table) -> pa.RecordBatch | None:
        t = t.sort_by([("node", "ascending"), ("fresh", "descending")])
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        fresh = t.column("fresh").to_numpy(zero_copy_only=False)
        return edge_batch([best(node, matrix(t.column("v")), k, p.floor, t.column("floor").to_numpy(), fresh)])

    found = cut(by_group(meeting_v.select("at", "part", "node", "fresh", "floor", "v"), ["at", "part"], meet, EDGES))
    discard(crowded, meeting)
    return found


def known(near: DataFrame, fresh: Column | None = None) -> DataFrame:
    """The edges of lists again."""
    x = F.col("x")
    rows = near.select("u", F.explode("near").alias("x"))
    return rows.select("u", x["v"].alias("v"), (-x["d"]).alias("s"), (x["fresh"] if fresh is None else fresh).alias("fresh"))


def classes_of(link: np.ndarray) -> np.ndarray:
    """The first row that each row's links reach, rows being linked in the symmetric matrix ``link``."""
    n = np.int32(len(link))
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(link, label, n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def crowd(t: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links of the vectors of one pair of blocks: (u, null, links) and edges (u, v, 0).

    ``v`` holds doubles; they decide where single precision is too close to the threshold.
    """
    block, node, copies = (t.column(c).to_numpy() for c in ("block", "node", "copies"))
    first, second = divmod(t.column("pair")[0].as_py(), 1 << 31)
    low = block == first
    if first != second and (low.all() or not low.any()):
        return None  # one block of the pair has no rows
    v = matrix(t.column("v"), np.float64)
    ia = np.flatnonzero(low)
    ib = ia if first == second else np.flatnonzero(~low)
    s = v[ia].astype(np.float32) @ v[ib].astype(np.float32).T
    link = s >= threshold
    x, y = np.nonzero(np.abs(s - np.float32(threshold)) <= margin(v.shape[1]))
    for at in range(0, len(x), 1 << 16):
        i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        link[i, j] = np.einsum("nd,nd->n", v[ia[i]], v[ib[j]]) >= threshold
    if ib is ia:
        np.fill_diagonal(link, False)
        link |= link.T  # both orders of a sum of products may differ in the last place
    total = np.zeros(len(node), dtype=np.int64)
    total[ia] += link @ copies[ib]
    if ib is ia:
        label = ia[classes_of(link)]
        ends = np.stack([ia, label])
    else:
        total[ib] += link.T @ copies[ia]
        # Every column and its first link; the rows that columns share are connected too.
        other = link.any(axis=0)
        ends = np.stack([ia[link.argmax(axis=0)[other]], ib[other]])
        ends = np.concatenate([ends, bridges(link, ia)], axis=1)
    ends = ends[:, ends[0] != ends[1]]
    u = np.concatenate([node[total > 0], node[ends[0]]])
    none = pa.nulls(int((total > 0).sum()), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(u),
            pa.concat_arrays([none, pa.array(node[ends[1]], pa.int64())]),
            pa.array(np.concatenate([total[total > 0], np.zeros(ends.shape[1], dtype=np.int64)])),
        ],
        names=["u", "v", "links"],
    )


def bridges(link: np.ndarray, ia: np.ndarray) -> np.ndarray:
    """Edges that connect the rows of each connected part of a matrix between two blocks."""
    n = np.int32(len(ia))
    label = np.arange(n, dtype=np.int32)
    while True:
        column = np.where(link, label[:, None], n).min(axis=0, initial=n)
        new = np.minimum(label, np.where(link, column[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            return np.stack([ia, ia[label]])
        label = new


def linked(seen: DataFrame, near: DataFrame, vectors: DataFrame, p: Descent) -> DataFrame:
    """Facts on links: (u, null, links) to be summed for each vector, and edges (u, v, 0).

    seen: links (u, v), u < v. vectors: node, copies and the doubles ``v``. ``whole`` tells
    the facts of components that were compared whole.
    """
    full = near.filter((F.size("near") >= p.neighbours) & (-F.element_at("near", -1)["d"] >= p.threshold - CLOSE))
    groups = components(seen).withColumnRenamed("component", "group")
    crowds = groups.join(full.select(F.col("u").alias("node")), "node", "left_semi").select("group").distinct()
    groups = cut(join_salted(groups, crowds, ["group"], "inner"))
    size = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / p.block).alias("n"))
    inside = join_salted(groups, size, ["group"], "inner").join(vectors.select("node", "copies", "v"), "node")
    rows = blocks(inside, "group", "n", "node").select("group", "pair", "block", "node", "copies", "v")
    whole = by_group(rows, ["group", "pair"], lambda _, t: crowd(t, p.threshold), "u long, v long, links long")
    few = cut(join_salted(seen, groups.select(F.col("node").alias("u")), ["u"], "left_anti"))
    ends = few.unionByName(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = ends.join(vectors.filter("copies > 1").select(F.col("node").alias("v"), "copies"), "v", "left")
    none = F.lit(None).cast("long")
    ordinary = ends.select("u", none.alias("v"), F.coalesce("copies", F.lit(1).cast("long")).alias("links")).unionByName(
        few.select("u", "v", F.lit(0).cast("long").alias("links"))
    )
    facts = cut(whole.withColumn("whole", F.lit(True)).unionByName(ordinary.withColumn("whole", F.lit(False))))
    discard(groups, few)
    return facts


#: Cosines in single precision that are nearer to the threshold are computed again; margin(size) up to 8000 components.
CLOSE = 2.0**-10


def settled(edges: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (u, v), u < v, of cosine ``threshold`` or more; doubles decide close cases."""
    pairs = edges.filter(F.col("s") >= threshold - CLOSE)
    pairs = pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("s").alias("s"))
    pairs = cut(pairs)
    own = vectors.select(F.col("node").alias("u"), F.col("v").alias("x"))
    other = vectors.select(F.col("node").alias("v"), F.col("v").alias("y"))
    close = pairs.filter(F.abs(F.col("s") - threshold) <= CLOSE)
    close = close.join(own, "u").join(other, "v").select("u", "v", "x", "y")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places in by_length(b.column("x")):
                part = b.take(pa.array(places))
                s = np.einsum("nd,nd->n", matrix(part.column("x"), np.float64), matrix(part.column("y"), np.float64))
                yield part.select(["u", "v"]).filter(pa.array(s >= threshold))

    sure = pairs.filter(F.col("s") > threshold + CLOSE).select("u", "v")
    out = cut(sure.unionByName(close.mapInArrow(decide, "u long, v long")))
    discard(pairs)
    return out


def all_linked(vectors: DataFrame, p: Descent) -> DataFrame:
    """The facts of ``linked`` from all pairs of vectors of one length, in larger blocks."""
    rows = vectors.withColumn("group", F.length("v").cast("long"))
    size = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (4 * p.block)).alias("n"))
    rows = blocks(join_salted(rows, size, ["group"], "inner"), "group", "n", "node")
    rows = rows.select("group", "pair", "block", "node", "copies", "v")
    facts = by_group(rows, ["group", "pair"], lambda _, t: crowd(t, p.threshold), "u long, v long, links long")
    return cut(facts.withColumn("whole", F.lit(True)))


def audit(vectors: DataFrame, near: DataFrame, links: DataFrame, p: Descent) -> float:
    """Share of links found, on average over vectors that have any, estimated from samples.

    Vectors are of four kinds: in a component compared whole, with links otherwise, with a
    near neighbour but no link, and others. Of each kind a bounded number, chosen by a hash, is
    compared with all; the means of the last three kinds weigh as their numbers do. The
    first kind has most of the links and misses few, so it counts by itself, and the
    worse of the two is the result. 1 if no sampled vector has a link.
    """
    found = links.filter("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"), F.max("whole").alias("whole"))
    kind = F.when(F.col("whole"), 0).when(F.col("links") > 0, 1).when(F.col("is_near"), 2).otherwise(3)
    near = near.select(F.col("u").alias("node"), F.lit(True).alias("is_near"))
    rows = vectors.join(found.withColumnRenamed("u", "node"), "node", "left").join(near, "node", "left")
    rows = cut(rows.select(kind.alias("kind"), "node", F.coalesce("links", F.lit(0)).alias("links")))
    number = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for k in number:
        most = p.audited_any if k == 3 else p.audited
        some = rows.filter(F.col("kind") == k).orderBy(F.xxhash64(F.lit(46), "node"), "node").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return 1.0
    chosen = cut(chosen)
    queries = chosen.join(vectors.select("node", "v"), "node").collect()  # audited_any and 3 times audited at most
    true = {r["u"]: r["n"] for r in _true_links(vectors, queries, p.threshold).collect()}
    share, linked_share, n = dict.fromkeys(range(4), 0.0), dict.fromkeys(range(4), 0.0), dict.fromkeys(range(4), 0)
    for q in queries:
        n[q["kind"]] += 1
        if q["node"] in true:
            share[q["kind"]] += min(1.0, q["links"] / true[q["node"]])
            linked_share[q["kind"]] += 1
    discard(rows, chosen)
    weigh = lambda x: sum(number[k] * x[k] / n[k] for k in (1, 2, 3) if n[k])
    ordinary = weigh(share) / weigh(linked_share) if weigh(linked_share) else 1.0
    return min(ordinary, share[0] / linked_share[0] if linked_share[0] else 1.0)


#: Queries that are compared with a batch at once.
STRIP = 512


def _true_links(vectors: DataFrame, queries: list, threshold: float) -> DataFrame:
    """(u, n): the links of the queried vectors, by brute force over all doubles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries), dtype=np.int64)
        held = {}
        for size in {len(q["v"]) for q in queries}:
            mine = np.array([i for i, q in enumerate(queries) if len(q["v"]) == size])
            v = np.array([np.frombuffer(queries[i]["v"]) for i in mine])
            held[size] = mine, v, np.array([queries[i]["node"] for i in mine])
        for batch in batches:
            for places in by_length(batch.column("v")):
                part = batch.take(pa.array(places))
                v = matrix(part.column("v"), np.float64)
                if 8 * v.shape[1] not in held:
                    continue
                mine, q, own = held[8 * v.shape[1]]
                q32, slack = q.astype(np.float32), margin(v.shape[1])
                node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                for i in range(0, len(v), STRIP):
                    j = slice(i, i + STRIP)
                    s = v[j].astype(np.float32) @ q32.T
                    x, y = np.nonzero(s >= threshold - slack)
                    good = (np.einsum("nd,nd->n", v[j][x], q[y]) >= threshold) & (node[j][x] != own[y])
                    np.add.at(total, mine[y[good]], copies[j][x[good]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([queries[i]["node"] for i in some], pa.int64()), pa.array(total[some])], names=["u", "n"]
        )

    true = vectors.select("node", "v", "copies").mapInArrow(count, "u long, n long")
    return true.groupBy("u").agg(F.sum("n").alias("n"))


def usable(vector: Column) -> Column:
    """No null, no non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = [np.frombuffer(x).astype(np.float32).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], names=["node", "v"])


def near_dedup(df: DataFrame, p: Descent = Descent(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of df: (id, n_links, component_id, kept, audited_recall).

    Vectors are linked when their cosine in double precision is ``p.threshold`` or more.
    component_id is the smallest id that links reach. Equal vectors are one node, so
    copies are never expanded. Vectors that are null, empty, zero or hold null or
    non-finite components are linked with nothing, and so are vectors of different
    lengths with each other. An id belongs to one vector; rows that repeat both count as
    copies. A null id is linked with nothing and is kept. No link is found that isn't
    one; ``audited_recall`` is the audit's share of links found (see ``audit``): 1 if the
    samples have none at all, or if all pairs were compared.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fit = usable(F.col("x")) & F.col("id").isNotNull()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("x"):
                v = np.array(x.values, dtype=np.float64)
                v = v / np.abs(v).max()
                out.append((v / math.sqrt(float(v @ v))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "v"])

    rows = cut(source.filter(fit).mapInArrow(unit, "id long, v binary"))
    vectors = cut(rows.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    light = cut(vectors.select("node", "v").mapInArrow(_single, "node long, v binary"))
    n = vectors.count()
    recall, attempt, spent = 0.0, 0, 0
    near: DataFrame | None = None
    links: DataFrame | None = None
    seen: DataFrame | None = None
    while recall < p.recall:
        if links is not None:
            discard(links)
        spent += p.trees_of(n, attempt)
        if attempt == p.attempts or (attempt and spent * p.leaf > n / 2):
            links, recall = all_linked(vectors, p), 1.0
            break
        new = tree_edges(light, n, p, attempt)
        fresh = new.withColumn("fresh", F.lit(True))
        lists_now = lists(fresh if near is None else fresh.unionByName(known(near, F.lit(False))), p.neighbours)
        discard(near)
        near, found = lists_now, [new]
        total = near.agg(F.sum(F.size("near"))).first()[0] or 0
        for _ in range(p.rounds if total else 0):
            better = refine(near, light, p)
            found.append(better)
            before, near = near, lists(known(near, F.lit(False)).unionByName(better.withColumn("fresh", F.lit(True))), p.neighbours)
            discard(before)
            news = near.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"])))).first()[0]
            if not news or news < p.news * total:
                break
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        now = settled(every.select("u", "v", "s"), vectors, p.threshold)
        discard(*found)
        seen, before = (now, None) if seen is None else (cut(seen.unionByName(now).distinct()), seen)
        discard(before)
        links = linked(seen, near, vectors, p)
        recall = audit(vectors, near, links, p)
        attempt += 1
    classes = components(links.filter("v IS NOT NULL").select("u", "v"))
    counts = links.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    nodes = vectors.join(classes, "node", "left").join(counts, "node", "left").filter("copies > 1 OR links > 0")
    matched = join_salted(rows, nodes, ["v"], "left").select("id", "node", "copies", "links", "component")
    none = F.lit(None).cast("long")
    other = source.filter(~F.coalesce(fit, F.lit(False))).select("id", *(none.alias(c) for c in ("node", "copies", "links", "component")))
    class_id = F.coalesce("component", "node", "id")
    return matched.unionByName(other).select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        class_id.alias("component_id"),
        (class_id.isNull() | (class_id == F.col("id"))).alias("kept"),
        F.lit(float(recall)).alias("audited_recall"),
    )
