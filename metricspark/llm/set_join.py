"""N-gram Jaccard join by chosen paths.

Every text is the set of its shingles (runs of five words), sketched by minimum hashes.
A run sends each set down paths of sampled tokens: sets that share a sampled minimum go
on together. Buckets that become small are compared by brute force on sketches; large
ones are split on further sampled tokens. Runs are repeated until the target recall.
What is alike in sketch forms groups, in which true Jaccard similarities are then
computed block by block, so no pair is decided by an estimate and no pairs are listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricspark.llm.arrays import mix, slices, words
from metricspark.llm.common import Forest, blocks, by_group, components, cut, discard, join_salted

#: Minimum hashes of a sketch, two bytes each.
COORDINATES = 64


@dataclass(frozen=True)
class Join:
    """Parameters. ``similarity`` as a fraction so that the comparison is exact.

    leaf: sets of a bucket that are compared by brute force. alike: equal coordinates from
    which a pair is a candidate; core: from which all partners of a set are candidates of
    the same pivot. steps: tokens sampled before a bucket's parts are looked at again, at
    most ``depth`` times. whole: pairs of blocks of a leaf's size up to which all that is left
    is compared instead. block, block_tokens: sets and tokens of a verification block.
    """

    words: int = 5
    over: tuple[int, int] = (4, 5)
    recall: float = 0.999
    leaf: int = 1024
    alike: int = 36
    core: int = 58
    steps: int = 2
    depth: int = 5
    whole: int = 512
    block: int = 1024
    block_tokens: int = 1_000_000

    @property
    def similarity(self) -> float:
        return self.over[0] / self.over[1]

    def runs_of(self, splits: int) -> int:
        """Runs after which a pair at the limit has been missed with 1 - recall, though its
        buckets be split so often. A pair's common paths branch with a mean of one at every
        step."""
        together = 1.0
        for _ in range(1 + self.steps * splits):
            together = 1 - math.exp(-together)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - together)))

    @property
    def runs(self) -> int:
        """Runs that the deepest split allowed may need."""
        return self.runs_of(self.depth)


def shingles(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    h, at = words(texts, seed=8)
    grams = np.zeros(len(h), dtype=np.uint64)
    for k in range(size):
        grams[: len(h) - k] = grams[: len(h) - k] * np.uint64(0xD1342543DE82EF95) + h[k:]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            g = np.sort(grams[a : b - size + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            places = mix(np.arange(b - a, dtype=np.uint64) + np.uint64(b - a << 8)) | np.uint64(1)
            out.append(mix((h[a:b] * places).sum(keepdims=True)))
        else:
            out.append(grams[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minimum hashes of four bytes for each set; zeros for an empty one."""
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    tokens = np.concatenate([sets[i] for i in some])
    starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    factors = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    work = np.empty_like(tokens)
    for c in range(COORDINATES):
        np.multiply(tokens, factors[c], out=work)
        np.right_shift(work, np.uint64(32), out=work)
        out[some, c] = np.minimum.reduceat(work.astype(np.uint32), starts)
    return out


def sketches(least: np.ndarray) -> np.ndarray:
    """Two bytes for each of the minimum hashes, enough for comparing sets of one bucket."""
    places = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    return (mix(least.astype(np.uint64) + places) >> np.uint64(48)).astype(np.uint16)


def first_keys(runs: int, similarity: float) -> list[tuple[int, int]]:
    """(run, coordinate) of the first step: 1 / similarity coordinates a run on average."""
    order = np.random.default_rng(8).permutation(COORDINATES)
    ends = [int(r / similarity) for r in range(runs + 1)]
    return [(r, int(order[p % COORDINATES])) for r in range(runs) for p in range(ends[r], ends[r + 1])]


def path_keys(keys: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Keys of the next step of paths, as signed 64-bit."""
    x = mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return mix(x ^ (coordinate.astype(np.uint64) << np.uint64(32) | value.astype(np.uint64))).view(np.int64)


def sketch_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)


def joined(sketch: np.ndarray, alike: int) -> Iterator[tuple[int, int]]:
    """Edges that connect all sets of a bucket whose sketches are alike, without a circle."""
    forest = Forest(len(sketch))
    for i in range(len(sketch) - 1):
        same = (sketch[i + 1 :] == sketch[i]).sum(axis=1)
        for j in np.flatnonzero(same >= alike).tolist():
            if forest.join(i, i + 1 + j):
                yield i, i + 1 + j


def candidates(sets: DataFrame, p: Join) -> DataFrame:
    """Edges (u, v) whose components hold every pair of sets that may be similar.

    Runs enough for one split come first. Of sets whose buckets were split more often, as
    many more follow as the deepest split needs.
    """
    found: list[DataFrame] = []
    done, wanted = 0, p.runs_of(1)
    while done < wanted:
        edges, splits, deep = paths(sets, p, done, wanted)
        found.append(edges)
        done, wanted = wanted, max(wanted, p.runs_of(splits))
        if deep is not None:
            sets = cut(sets.join(deep, "node", "left_semi"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if len(found) == 1:
        return every
    out = cut(every.distinct())
    discard(*found)
    return out


def paths(sets: DataFrame, p: Join, first: int, last: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Edges of the runs from ``first`` up to ``last``, how often the deepest bucket was split, and the sets (node) of those split more than once.

    sets: node, sketch, and least, the whole minimum hashes that the runs start from: two
    bytes would let strangers meet in numbers that grow with the square of the input.
    """
    every = first_keys(p.runs, p.similarity)
    steps = [x for x in every if first <= x[0] < last]
    c = np.array([x for _, x in steps])
    back = np.searchsorted(np.unique([x for _, x in every]), c)
    roots = mix(np.array([r for r, _ in steps], dtype=np.uint64) + np.uint64(1))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(1).to_pylist())
            s = np.frombuffer(raw, dtype=np.uint32).reshape(batch.num_rows, -1)[:, back]
            keys = path_keys(np.broadcast_to(roots, s.shape).ravel(), np.broadcast_to(c, s.shape).ravel(), s.ravel())
            node = np.repeat(batch.column(0).to_numpy(), len(c))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], names=["key", "node"])

    starts = sets.select("node", "least").mapInArrow(start, "key long, node long")
    sizes = starts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # Sketches travel only with paths that meet others, one row for each set and its keys.
    met = join_salted(starts, sizes.select("key"), ["key"], "inner", 4)
    met = met.groupBy("node").agg(F.collect_list("key").alias("keys")).join(sets.select("node", "sketch"), "node")
    level = cut(met.select(F.explode("keys").alias("key"), "node", "sketch"))

    # What small buckets hold is compared in one go at the end.
    leaves: DataFrame | None = None
    edges: DataFrame | None = None
    whole: DataFrame | None = None
    splits, deep = 0, None
    for depth in range(p.depth + 1):
        sizes = cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        small = sizes.filter(F.col("size") <= p.leaf)
        few = join_salted(level, small.select("key"), ["key"], "inner").select("key", F.lit(0).cast("long").alias("pair"), "node", "sketch")
        large = sizes.filter(F.col("size") > p.leaf)
        if depth == p.depth:
            # The last large buckets are compared whole, in pairs of bounded blocks.
            rest = join_salted(level, large, ["key"], "inner")
            whole = packed(rest.withColumn("n", F.ceil(F.col("size") / p.leaf)))
        leaves = few if leaves is None else leaves.unionByName(few)
        if depth == p.depth or large.isEmpty():
            break
        pivots = (
            join_salted(level, large.select("key"), ["key"], "inner", keep_salt=True)
            .groupBy("key", "__salt")
            .agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "sketch")).alias("p"))
            .groupBy("key")
            .agg(F.min("p").alias("p"))
            .select("key", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("pivot_sketch"))
        )
        compared = cut(join_salted(level, pivots, ["key"], "inner").mapInArrow(
            lambda b: _compare(b), "key long, node long, sketch binary, pivot long, same int"
        ))
        linked = compared.filter((F.col("same") >= p.alike) & (F.col("node") != F.col("pivot")))
        linked = linked.select(F.col("pivot").alias("u"), F.col("node").alias("v"))
        edges = linked if edges is None else edges.unionByName(linked)
        # Sets as close to the pivot as that have all their partners linked to it; a bucket in
        # which all are linked is connected already.
        # Linked sets are connected, so they go on only for the sake of unlinked ones. A pair
        # that agrees in ``alike`` coordinates differs in COORDINATES - alike at most, so their
        # agreements with the pivot differ by no more than that.
        unlinked = F.max(F.when(F.col("same") < p.alike, F.col("same"))).alias("nearest")
        open_keys = compared.groupBy("key").agg(unlinked).filter("nearest IS NOT NULL")
        going = compared.filter((F.col("same") < p.core) & (F.col("node") != F.col("pivot")))
        going = join_salted(going.select("key", "node", "sketch", "same"), open_keys, ["key"], "inner")
        useful = (F.col("same") < p.alike) | (F.col("same") <= F.col("nearest") + COORDINATES - p.alike)
        going = cut(going.filter(useful).select("key", "node", "sketch"))
        rest = cut(going.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / p.leaf).alias("n")))
        if (rest.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) <= p.whole:
            # What is left is compared whole: nothing more is lost.
            whole = packed(join_salted(going, rest, ["key"], "inner"))
            break
        if depth:
            again = going.select("node").distinct()
            deep = again if deep is None else deep.unionByName(again)
        share = 1 / (p.similarity * COORDINATES)
        level = cut(going.mapInArrow(lambda b: _descend(b, share, p.steps), "key long, node long, sketch binary"))
        splits = depth + 1
    near = by_group(leaves, ["key", "pair"], lambda _, t: _leaf(t, p.alike), "u long, v long")
    if whole is not None:
        near = near.unionByName(by_group(whole, ["key", "pair"], lambda _, t: _blocks(t, p.alike), "u long, v long"))
    out = cut((near if edges is None else near.unionByName(edges)).distinct())
    return out, splits, None if deep is None else cut(deep.distinct())


def packed(members: DataFrame) -> DataFrame:
    """(key, pair, nodes, sketches): each group's rows (key, node, sketch, n) as n blocks, one row each, for every pair of them.

    All pairs of a group's rows meet in one pair of blocks, or in a block alone. A block is one row of
    about a leaf's sets, so what is sent are as many rows as there are blocks squared, whatever they hold.
    """
    n = F.col("n").cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64(F.lit(33), F.col("node")), n).cast("int"))
    held = F.sort_array(F.collect_list(F.struct("node", "sketch"))).alias("x")
    rows = rows.groupBy("key", n.alias("n"), "block").agg(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    return rows.select("key", (low * F.lit(1 << 31) + high).alias("pair"), F.col("x.node").alias("nodes"), F.col("x.sketch").alias("sketches"))


def _blocks(t: pa.Table, alike: int) -> pa.RecordBatch | None:
    """Edges of one pair of packed blocks."""
    flat = lambda c: pa.chunked_array([x.flatten() for x in t.column(c).chunks])
    return _leaf(pa.table({"node": flat("nodes"), "sketch": flat("sketches")}), alike)


def _leaf(t: pa.Table, alike: int) -> pa.RecordBatch | None:
    node = t.column("node").to_numpy()
    pairs = list(joined(sketch_rows(t.column("sketch")), alike))
    if not pairs:
        return None
    i, j = np.array(pairs).T
    return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            same = (sketch_rows(b.column("sketch")) == sketch_rows(b.column("pivot_sketch"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("node"), b.column("sketch"), b.column("pivot"), pa.array(same.astype(np.int32))],
                names=["key", "node", "sketch", "pivot", "same"],
            )


def _descend(batches: Iterator[pa.RecordBatch], share: float, steps: int) -> Iterator[pa.RecordBatch]:
    """Next steps of paths: every coordinate is sampled with ``share``, alike for all sets of a key."""
    limit = np.uint64(int(share * 2**64))
    each = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for b in batches:
        if not b.num_rows:
            continue
        keys, row = b.column("key").to_numpy(), np.arange(b.num_rows)
        s = sketch_rows(b.column("sketch"))
        for _ in range(steps):
            keys = keys.view(np.uint64)
            path, c = np.nonzero(mix(mix(keys)[:, None] + each) < limit)
            row = row[path]
            keys = path_keys(keys[path], c, s[row, c])
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), b.column("node").take(rows), b.column("sketch").take(rows)], names=["key", "node", "sketch"]
        )


def common_tokens(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    tokens = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)))
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, width):
        i, j = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(a) + len(b), width), dtype=np.float32)
        m[row[i:j], column[i:j] - first] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _verify(t: pa.Table, over: tuple[int, int]) -> pa.RecordBatch | None:
    """Links of the sets of one pair of blocks: (u, null, links) and edges (u, v, 0)."""
    once = np.unique(np.stack([t.column(c).to_numpy() for c in ("block", "node")]), axis=1, return_index=True)[1]
    if len(once) < t.num_rows:
        t = t.take(pa.array(once))
    block, node, copies = (t.column(c).to_numpy() for c in ("block", "node", "copies"))
    sets = [np.frombuffer(s, dtype=np.uint64) for s in t.column("tokens").to_pylist()]
    first, second = divmod(t.column("pair")[0].as_py(), 1 << 31)
    low = block == first
    if first != second and (low.all() or not low.any()):
        return None  # one block of the pair has no rows
    ia = np.flatnonzero(low)
    ib = ia if first == second else np.flatnonzero(~low)
    a, b = [sets[i] for i in ia], [sets[i] for i in ib]
    common = common_tokens(a, b)
    sizes = np.array([len(s) for s in sets])
    link = over[1] * common >= over[0] * (sizes[ia][:, None] + sizes[ib][None, :] - common)
    if ib is ia:
        np.fill_diagonal(link, False)
    if not link.any():
        return None
    u, v, links = [], [], []
    counts = link @ copies[ib]
    u.append(node[ia][counts > 0])
    links.append(counts[counts > 0])
    if ib is not ia:
        counts = link.T @ copies[ia]
        u.append(node[ib][counts > 0])
        links.append(counts[counts > 0])
    n = sum(map(len, u))
    forest = Forest(len(node))
    edges = [(ia[i], ib[j]) for i, j in _spanning(link, ia, ib, forest)]
    if edges:
        x, y = np.array(edges).T
        u.append(node[x])
        v = node[y].tolist()
    total = np.concatenate([*links, np.zeros(len(edges))]).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(u)), pa.array([None] * n + v, pa.int64()), pa.array(total)], names=["u", "v", "links"]
    )


def _spanning(link: np.ndarray, ia: np.ndarray, ib: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
    for i in range(len(ia)):
        for j in np.flatnonzero(link[i]).tolist():
            if forest.join(int(ia[i]), int(ib[j])):
                yield i, j


def jaccard_join(df: DataFrame, p: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: (id, class_id, n_links, n_copies, kept, text_key).

    Two texts are linked if the Jaccard similarity of their sets of word shingles is
    ``p.over`` or more. A class is all that links connect; class_id is its smallest id.
    n_links counts the other rows linked directly, those with an equal set included;
    n_copies the rows with an equal set, the row itself included. kept: id = class_id,
    of rows with that id those with the class's least text_key.
    text_key is a hash of the row's text, by which rows that share an id are told apart.

    Words are runs of letters and digits in lower case. A text of fewer than five words
    is one shingle of all of them; a text without words, null too, has an empty set and
    is linked with nothing. Ids are longs; rows that repeat an id and its text count as
    copies, and rows that reuse an id for another text are judged apart from it; a row with a null id is linked with nothing and its class is null. Other
    columns are left out; no rows give none.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    started = np.unique([c for _, c in first_keys(p.runs, p.similarity)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(texts):
                sets = shingles(texts[i:j], p.words)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                least = minima(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(names, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x.tobytes() for x in sketches(least)], pa.binary()),
                        pa.array([x.tobytes() for x in least[:, started]], pa.binary()),
                    ],
                    names=["id", "text_key", "name", "size", "sketch", "least"],
                )

    schema = "id long, text_key long, name binary, size long, sketch binary, least binary"
    rows = cut(source.mapInArrow(describe, schema))
    linkable = rows.filter(F.col("name").isNotNull() & F.col("id").isNotNull())
    # Rows with an equal set are one node from here on.
    least_row = F.min(F.struct("id", "text_key")).alias("r")
    sets = linkable.groupBy("name").agg(
        least_row, F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "sketch", "least"))
    )
    sets = cut(sets.withColumn("id", F.col("r.id")).withColumn("text_key", F.col("r.text_key")).withColumn("node", F.col("id")).drop("r"))
    reused = cut(sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("reused")))
    if not reused.isEmpty():
        # An id that stands for several sets names none of them: those nodes get numbers of their own.
        own = F.when(F.col("reused"), -F.abs(F.shiftright(F.xxhash64("name"), 2)) - 1).otherwise(F.col("id"))
        apart = cut(sets.join(reused, "id", "left").withColumn("node", own).drop("reused"))
        discard(sets)
        sets = apart
    edges = candidates(sets, p)
    groups = components(edges).select("node", F.col("component").alias("group"))
    members = cut(groups.join(sets.select("node", "id", "text_key", "copies", "size"), "node"))
    weights = members.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("tokens"))
    weights = weights.select(
        "group", F.greatest(F.ceil(F.col("m") / p.block), F.ceil(F.col("tokens") / p.block_tokens)).alias("n")
    )
    members = join_salted(members, weights, ["group"], "inner")
    # Rows that repeat both id and text come more than once; _verify takes one of each node.
    texts = source.join(members.select("id", "text_key", "node", "group", "n", "copies"), ["id", "text_key"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            for i, j in slices(found):
                raw = pa.array([s.tobytes() for s in shingles(found[i:j], p.words)], pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), part.column(4), raw],
                    names=["node", "group", "n", "copies", "tokens"],
                )

    held = texts.select("node", "text", "group", "n", "copies").mapInArrow(
        tokens, "node long, group long, n long, copies long, tokens binary"
    )
    held = blocks(held, "group", "n", "node").select("group", "pair", "block", "node", "copies", "tokens")
    facts = cut(by_group(held, ["group", "pair"], lambda _, t: _verify(t, p.over), "u long, v long, links long"))

    classes = components(facts.filter("v IS NOT NULL").select("u", "v"))
    named = cut(classes.join(sets.select("node", "id", "text_key"), "node"))
    first = named.groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("class_row"))
    classes = join_salted(named.select("node", "component"), first, ["component"], "inner")
    links = facts.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    nodes = sets.select("name", "node", "id", "text_key", "copies").join(classes, "node", "left").join(links, "node", "left")
    nodes = nodes.filter("copies > 1 OR component IS NOT NULL")
    nodes = nodes.select("name", "copies", "links", F.coalesce("class_row", F.struct("id", "text_key")).alias("stays"))
    out = join_salted(rows.select("id", "text_key", "name"), nodes, ["name"], "left")
    own = F.col("id").isNotNull()
    class_id = F.coalesce("stays.id", "id")
    stays = (F.col("stays.id") == F.col("id")) & (F.col("stays.text_key") == F.col("text_key"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(own, class_id).alias("class_id"),
        F.when(own, F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0).alias("n_links"),
        F.when(own, F.coalesce("copies", F.lit(1))).otherwise(1).alias("n_copies"),
        (~own | F.col("stays").isNull() | stays).alias("kept"),
        "text_key",
    )
