"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there.

    Unlike a checkpoint, which keeps the size estimate of its plan, the table has its
    real size. Estimates of joins are products; in a loop they grow to numbers whose
    arithmetic takes longer than the work.
    """
    place = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out.written_at = place
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables made by ``cut`` that no later plan reads."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t.written_at)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def own(*columns: str) -> list[Column]:
    """Columns by their whole names, which may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def mapped(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` of df to its own columns, whatever they are called."""
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    called = lambda batch, names: pa.RecordBatch.from_arrays(batch.columns, names=names)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(called(b, names) for b in batches):
            yield called(batch, plain)

    rows = df.toDF(*plain)
    return rows.mapInArrow(renamed, rows.schema).toDF(*names)


def unused(name: str, *tables: DataFrame) -> str:
    """The name, or a longer one, that no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def join_salted(left: DataFrame, right: DataFrame, on: list[str], how: str, salts: int = 8, keep_salt: bool = False) -> DataFrame:
    """Join when single keys may hold a large share of left; right has few rows for each key.

    Left rows are dealt over ``salts`` values, right rows are repeated for each of
    them, so that no task gets all rows of a key.
    """
    salt = unused("__salt", left, right)
    spread = F.pmod(F.xxhash64(*own(*left.columns)), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    out = left.withColumn(salt, spread).join(right.withColumn(salt, copies), [*on, salt], how)
    return out if keep_salt else out.drop(salt)


def join_hot(left: DataFrame, right: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """Inner join; right has one row for each key.

    Keys with more than ``most`` left rows are dealt over as many parts as that takes; only
    their right rows are repeated, once for each part.
    """
    n, many, part = (unused(c, left, right) for c in ("__n", "__parts", "__part"))
    count = left.groupBy(*own(key)).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > most)
    hot = cut(count.select(*own(key), F.ceil(F.col(n) / most).cast("int").alias(many)))
    if hot.isEmpty():
        discard(hot)
        return left.join(right, key)
    parts = F.coalesce(many, F.lit(1))
    spread = F.pmod(F.xxhash64(*own(*left.columns)), parts).cast("int")
    left = join_salted(left, hot, [key], "left").withColumn(part, spread).drop(many)
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    right = right.join(hot, key, "left").withColumn(part, copies).drop(many)
    return left.join(right, [key, part]).drop(part)


def one_of_each(df: DataFrame, keys: list[Column], order: Column | None = None) -> DataFrame:
    """df with one of the rows that agree in all keys; ordinary rows aren't moved.

    The first by ``order`` stays, then by a hash of the whole row. Keys that repeat are found
    first, from the keys alone; only their rows are shuffled.
    """
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    mark, whole = unused("__key", df), unused("__whole", df)
    count = df.select(F.xxhash64(key).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    again = cut(count.filter("n > 1").select(F.col("key").alias(mark)))
    if again.isEmpty():
        discard(again)
        return df
    columns = own(*df.columns)
    rows = df.withColumn(mark, F.xxhash64(key))
    alone = rows.join(again, mark, "left_anti").select(columns)
    several = rows.join(again, mark, "left_semi").withColumn(whole, key)
    hashed = F.xxhash64(*(c for c, f in zip(columns, df.schema.fields) if f.dataType.typeName() != "map"))
    first = F.min_by(F.struct(*columns), hashed if order is None else F.struct(order.alias("order"), hashed.alias("whole")))
    # Map-side aggregation leaves one row for each key and task, however often it repeats.
    return alone.unionByName(several.groupBy(whole).agg(first.alias("r")).select("r.*"))


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of the column's text form, modulo ``modulus``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def labelled_sample(
    labels: DataFrame, keep: Column, label: str, max_rows: int, id_col: str = "doc_id"
) -> DataFrame:
    """(id, label) of at most about ``max_rows`` labelled rows, chosen by a hash of the id.

    Rows are taken below a hash limit that follows from their number, so the choice
    is the same on every run and needs no sort. All rows stay if there are fewer. An id
    with several labels counts once, with the smallest.
    """
    rows = labels.filter(keep & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(id_col).agg(F.min(F.col(label).cast("double")).alias("label"))
    n = rows.count()
    return rows if n <= max_rows else rows.filter(sampled(F.col(id_col), 7, max_rows / n))


#: Values of a hash that decides on samples; shares down to one in so many can be told apart.
STEPS = 1 << 53


def sampled(column: Column, seed: int, share: float) -> Column:
    """True for about ``share`` of the values of a column, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(STEPS)) < math.ceil(STEPS * share)


#: Edges that one task contracts at once.
FEW_EDGES = 16_000


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected edges of longs: (node, component).

    ``component`` is the smallest node of the component. Each round sends every node
    to the neighbour that comes first in a hashed order of that round and contracts
    the edges; the expected number of rounds is logarithmic. The last FEW_EDGES are
    contracted by one task, which saves the many small rounds at the end. Self links and null ends
    are ignored; no edges give an empty result.
    """
    a, b = F.col(u), F.col(v)
    rest = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    rest = cut(rest.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    found: DataFrame | None = None
    turn = 0
    while n := rest.count():
        turn += 1
        if n <= FEW_EDGES:
            moved = cut(rest.coalesce(1).mapInArrow(_contract, "node long, to long"))
            discard(rest)
            found = moved if found is None else _followed(found, moved)
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)
        ends = rest.select("u", "v").unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = ends.groupBy("u").agg(F.min(order(F.col("v"))).alias("m"))
        moved = cut(
            first.select(
                F.col("u").alias("node"),
                F.when(F.col("m") < order(F.col("u")), F.col("m")["v"]).otherwise(F.col("u")).alias("to"),
            )
        )
        left = join_salted(rest, moved.select(F.col("node").alias("u"), F.col("to").alias("tu")), ["u"], "inner")
        left = join_salted(
            left.select("tu", "v"), moved.select(F.col("node").alias("v"), F.col("to").alias("tv")), ["v"], "inner"
        )
        before = rest
        rest = cut(
            left.filter("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        )
        discard(before)
        found = moved if found is None else _followed(found, moved)
    if found is None:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = found.groupBy("to").agg(F.least(F.min("node"), F.first("to")).alias("component"))
    return join_salted(found, least, ["to"], "inner").select("node", "component")


def _followed(found: DataFrame, moved: DataFrame) -> DataFrame:
    step = moved.select(F.col("node").alias("to"), F.col("to").alias("next"))
    out = cut(join_salted(found, step, ["to"], "left").select("node", F.coalesce("next", "to").alias("to")))
    discard(found, moved)
    return out


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node's edges (u, v) reach."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if ends:
        nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in place.reshape(2, -1).T.tolist():
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(nodes))])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "to"])


class Forest:
    """Union of small integer ranges inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if i and j were apart."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Apply ``run(key, table) -> record batch or None`` to every group of long keys.

    Groups must be bounded. Unlike a grouped map this costs little for each group:
    a task reads its sorted rows as a stream and cuts it where a key changes.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = run(last, pa.Table.from_batches(held))
                if out is not None and out.num_rows:
                    yield out
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(c[a] for c in columns)
                if key != last:
                    yield from flush()
                    last = key
                held.append(batch.slice(a, b - a))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def blocks(members: DataFrame, group: str, n_blocks: str, node: str) -> DataFrame:
    """Rows of every group dealt into its blocks, repeated for each pair of blocks.

    Adds ``pair`` (a long for the two blocks) and ``block`` (the row's own). All pairs of
    a group's rows meet in exactly one pair of blocks, or in each block's pair with
    itself.
    """
    n = F.col(n_blocks).cast("int")
    own = F.pmod(F.xxhash64(F.lit(33), F.col(node)), n).cast("int")
    rows = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other").cast("long")
    return rows.withColumn("pair", low * F.lit(1 << 31) + high).drop("other")
