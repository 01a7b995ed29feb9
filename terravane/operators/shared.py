"""Intermediate tables in the shared folder, places in an order, quantiles and connected components, none of which gather a group in a task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``. Where none is set, a session on one
    machine gets a new one; on a cluster that is an error, as no local folder is seen by all."""
    root = spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terravane-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems; absent folders and stopped sessions are ignored."""
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends: a result may read it until then."""

    def late() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(late)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/listings-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether all pairs are equal, nulls included."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[Column], place: str = "place", total: str = "total") -> DataFrame:
    """Columns ``place`` (from 1, in the order inside the group) and ``total`` (rows of the group). The order should be total.

    A window would sort a whole group in one task. Here rows are range-partitioned by group and order, so a large group spans
    partitions; a row's place is its number in its partition and group plus the group's rows in earlier partitions. Only
    those counts, one for each partition and group, meet. Groups of null are one group; no groups is one group of all rows.
    """
    keys = [F.col(g).asc() for g in groups] + list(order)
    index = F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_index": index}).drop("_at")
    sums = rows.groupBy("_part", *groups).agg(F.min("_index").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*groups)  # a row for each partition that has the group
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(
        F.col("_part").alias("_of"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(own).alias(total)
    )
    joined = rows.join(sums, (F.col("_part") == F.col("_of")) & same([(F.col(g), F.col(f"_g{i}")) for i, g in enumerate(groups)]))
    return joined.withColumn(place, F.col("_index") + F.col("_shift")).select(*df.columns, place, total)


#: Relative error of the ranks that bracket a quantile, and the half width of the bracket.
ACCURACY, MARGIN = 10_000, 2e-4


def quantiles(df: DataFrame, groups: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(groups, q0, q1 ..): exact quantiles of a value by group, between two values in proportion; nulls don't count, a group of nulls
    has no row. No groups give one row.

    An exact percentile keeps every distinct value of a group in one task. Here approximate ones, whose error is bounded,
    bracket each quantile first; then rows below a bracket are counted, and those inside it, some ten-thousandths of all,
    counted by value. Both are partial sums, and only the values inside brackets meet.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), value.cast("double").alias("_v"))
    ends = [min(max(p + e, 0.0), 1.0) for p in shares for e in (-MARGIN, MARGIN)]
    known = F.count("_v").alias("_n")
    brackets = rows.groupBy(*names).agg(known, F.percentile_approx("_v", ends, ACCURACY).alias("_ends"))
    one = F.array(*(F.struct(F.lit(i).alias("i"), F.col("_ends")[2 * i].alias("lo"), F.col("_ends")[2 * i + 1].alias("hi"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank")) for i, p in enumerate(shares)))
    brackets = brackets.select(*(F.col(n).alias(f"{n}b") for n in names), F.explode(one).alias("_b"))
    on = [F.col(n).eqNullSafe(F.col(f"{n}b")) for n in names]
    both = rows.filter("_v IS NOT NULL").join(brackets, on) if names else rows.filter("_v IS NOT NULL").join(F.broadcast(brackets))  # a row per share
    zone = F.when(F.col("_v") < F.col("_b.lo"), -1).when(F.col("_v") > F.col("_b.hi"), 1).otherwise(0)
    counted = both.groupBy(*names, F.col("_b.i").alias("_i"), zone.alias("_zone"), F.when(zone == 0, F.col("_v")).alias("_in"))
    counted = counted.agg(F.count("*").alias("_k"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_b.rank").alias("_rank"))
    own = Window.partitionBy(*names, "_i").orderBy("_zone", "_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed_ = counted.withColumn("_to", F.sum("_k").over(own))  # the rows below, each value inside, the rows above
    # places from 0: of a run of rows the last below the bracket and the first above it are known
    first = F.when(F.col("_zone") < 0, F.col("_to") - 1).otherwise(F.col("_to") - F.col("_k"))
    last = F.when(F.col("_zone") > 0, first).otherwise(F.col("_to") - 1)
    stands = F.when(F.col("_zone") < 0, F.col("_max")).otherwise(F.col("_min"))
    at = lambda place: F.max(F.when(place.between(first, last), stands))
    low, part = F.floor("_rank"), F.col("_rank") - F.floor("_rank")
    found = placed_.groupBy(*names, "_i").agg(at(low).alias("_a"), at(F.ceil("_rank")).alias("_c"), F.max(part).alias("_part"))
    found = found.withColumn("_q", F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_part")))
    wide = found.groupBy(*names).agg(*(F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(shares))))
    if not names:
        return wide
    return wide.select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), *(f"q{i}" for i in range(len(shares))))


#: Buckets between whose ends values are counted first.
BUCKETS = 256


def bucket_ends(df: DataFrame, value: Column) -> list[float]:
    """Where buckets of about equal counts end. They decide how many values meet in ``quantiles_of_sets``, never its result, so a part of
    the rows may settle them."""
    found = df.select(value.cast("double").alias("_v")).filter("abs(_v) < double('infinity')")
    ends = found.agg(F.percentile_approx("_v", [k / BUCKETS for k in range(1, BUCKETS)], ACCURACY)).first()[0]
    return sorted(set(ends or [0.0]))


def members(bits: Column, sets: int) -> Column:
    """The sets that a row is in, as an array: those whose bit is set."""
    return F.filter(F.sequence(F.lit(0), F.lit(sets - 1)), lambda k: F.getbit(bits, k) == 1)


def quantiles_of_sets(df: DataFrame, levels: Sequence[Sequence[str]], value: Column, shares: Sequence[float], ends: Sequence[float], bits: Column | None = None, sets: int = 1) -> list[DataFrame]:
    """For each level, a list of groups: (groups, set, n, q0, q1 ..), the quantiles that ``quantiles`` finds by these groups among the rows
    of each set; rows may be in many sets, bit k of ``bits`` tells whether in set k. Groups of null are a group.

    Two passes serve all levels, sets and shares: rows are counted by the finest groups, bits and bucket, from which the counts of
    every level and set add up; then the values of the buckets that hold an asked place are counted one by one.
    """
    names = {g: f"_g{i}" for i, g in enumerate(dict.fromkeys(g for level in levels for g in level))}
    keys = list(names.values())
    rows = df.select(*(F.col(g).alias(n) for g, n in names.items()), value.cast("double").alias("_v"), (F.lit(1) if bits is None else bits).cast("long").alias("_bits"))
    rows = Bucketizer(splits=[-np.inf, *ends, np.inf], inputCol="_v", outputCol="_b", handleInvalid="keep").transform(rows.filter("_v IS NOT NULL AND _bits <> 0"))
    rows = rows.withColumn("_b", F.col("_b").cast("int"))
    cells = cut(rows.groupBy(*keys, "_bits", "_b").agg(F.count("*").alias("_k")))

    def by_level(table: DataFrame, *columns: str) -> DataFrame:
        out = None
        for i, level in enumerate(levels):
            own = table.filter(F.getbit("_need", F.lit(i)) == 1) if "_need" in table.columns else table
            own = own.select(F.lit(i).alias("_l"), *((F.col(n) if g in level else F.lit(None).cast(table.schema[n].dataType)).alias(n) for g, n in names.items()), *columns, "_k", F.explode(members(F.col("_bits"), sets)).alias("_s"))
            out = own if out is None else out.unionByName(own)
        return out

    whole = Window.partitionBy("_l", *keys, "_s")
    counted = by_level(cells, "_b").groupBy("_l", *keys, "_s", "_b").agg(F.sum("_k").alias("_k")).withColumns({"_to": F.sum("_k").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.sum("_k").over(whole)})
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank")) for i, p in enumerate(shares))))
    holds = lambda place: place.between(F.col("_to") - F.col("_k"), F.col("_to") - 1)
    asked = counted.select("_l", *keys, "_s", "_b", "_k", "_to", "_n", ranks.alias("_r")).filter(holds(F.floor("_r.rank")) | holds(F.ceil("_r.rank")))
    asked = cut(asked.select("_l", *keys, "_s", "_b", "_n", (F.col("_to") - F.col("_k")).alias("_before"), "_r.i", "_r.rank"))

    found, need = cells.select(*keys, "_b").distinct(), None
    for i, level in enumerate(levels):
        own = asked.filter(F.col("_l") == i).select(*(F.col(names[g]).alias(f"{names[g]}_of") for g in level), F.col("_b").alias("_b_of")).distinct()
        own = found.join(own, same([(F.col(names[g]), F.col(f"{names[g]}_of")) for g in level]) & (F.col("_b") == F.col("_b_of"))).select(*keys, "_b", F.lit(1 << i).alias("_bit"))
        need = own if need is None else need.unionByName(own)
    need = cut(need.groupBy(*(F.col(k).alias(f"{k}_of") for k in keys), F.col("_b").alias("_b_of")).agg(F.sum("_bit").alias("_need")))
    kept = rows.join(need, same([(F.col(k), F.col(f"{k}_of")) for k in [*keys, "_b"]]))
    kept = cut(kept.groupBy(*keys, "_bits", "_b", "_need", "_v").agg(F.count("*").alias("_k")))

    one = ["_l", *keys, "_s", "_b"]
    places = asked.select(*(F.col(c).alias(f"{c}_of") for c in one), "_n", "_before", "i", "rank")
    both = by_level(kept, "_b", "_v").join(places, same([(F.col(c), F.col(f"{c}_of")) for c in one]))
    own = Window.partitionBy(*one, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_to", F.col("_before") + F.sum("_k").over(own))
    at = lambda place: F.max(F.when(holds(place), F.col("_v")))
    part = F.col("rank") - F.floor("rank")
    ranked = both.groupBy("_l", *keys, "_s", "i").agg(F.max("_n").alias("n"), at(F.floor("rank")).alias("_a"), at(F.ceil("rank")).alias("_c"), F.max(part).alias("_part"))
    ranked = ranked.withColumn("_q", F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_part")))
    wide = cut(ranked.groupBy("_l", *keys, "_s").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(shares)))))
    return [wide.filter(F.col("_l") == i).select(*(F.col(names[g]).alias(g) for g in level), F.col("_s").alias("set"), "n", *(f"q{j}" for j in range(len(shares)))) for i, level in enumerate(levels)]


#: Edges that one task connects at most.
EDGES = 1 << 22


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, group) of the ids in edges (a, b) of one task: roots hang below the smallest root that an edge reaches, until none does."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    both = pc.dictionary_encode(pa.chunked_array(table["a"].chunks + table["b"].chunks)).combine_chunks()
    both = both if isinstance(both, pa.DictionaryArray) else both.chunk(0)
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[both.indices.to_numpy()]
    a, b, root = code[: table.num_rows], code[table.num_rows :], np.arange(len(order))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    ids = both.dictionary.take(order)
    for at in range(0, len(order), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([ids[part], ids.take(root[part])], names=["id", "group"])


def components(pairs: DataFrame) -> DataFrame:
    """(id, group) of the ids in ``pairs`` (a, b), the group being the smallest id that pairs reach. Null ids have no pair.

    An id whose only edge leads to a smaller one takes that one's group and is set aside. If at most EDGES edges are left, one task
    connects them. Else each round hangs the larger neighbours of every node below its smallest one, then the smaller ones;
    the edges never become more, no neighbourhood is gathered, and the number of rounds grows with the logarithm of a component's width.
    """
    every = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = every.select(F.col("a").alias("end"), F.lit(1).alias("up")).unionByName(every.select(F.col("b").alias("end"), F.lit(0).alias("up")))
    outer = ends.groupBy("end").agg(F.count("*").alias("n"), F.max("up").alias("up")).filter("n = 1 AND up = 1").select("end")
    marked = cut(every.join(outer, F.col("a") == F.col("end"), "left").select("a", "b", F.col("end").isNotNull().alias("outer")))
    inner, outer = _rooted(marked.filter("NOT outer").select("a", "b")), marked.filter("outer")
    joined = outer.join(inner.select(F.col("id").alias("_of"), "group"), F.col("b") == F.col("_of"), "left")
    alone = joined.filter("_of IS NULL").select(F.col("b").alias("id"), F.col("b").alias("group")).distinct()
    return cut(inner.unionByName(joined.select(F.col("a").alias("id"), F.coalesce("group", "b").alias("group"))).unionByName(alone))


def _rooted(edges: DataFrame) -> DataFrame:
    """(id, group) of the ids in edges (a, b) with a > b."""
    if edges.count() <= EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInArrow(_connected, f"id {kind}, group {kind}"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        upper = cut(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = upper.groupBy("a").agg(F.min("b").alias("low"))
        lower = upper.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(lower.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("id")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("group")).unionByName(roots.select("id", F.col("id").alias("group")))
        before = now
