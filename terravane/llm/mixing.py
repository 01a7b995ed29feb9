"""Mixing sources to target weights (operator 3): a multivariate-hypergeometric splitting tree over output shards."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.storage import written
from terravane.operators.shared import placed

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Words of the mix over all words, and the most times that a word is taken.
SHARE, REPEATS = 1.5, 2
#: Words of a block; output shards; blocks that a hash bucket of a source holds on average, as all are in one sort.
BLOCK_WORDS, SHARDS, BUCKET_BLOCKS = 256, 64, 1 << 14
#: Words of a run of a shard: rows of a run lie in one task and one file.
RUN_WORDS = 1 << 22
#: Populations below this are drawn by numpy's generator, whose limit it is.
SMALL = 10**9
#: Sources that the driver holds a number or two of. More are refused: a source is a name for a collection, not a key.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: float = REPEATS) -> list[float]:
    """Shares of ``total`` by weight; a target stops at ``repeats`` times its source's size and the excess is shared again by
    weight among the others, until none is above."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > repeats * sizes[i]}
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def _log_rising(k: int, d: int) -> float:
    """ln((k + d)! / k!), without the cancellation that the difference of two large logarithms has."""
    if d < 0:
        return -_log_rising(k + d, -d)
    if k < 1 << 16:
        return math.lgamma(k + d + 1) - math.lgamma(k + 1)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x**3)  # noqa: E731  Stirling's series; the next term is below 1e-27 here
    return d * math.log(k) + (k + d + 0.5) * math.log1p(d / k) - d + rest(k + d) - rest(k)


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good ones among n drawn without replacement from good + bad, at any size: by numpy's generator below its limit, else
    by rejection from the same law (ratio of uniforms around the mode)."""
    low, high, total = max(0, n - bad), min(good, n), good + bad
    if low == high:
        return low
    if total < SMALL:
        return int(rng.hypergeometric(good, bad, n))
    mode = (good + 1) * (n + 1) // (total + 2)
    p = good / total
    centre = n * p + 0.5
    # fixed values: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), the hat of a unimodal law of this variance
    width = math.sqrt(n * p * (1 - p) * (total - n) / (total - 1) + 0.5) * 1.7155277699214135 + 0.8989161620588988
    while True:
        u = 1.0 - rng.random()
        x = centre + width * (rng.random() - 0.5) / u
        if not low <= x < high + 1:
            continue
        k = int(x)
        d = k - mode
        log_ratio = -_log_rising(mode, d) - _log_rising(good - mode, -d) - _log_rising(n - mode, -d) - _log_rising(bad - n + mode, d)
        if 2 * math.log(u) <= log_ratio:
            return k


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard: rows are sources and add up to their quotas exactly, columns differ by one at most.

    The node of shards [a, b) deals its blocks to its two halves: how many of each source go left is a draw without
    replacement from the node's blocks. A node's generator depends on the seed and the node alone.
    """
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    todo = [(0, shards, [int(q) for q in quotas])]
    while todo:
        a, b, own = todo.pop()
        if b - a == 1:
            out[:, a] = own
            continue
        mid, total = (a + b) // 2, sum(own)
        start = np.array([a, mid, b], dtype=object)
        whole = sum(int(q) for q in quotas)
        edges = [int(x) * whole // shards for x in start]  # blocks before each of the three shards
        n, left, rest = edges[1] - edges[0], [], total
        rng = np.random.Generator(np.random.PCG64([seed, a, b]))
        for q in own:
            k = _hypergeometric(q, rest - q, n, rng)
            left.append(k)
            n, rest = n - k, rest - q
        todo += [(a, mid, left), (mid, b, [q - k for q, k in zip(own, left, strict=True)])]
    return out


def _sources(rows: DataFrame, weights: Sequence[float], share: float, repeats: int) -> list[dict]:
    """Sizes and targets by source, in code point order, null last."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = [int(r["size"]) for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), repeats)
    return [{"number": i, "source": r["source"], "source_size": s, "blocks": int(r["blocks"]), "target": t} for i, (r, s, t) in enumerate(zip(found, sizes, aims, strict=True))]


def mix_sources(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    row_column: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block_words: int | None = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Draw a mix of sources. Returns the documents (row, doc_id, source, size, source_size, target) and the mix's blocks.

    A document is cut into blocks of ``block_words`` words (None: it is one block). A source's blocks are put into a random
    order, by a hash of seed, document and block, and go round as often as its target asks; where the target ends, the last
    block is cut (a whole document, if ``block_words`` is None, is taken if its middle is inside). The splitting tree deals
    each source's blocks out to the shards: shard k takes the next run of them, so draws are disjoint. In a shard blocks
    are ordered by another hash. Block rows: row, doc_id, block, pass, start (in words), words, shard, order. Documents are
    numbered in ``row``, or by the column ``row_column``.

    Texts are read once, to count words. What is hashed is a document's place among all, by id and text: rows with equal or
    null ids have places of their own, so no bucket gathers them, and reruns agree. Blocks are ordered inside ranges of
    their hash, as many as blocks ask for, so no source meets in one task and the number of ranges changes no order;
    per-source sums are the only rows at the driver.

    Null texts have no words and no blocks. Null sources are one source, the last. Null and repeated ids stay separate
    documents. Other columns are ignored. Sources without words have target 0. An empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = F.col(row_column) if row_column else F.monotonically_increasing_id()
    sized = docs.select(own.alias("row"), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    per = F.lit(block_words).cast("long") if block_words else F.greatest(F.col("size"), F.lit(1).cast("long"))
    sized, _ = written(sized.withColumn("blocks", F.ceil(F.col("size") / per).cast("long")), "sizes")
    mixed_id = F.xxhash64("doc_id", "text_hash")
    rows = placed(sized, [], [mixed_id.asc(), F.col("doc_id").asc(), F.col("source").asc(), F.col("row").asc()], "key", "all").drop("all", "text_hash")
    known = _sources(rows, weights, share, repeats)
    plan, passes = [], 0
    for s in known:
        full, rest = divmod(round(s["target"]), s["source_size"]) if s["source_size"] else (0, 0)
        plan.append((s["number"], s["source"], s["source_size"], s["target"], int(full), int(rest), s["blocks"]))
        passes = max(passes, full + bool(rest))
    table = spark.createDataFrame(plan, "number int, name string, source_size long, target double, full int, rest long, source_blocks long")
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")))  # at most MAX_SOURCES rows

    bits = max(6, (sum(s["blocks"] for s in known) // BUCKET_BLOCKS).bit_length())
    blocks = rows.filter("blocks > 0").select("number", "row", "key", "doc_id", "size", "full", "rest", "source_blocks", per.alias("per"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = blocks.withColumn("hash", F.xxhash64(F.lit(seed), "key", "block")).withColumn("words", F.least(F.col("per"), F.col("size") - F.col("block") * F.col("per")))
    blocks = blocks.withColumn("bucket", F.shiftright("hash", 64 - bits))
    sums = blocks.groupBy("number", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("number").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("number", "bucket").orderBy("hash", "key", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumns({"before": F.coalesce(F.sum("words").over(inside), F.lit(0)), "rank": F.count("*").over(inside)})
    ranked = ranked.join(sums, (F.col("number") == F.col("of")) & (F.col("bucket") == F.col("at")))
    ranked = ranked.withColumns({"before": F.col("before") + F.col("w0"), "rank": F.col("rank") + F.col("n0")})
    if block_words:
        last = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("before")))
    else:
        last = F.when(F.col("before") + F.col("words") / 2 <= F.col("rest"), F.col("words")).otherwise(F.lit(0).cast("long"))
    drawn = ranked.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(passes - 1, 0)))))
    drawn = drawn.withColumn("taken", F.when(F.col("pass") < F.col("full"), F.col("words")).when(F.col("pass") == F.col("full"), last).otherwise(0).cast("long"))
    drawn = drawn.filter("taken > 0").select(
        "number", "row", "key", "doc_id", "block", "pass", (F.col("block") * F.col("per")).alias("start"), F.col("taken").alias("words"), (F.col("pass") * F.col("source_blocks") + F.col("rank")).alias("unit")
    )
    units, _ = written(drawn, "mix")
    quota = {r["number"]: r["n"] for r in units.groupBy("number").agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum(splitting_tree([quota.get(i, 0) for i in range(len(known))], shards, seed), axis=1)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, unit = b.column("number").to_numpy(), b.column("unit").to_numpy()
            to = np.zeros(len(unit), dtype=np.int32)
            for s in np.unique(number):
                to[number == s] = np.searchsorted(ends[s], unit[number == s], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns[1:8], pa.array(to)], [*b.schema.names[1:8], "shard"])

    id_type, row_type = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "row"))
    mixed = units.mapInArrow(shard, f"row {row_type}, key long, doc_id {id_type}, block long, pass int, start long, words long, shard int")
    mixed = mixed.withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "block", "pass")).drop("key")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target"), mixed


def taken_by_document(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of the mix, repeats counted), shards (that hold a part)."""
    sums = mixed.groupBy("row").agg(F.sum("words").alias("taken"), F.count_distinct("shard").cast("int").alias("shards"))
    zero = F.lit(0).cast("long")
    joined = rows.join(sums, "row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"))


def mix_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", run_words: int = RUN_WORDS, **options) -> DataFrame:
    """The mix as rows of whole documents with the columns of ``docs``: a document comes once for each pass that takes it. Each
    shard's rows come in their random order, cut into runs of about ``run_words`` words, so a task's part does not grow with
    the corpus; the partitions are the runs of shard 0, then of shard 1 and so on. Rows are numbered in a written copy, so
    repeated ids do no harm."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    copy, _ = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    _, mixed = mix_sources(copy, id_column=id_column, text_column=text_column, source_column=source_column, row_column=name, block_words=None, **options)
    shards = options.get("shards", SHARDS)
    words = mixed.agg(F.sum("words")).first()[0] or 0
    runs = max(1, -(-words // (shards * run_words)))
    share = F.col("order") / F.lit(2.0**64) + 0.5  # the order is a 64-bit hash: equal parts of its range hold like numbers of rows
    run = F.col("shard") * runs + F.least(F.floor(share * runs), F.lit(runs - 1)).cast("int")
    places = mixed.select(F.col("row").alias(name), run.alias(name + "s"), F.col("order").alias(name + "o"))
    joined = copy.join(places.hint("merge"), name)  # the places grow with the corpus, so they are never sent to all tasks
    return joined.repartitionById(shards * runs, F.col(name + "s")).sortWithinPartitions(name + "o").select(*docs.columns)
