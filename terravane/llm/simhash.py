"""SimHash near-duplicates (operator 4): pivot distance tables discard pairs before exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.storage import files_for, remove, written
from terravane.llm.tokens import rows_of

#: Words of a shingle, seed of its hash, and the most differing bits of a link.
WORDS, SEED, RADIUS = 4, 42, 4
#: Parts of a fingerprint. Two fingerprints within RADIUS agree in at least SEGMENTS - RADIUS of them.
SEGMENTS = RADIUS + 2
#: Shingles that are hashed before their bits are counted.
BLOCK = 1 << 15
#: Groups up to this size are compared by offsets, all at once; larger ones from member to member.
SMALL = 16
#: Groups beyond this size are divided by further segments of the bits that do not yet agree, inside a task; beyond GROUP rows they
#: are dealt to other tasks.
DIVIDE, GROUP = 4096, 1 << 18

_U = np.uint64


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's four-word shingles, repeats included (A-Z lower-cased, words split at ASCII white space,
    XXH64): a bit is 1 if it is set in over half of the hashes. Fewer words are one shingle; no words give 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = min(len(words), WORDS)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    joined = b" ".join(words)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the signed 64-bit ``fp`` of every whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], [id_column, "fp"])

    rows = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([docs.schema[id_column], T.StructField("fp", T.LongType())]))


# --- links ------------------------------------------------------------------------------------------------------------


#: Reference fingerprints: bit b of the i-th is the parity of i & b (rows of the Hadamard matrix of order 64, its first half), so any
#: two differ in 32 bits. Over the whole matrix the distances of two fingerprints that differ in h bits differ by the root of
#: h on a quadratic mean, so unrelated ones are 5 to 6 apart at a typical reference and far apart at some.
PIVOTS = np.array([sum(1 << b for b in range(64) if (i & b).bit_count() % 2) for i in range(32)], dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint: one row per fingerprint, one byte per reference."""
    out = np.empty((len(fps), len(PIVOTS)), dtype=np.int8)
    for i, p in enumerate(PIVOTS):
        out[:, i] = np.bitwise_count(fps ^ p)
    return out


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: by the triangle inequality none whose tables differ by over RADIUS anywhere can; the
    survivors are verified. References go in blocks, each for those pairs alone that the blocks before left."""
    at = np.arange(len(j))
    one = np.ndim(i) == 0
    for low, high in ((0, 8), (8, 24), (24, len(PIVOTS))):
        x = table[i, low:high] if one else table[i[at], low:high]
        at = at[(np.abs(table[j[at], low:high] - x) <= RADIUS).all(axis=1)]
        if not len(at):
            break
    able = np.zeros(len(j), dtype=bool)
    able[at] = np.bitwise_count(fps[j[at]] ^ (fps[i] if one else fps[i[at]])) <= RADIUS
    return able


def segment_masks(free: int, segments: int = SEGMENTS) -> list[int]:
    """Masks of every choice of segments - RADIUS segments among the bits set in ``free``, dealt out evenly."""
    bits = [b for b in range(64) if free >> b & 1]
    parts = [sum(1 << b for b in bits[len(bits) * k // segments : len(bits) * (k + 1) // segments]) for k in range(segments)]
    return [sum(c) for c in combinations(parts, segments - RADIUS)]


def link_group(fps: np.ndarray, table: np.ndarray, free: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that connect a group's distinct fingerprints as all their links would. All agree outside the bits ``free``;
    ``table`` has their pivot distances."""
    if len(fps) > DIVIDE and free.bit_count() >= 2 * SEGMENTS:
        out = []
        for mask in segment_masks(free):
            key = fps & _U(mask)
            order = np.argsort(key, kind="stable")
            out += [(order[u], order[v]) for u, v in link_sorted(key[order], fps[order], table[order], free & ~mask)]
        return out
    alive, out = np.arange(len(fps)), []
    while len(alive) > 1:
        queue, alive = [alive[0]], alive[1:]
        while queue and len(alive):
            near = _near(fps, table, queue[-1], alive)
            found, alive, last = alive[near], alive[~near], queue.pop()
            queue += found.tolist()
            if len(found):
                out.append((np.concatenate(([last], found[:-1])), found))  # a chain, so that no fingerprint has all the links
    return out


def link_sorted(key: np.ndarray, fps: np.ndarray, table: np.ndarray, free: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, within runs of equal keys."""
    if len(fps) < 2:
        return []
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    out = []
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        out += [(s + u, s + v) for u, v in link_group(fps[s : s + n], table[s : s + n], free)]
    at = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    run = np.repeat(np.arange(len(size)), size)[at]
    for lag in range(1, min(SMALL, len(at))):
        i = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(i):
            break
        i = i[_near(fps, table, at[i], at[i + lag])]
        out.append((at[i], at[i + lag]))
    return out


def _link_partition(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    """Rows (free, key, fp, unnamed, least, table), sorted: each run of a key is a group, whose rows agree outside the bits ``free``; the
    last run of a batch waits for the next batch. Links come with the names of both sides. Of a group beyond ``group`` rows, which no
    task should hold, the rows come back alone (v is null) with their ``free``, to be dealt on."""
    names = ["free", "u_unnamed", "u_least", "u", "v_unnamed", "v_least", "v"]

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        free, key, fps = (rows.column(i).to_numpy().view(np.uint64) for i in range(3))
        table, named = _tables(rows.column(5)), [rows.column(i).combine_chunks() for i in (3, 4, 2)]
        for f in np.unique(free):
            own = np.flatnonzero(free == f)
            for u, v in link_sorted(key[own], fps[own], table[own], int(f)):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), *(n.take(pa.array(own[x])) for x in (u, v) for n in named)], names)

    def alone(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [b.column(i) for i in (3, 4, 2)]
        return pa.RecordBatch.from_arrays([b.column(0), *own, *(pa.nulls(b.num_rows, c.type) for c in own)], names)

    group_of = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
    held: list[pa.RecordBatch] = []
    too_large = None  # the group whose first rows were given back
    for b in batches:
        if too_large is not None and b.num_rows:
            at = np.flatnonzero((b.column(0).to_numpy() != too_large[0]) | (b.column(1).to_numpy() != too_large[1]))
            cut = int(at[0]) if len(at) else b.num_rows
            yield alone(b.slice(0, cut))
            b = b.slice(cut)
        if not b.num_rows:
            continue
        too_large = None
        held.append(b)
        if group_of(held[0], 0) != group_of(b, b.num_rows - 1):  # else it is still one group
            rows = pa.Table.from_batches(held)
            free, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cut = int(np.flatnonzero((free != free[-1]) | (key != key[-1]))[-1]) + 1
            yield from links(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if sum(x.num_rows for x in held) > group and int(held[0].column(0)[0].as_py() & (1 << 64) - 1).bit_count() >= 2 * SEGMENTS:
            too_large = group_of(held[0], 0)
            yield from map(alone, held)
            held = []
    if held:
        yield from links(pa.Table.from_batches(held))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (free, unnamed, least, fp, table) of groups that were too large, once for each choice among the segments of their free bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b in batches:
        free, fps = b.column(0).to_numpy(), b.column(3).to_numpy()
        for f in np.unique(free):
            own = b.take(pa.array(np.flatnonzero(free == f)))
            for mask in segment_masks(int(f) & (1 << 64) - 1):
                key = fps[free == f] & np.int64(signed(~int(f) & (1 << 64) - 1 | mask))
                left = np.full(len(key), signed(int(f) & (1 << 64) - 1 & ~mask), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(key), own.column(3), own.column(1), own.column(2), own.column(4)], ["free", "key", "fp", "unnamed", "least", "table"])


def _tables(column: pa.ChunkedArray) -> np.ndarray:
    """Binaries of one byte per reference as a matrix."""
    column = pa.concat_arrays(column.chunks)
    width, (_, offsets, data) = "<i8" if pa.types.is_large_binary(column.type) else "<i4", column.buffers()
    first = int(np.frombuffer(offsets, width)[column.offset])
    return np.frombuffer(data, np.int8, len(column) * len(PIVOTS), first).reshape(-1, len(PIVOTS))


def with_tables(classes: DataFrame) -> DataFrame:
    """The column ``table``: the pivot distances of ``fp``, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pivot_table(b.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*b.schema.names, "table"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("table", T.BinaryType())]))


def links_between(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (u, v) between classes (fp, least) that connect them exactly as all pairs within RADIUS would. u and v are nodes: structs
    (unnamed, least, fp), which are ordered by the smallest id of a class, null last.

    No choice of references fetches few candidates: unrelated fingerprints are all about 32 bits from each of them. So
    pairs come from groups that agree in two of six segments, which every linked pair does for one of the 15 choices. In a
    group, pairs are discarded by their pivot tables, which are computed once for each class and come with its rows, and the
    rest verified. Groups are walked from member to member, so a group of n near copies gives n - 1 links. A group beyond
    ``group`` rows is dealt on by the segments of the bits in which its rows may still differ, as often as it takes: three
    rounds leave too few bits for a large group, as a group's fingerprints are distinct.
    """
    every = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    choices = [F.struct(F.lit(signed(every & ~m)).alias("free"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in segment_masks(every)]
    rows = with_tables(classes).select("fp", F.col("least").isNull().alias("unnamed"), "least", "table", F.explode(F.array(*choices)).alias("k")).select("k.free", "k.key", "fp", "unnamed", "least", "table")
    kind = classes.schema["least"].dataType.simpleString()
    side = lambda x: f"{x}_unnamed boolean, {x}_least {kind}, {x} long"
    node = lambda x: F.struct(F.col(f"{x}_unnamed").alias("unnamed"), F.col(f"{x}_least").alias("least"), F.col(x).alias("fp"))
    links = None
    while True:
        found, _ = written(rows.repartition("free", "key").sortWithinPartitions("free", "key").mapInArrow(lambda b: _link_partition(b, group), f"free long, {side('u')}, {side('v')}"), "links")
        own = found.filter("v IS NOT NULL").select(node("u").alias("u"), node("v").alias("v"))
        links = own if links is None else links.unionByName(own)
        large = found.filter("v IS NULL")
        if large.isEmpty():
            return links
        again = with_tables(large.select("free", F.col("u_unnamed").alias("unnamed"), F.col("u_least").alias("least"), F.col("u").alias("fp")))
        rows = again.mapInArrow(_deal, f"free long, key long, fp long, unnamed boolean, least {kind}, table binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the smallest node that is reachable.

    Alternating large-star and small-star steps: each joins the edges with the smallest neighbour of every node, so the
    number of edges never grows beyond their first count and no neighbourhood is gathered. Every step is written to the
    shared folder, the smallest neighbours too: a join of two written tables is one whose skewed partitions, such as the
    edges of a hub, Spark splits. Files are as many as edges ask for. It ends when a round changes nothing.
    """
    spark = edges.sparkSession

    e, path = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    files, before = files_for(e.count()), None

    def smallest(e: DataFrame, with_self: bool) -> tuple[DataFrame, str]:
        m = F.min("b")
        return written(e.groupBy("a").agg((F.least(F.col("a"), m) if with_self else m).alias("m")), "smallest", files=files)

    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = smallest(both, True)
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = written(large.filter("a <> b").distinct(), "large-star", files=files)
        least, least_path = smallest(large, False)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star, star_path = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star", files=files)
        for done in (path, low_path, large_path, least_path):
            remove(spark, done)
        e, path = star, star_path
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _named_classes(prints: DataFrame, least: Column) -> DataFrame:
    """(fp, least, name) of each class of equal fingerprints in ``prints``: its smallest ``least`` and that of its component,
    written down. Classes are partial minima, so a class of many copies meets in no task."""
    classes = prints.groupBy("fp").agg(F.min(least).alias("least"))
    nodes = connected_components(links_between(classes)).select(F.col("node.fp").alias("of"), F.col("root.least").alias("root"), F.lit(True).alias("found"))
    joined = classes.join(nodes, F.col("fp") == F.col("of"), "left")  # the root is the node of the smallest id, so it is the name
    return written(joined.select("fp", "least", F.when(F.col("found"), F.col("root")).otherwise(F.col("least")).alias("name")), "classes")[0]


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Each text is read once; from then on only (id, fingerprint) rows move. Equal fingerprints are one class, so copies
    neither meet in a join of pairs nor in one task; a component is named by its root. The last join is of two written
    tables, whose skewed partitions Spark splits. Null and wordless texts have fingerprint 0 and link like any other; null
    ids have the component of their class and are never its name while another id is there; rows with equal ids stay; other
    columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    prints, _ = written(fingerprints(rows), "simhash")
    named = _named_classes(prints, F.col("doc_id")).select("fp", F.col("name").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (null ids last, then the
    first row), with all its columns. Rows are numbered in a written copy, so null and repeated ids do no harm; a class's best
    row is a partial minimum and components are named by it, so no join is on fingerprints of all rows."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    rows, _ = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    texts = rows.select(F.struct(F.col(id_column).isNull().alias("unnamed"), F.col(id_column).alias("id"), F.col(name).alias("row")).alias("rank"), F.col(text_column).alias("text"))
    prints, _ = written(fingerprints(texts, id_column="rank"), "simhash")
    best = _named_classes(prints, F.col("rank")).filter("least = name").select(F.col("least.row").alias(name))
    return rows.join(best.hint("merge"), name, "left_semi").select(*docs.columns)  # grows with the corpus: never sent to all tasks
