"""Packing documents into sequences (operator 1): dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terravane.llm.storage import written
from terravane.llm.tokens import encoder, rows_of

#: A way to fill a sequence, as (length, how many) runs, and in how many sequences it is used.
Pattern = tuple[tuple[tuple[int, int], ...], int]


class Histogram:
    """Pieces by length: at most ``capacity`` distinct lengths, whatever the corpus."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {w: n for w, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def largest(self, room: int) -> int:
        """The largest length of at most ``room``; 0 if there is none."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest pieces' lengths."""
        out: list[int] = []
        for w in self.sizes[:n]:
            out += [w] * min(self.count[w], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int]:
        """The largest sum of two pieces of at most ``room``, and the largest that the smaller piece of such a pair can be."""
        s = np.array(self.sizes)
        single = np.array([self.count[w] < 2 for w in self.sizes])
        i = np.searchsorted(s, room - s, side="right") - 1
        i = np.where((i == np.arange(len(s))) & single, i - 1, i)
        ok = i >= 0
        if not ok.any():
            return 0, 0
        other = s[i[ok]]
        return int((s[ok] + other).max()), int(np.minimum(s[ok], other).max())


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix sets that provably dominate every other set with their largest piece; return them and what is left.

    A set dominates another if the other's pieces can be dealt to its own places without exceeding any of them. For a
    piece w, with room = capacity - w and i the largest piece that fits beside it, the sets tested are: {w} if nothing
    fits; {w, i} if it fills the sequence, if no two pieces fit beside w, or if no fitting pair is longer than i;
    {w, i, b} with b the largest that fits beside both, if no three pieces fit beside w and the smaller piece of no
    fitting pair exceeds b. Each condition still holds after the set is taken out, so it is fixed as often as its pieces
    allow at once.
    """
    h, fixed = Histogram(counts), []

    def fix(*pieces: int) -> None:
        need = {w: pieces.count(w) for w in dict.fromkeys(pieces)}
        times = min(h.count[w] // n for w, n in need.items())
        for w, n in need.items():
            h.take(w, n * times)
        fixed.append((tuple(need.items()), times))

    for w in sorted(counts, reverse=True):
        room = capacity - w
        while h.count.get(w):
            h.take(w, 1)  # what may stand beside one piece w
            i, low = h.largest(room), h.smallest(3)
            pair, smaller = (0, 0) if not i or sum(low[:2]) > room else h.best_pair(room)
            h.count[w] = h.count.get(w, 0) + 1
            if h.count[w] == 1:
                insort(h.sizes, w)
            two = len(low) > 1 and sum(low[:2]) <= room
            three = len(low) > 2 and sum(low) <= room
            if not i:
                fix(w)
            elif i == room or not two or (not three and pair <= i):
                fix(w, i)
            elif not three and (b := _beside(h, w, i, room - i)) and smaller <= b:
                fix(w, i, b)
            else:
                break
    return fixed, dict(h.count)


def _beside(h: Histogram, w: int, i: int, room: int) -> int:
    """The largest piece of at most ``room`` when one w and one i are taken; 0 if there is none."""
    used = {x: (x == w) + (x == i) for x in (w, i)}
    at = bisect_right(h.sizes, room)
    while at:
        at -= 1
        if h.count[h.sizes[at]] > used.get(h.sizes[at], 0):
            return h.sizes[at]
    return 0


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of pieces in descending length. Sequences with equal rest are handled together, so the work follows the
    number of distinct lengths, not of pieces."""
    groups: dict[int, list[Pattern]] = {}
    rests: list[int] = []  # sorted keys of groups

    def put(rest: int, pattern: tuple, times: int) -> None:
        if times:
            if rest not in groups:
                insort(rests, rest)
                groups[rest] = []
            groups[rest].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rests, w)
            rest = rests[at] if at < len(rests) else capacity
            each = rest // w
            pattern, times = groups[rest].pop() if at < len(rests) else ((), -(-n // each))
            if at < len(rests) and not groups[rest]:
                del groups[rest], rests[at]
            full = min(times, n // each)
            put(rest - each * w, (*pattern, (w, each)), full)
            n -= full * each
            if full < times:
                if n:  # the last few do not fill one more sequence
                    put(rest - n * w, (*pattern, (w, n)), 1)
                put(rest, pattern, times - full - bool(n)) if pattern else None
                n = 0
    return [p for group in groups.values() for p in group]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all pieces: those fixed by dominance, then best fit of the rest."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError("a piece must have 1 to capacity ids")
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the r-th piece of a length goes. Each pattern's run of a length takes an interval of that length's ranks."""

    SHIFT = 44  # bits for a rank

    def __init__(self, patterns: list[Pattern]) -> None:
        given: dict[int, int] = {}
        rows, sequence = [], 0
        for runs, times in patterns:
            offset = 0
            for w, k in runs:
                low = given.get(w, 0)
                rows.append(((w << self.SHIFT) + low, k, sequence, offset))
                given[w] = low + k * times
                offset += w * k
            sequence += times
        rows.sort()
        self.low, self.each, self.sequence, self.offset = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), (), ())))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << self.SHIFT) + rank
        i = np.searchsorted(self.low, key, side="right") - 1
        r = key - self.low[i]
        return self.sequence[i] + r // self.each[i], self.offset[i] + r % self.each[i] * length


def _pieces(tokenizer: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, out = encoder(tokenizer).encode, {}, []
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("piece", "part") else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

        for part, doc, text in rows_of(batches):
            ids = encode(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                n = len(own) // 4
                nth = seen.get(n, 0)
                seen[n] = nth + 1
                out.append((doc, piece, at // 4, n, zlib.crc32(own), part, nth))
            if len(out) >= 8192:
                yield batch()
                out = []
        if out:
            yield batch()

    return cut


PIECE_SCHEMA = T.StructType(
    [T.StructField(n, T.IntegerType() if n in ("piece", "part") else T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")]
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; only longer documents are cut.

    A document is its text's ids and ``end_id``. Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (gapless from 0 in each sequence).

    The texts are read once and never shuffled: each task numbers its pieces of each length. Only the histogram of
    lengths (at most ``capacity`` rows) reaches the driver, which plans patterns for it; a piece finds its place from its
    rank among the pieces of its length. The written piece table fixes the ranks, so that retried tasks agree.

    Null texts count as empty (one id); null and repeated ids are kept as separate documents; other columns are ignored;
    an empty table gives no row.
    """
    rows = docs.select(
        F.spark_partition_id().alias("part"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    pieces, _ = written(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECE_SCHEMA), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan_sequences(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.of(b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequence_lengths(patterns: list[Pattern]) -> list[int]:
    """Ids in one sequence of each pattern."""
    return [list(accumulate((w * k for w, k in runs), initial=0))[-1] for runs, _ in patterns]
