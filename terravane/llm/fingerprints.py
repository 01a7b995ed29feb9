"""Document fingerprints (operator 2): one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terravane.llm.storage import written
from terravane.llm.tokens import by_id, rows_of

#: Words of a shingle, bins of a fingerprint and low-order bits kept of each bin.
WORDS, BINS, BITS = 5, 512, 4
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, CHUNK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)
_PLACE = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes other than ASCII white space), from prefix sums of a polynomial."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):  # end the chunk at a space, unless a word is longer than that
            space = max(data.rfind(bytes([c]), at, end) for c in (32, *range(9, 14)))
            if space < 0:
                return np.array([_long(w) for w in data.split()], dtype=np.uint64)
            end = space + 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[b]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + _U(1)) * _POWER[: len(b)], out=sums[1:])
        out.append(_mix((sums[stop] - sums[start]) * _INVERSE[start]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _long(word: bytes) -> int:
    """The same hash of one word, in pieces: words may exceed a chunk."""
    value, scale = 0, 1
    for i in range(0, len(word), CHUNK):
        b = np.frombuffer(word, np.uint8, min(CHUNK, len(word) - i), i).astype(np.uint64) + _U(1)
        value += int((b * _POWER[: len(b)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_BASE, len(b), 1 << 64) % (1 << 64)
    return int(_mix(np.array([value % (1 << 64)], dtype=np.uint64))[0])


def shingle_hashes(data: bytes) -> np.ndarray:
    """Hashes of all five-word shingles; a text of fewer words is one shingle, a text without words has none."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(len(w), WORDS)
    total = sum((w[i : len(w) - n + 1 + i] * _PLACE[i] for i in range(1, n)), w[: len(w) - n + 1] * _PLACE[0])
    return _mix(total + _U(n))


def _targets(attempt: int) -> np.ndarray:
    """For each bin, the bin that it tries at an attempt: a fixed hash, the same for all documents."""
    x = np.arange(BINS, dtype=np.uint64) + _U(attempt * BINS)
    return (_mix(x * _U(_BASE) + _U(0x2545F4914F6CDD1D)) % _U(BINS)).astype(np.int64)


_TARGETS = [_targets(t) for t in range(1, 65)]


def fingerprint(data: bytes) -> str:
    """Hex of the packed low bits of BINS bins: each shingle hash is put into one bin by its high bits and the smallest
    stays; an empty bin copies the first full bin in its own fixed sequence of bins (optimal densification). A text
    without words has the empty string."""
    h = np.sort(shingle_hashes(data))
    if not len(h):
        return ""
    bins = (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    value = np.zeros(BINS, dtype=np.uint8)
    value[bins[first]] = (h[first] & _U((1 << BITS) - 1)).astype(np.uint8)
    full = np.zeros(BINS, dtype=bool)
    full[bins[first]] = True
    if len(first) == 1:
        value[:] = value[bins[0]]
    else:
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            attempt += 1
            to = (_TARGETS[attempt - 1] if attempt <= len(_TARGETS) else _targets(attempt))[empty]
            hit = full[to]
            value[empty[hit]] = value[to[hit]]
            empty = empty[~hit]
    return (value[::2] << 4 | value[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity: the share of equal bins, corrected for equality by chance (2^-BITS), in 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)
    same = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return max(0.0, (same - chance) / (1 - chance))


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of every whole text: the id and ``fingerprint``. Null texts count as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py().encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], [id_column, "fingerprint"])

    rows = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, T.StructType([docs.schema[id_column], T.StructField("fingerprint", T.StringType())]))


_EDITED = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("part", "edge")]
    + [T.StructField(n, T.LongType()) for n in ("doc_id", "n_chars")]
    + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    + [T.StructField("text", T.StringType())]
)
_RESULT = _EDITED.names[2:9]
_ARROW = pa.schema(
    [(n, pa.int32()) for n in _EDITED.names[:2]] + [(n, pa.int64()) for n in _EDITED.names[2:4]] + [(n, pa.string()) for n in _EDITED.names[4:7]] + [(n, pa.float64()) for n in _EDITED.names[7:9]] + [("text", pa.string())]
)


def _compare(doc: int, text: str, own: str, following: str, following_print: str) -> tuple:
    """A document's row, given the text and fingerprint of the next one."""
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    edited_print = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, following_print)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order. Edge 0: ready; 1: the last, which lacks its next document; 2: the first, as it is needed
    by the range before."""
    out, last, part = [], None, 0
    for part, doc, text in rows_of(batches):
        own = fingerprint(text.encode())
        if last is None:
            out.append((part, 2, doc, None, None, own, None, None, None, text))
        else:
            out.append((part, 0, *_compare(*last, text, own), None))
        last = (doc, text, own)
        if len(out) >= 512:
            yield _batch(out, _ARROW)
            out = []
    if last:
        yield _batch([*out, (part, 1, last[0], None, None, last[2], None, None, None, last[1])], _ARROW)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(_ARROW)[2:9])
    for row in rows_of(batches):
        yield _batch([_compare(*row)], schema)


def compare_with_edits(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint every whole text and its edited text, in which the next document's head replaces the second half.

    The next document is the one with the next higher id; after the last comes the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One range sort by id puts neighbours together, and each text is hashed where it lies. Only the first and last
    document of every range meet again, by range number. Null texts count as empty, null ids sort first, equal ids are
    ordered by a hash of their texts, other columns are ignored; a single document follows itself.
    """
    rows = by_id(docs, id_column, text_column, ranges)
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    done, _ = written(rows.mapInArrow(_in_range, _EDITED), "fingerprints")
    heads = done.filter("edge = 2")
    order = Window.orderBy("part")
    after = heads.select("part").select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after")
    )
    tails = done.filter("edge = 1").join(after, "part").select("after", "doc_id", "text", "fingerprint")
    heads = heads.select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("following_print"))
    ends = tails.join(heads, "after").select("doc_id", "text", "fingerprint", "following", "following_print")
    ends = ends.mapInArrow(_at_edges, T.StructType(_EDITED.fields[2:9]))
    return done.filter("edge = 0").select(*_RESULT).unionByName(ends)
