"""Token ids of whole texts and their storage as wavelet matrices (operator 9)."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from terravane.llm.storage import written

#: Entries a worker keeps of each of its two caches, and the longest piece that it keeps, in bytes.
CACHE_ENTRIES = 1_000_000
CACHE_BYTES = 48
#: Rows that are turned into Python strings at once.
SLICE_ROWS = 64

#: The normalizer and the pre-tokenizer under which pieces of Latin-1 text may be encoded one by one.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    No pre-token of a ``word BPE`` vocabulary spans ASCII white space and its normalizer acts within such pieces, so pieces
    are encoded once and kept in a bounded cache. Lower-case Latin-1 words inside a piece go straight to the BPE model; all
    else, and any tokenizer of another form, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_piece = self._separable(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(added) or "(?!)").search
        self.letters = _byte_letters()
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _separable(spec: dict) -> bool:
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = spec.get("added_tokens") or []
        return (
            norm == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("pattern") == {"Regex": KNOWN_PATTERN}
            and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
            and not pre[1].get("add_prefix_space")
            and not pre[1].get("use_regex")
            and spec["model"].get("type") == "BPE"
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._whole(text)
        pieces = text.encode().split()  # bytes.split() knows ASCII white space only
        found = list(map(self.pieces.get, pieces))
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        ids = self.pieces.get(piece)
        if ids is not None:
            return ids
        kept = len(piece) <= CACHE_BYTES
        text = piece.decode()
        if not kept or not (piece.isascii() or max(text) <= "\xff") or self.special(text):
            ids = self._whole(text)
        elif text.isalpha():
            ids = self._word(text.lower())
        else:
            ids = b"".join(map(self._word, LATIN_PIECES.findall(text.lower())))
        if kept:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            own = [t.id for t in self.model.tokenize(shown)]
            ids = struct.pack(f"<{len(own)}I", *own)
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file; Spark reuses Python workers, so its caches outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time, so that only SLICE_ROWS texts are held as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)


# --- wavelet matrix ---------------------------------------------------------------------------------------------------

MAGIC = b"TVWM1\n"
#: Bits between two entries of a plane's rank directory.
RANK_BITS = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def wavelet_bytes(ids: np.ndarray) -> bytes:
    """Encode ids (below 2^32) as one self-contained wavelet matrix: header, then per bit-plane, from the highest bit,
    its number of zeros, its rank directory (ones before each block of RANK_BITS) and its bits."""
    n = len(ids)
    depth = max(1, int(ids.max()).bit_length()) if n else 1
    order = ids.astype(np.uint16 if depth <= 16 else np.uint32)
    out = [MAGIC, np.array([n, depth], dtype="<u8").tobytes()]
    for bit in range(depth - 1, -1, -1):
        ones = (order >> bit) & 1 != 0
        packed = np.packbits(ones, bitorder="little")
        block = RANK_BITS // 8
        padded = np.zeros(-(-max(len(packed), 1) // block) * block, dtype=np.uint8)
        padded[: len(packed)] = packed
        sums = np.bitwise_count(padded.view("<u8")).reshape(-1, block // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.zeros(len(sums) + 1, dtype="<u4")
        np.cumsum(sums, out=ranks[1:])
        out += [np.array([n - int(ranks[-1])], dtype="<u8").tobytes(), ranks.tobytes(), padded.tobytes()]
        if bit:
            order = np.concatenate([order.take(np.flatnonzero(~ones)), order.take(np.flatnonzero(ones))])
    return b"".join(out)


class WaveletMatrix:
    """A shard's ids under rank and select, read from the bytes of :func:`wavelet_bytes` without unpacking them."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = len(MAGIC)
        self.n, self.depth = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        at += 16
        blocks = -(-max(-(-self.n // 8), 1) // (RANK_BITS // 8))
        self.planes = []
        for _ in range(self.depth):
            zeros = int(np.frombuffer(data, "<u8", 1, at)[0])
            ranks = np.frombuffer(data, "<u4", blocks + 1, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + 4 * (blocks + 1))
            self.planes.append((zeros, ranks, bits))
            at += 8 + 4 * (blocks + 1) + blocks * RANK_BITS // 8

    def __len__(self) -> int:
        return self.n

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        _, ranks, bits = self.planes[plane]
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        full = int(ranks[block]) + int(_ONES[bits[start : i // 8]].sum())
        return full + (int(_ONES[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, (zeros, _, bits) in enumerate(self.planes):
            one = bits[i // 8] >> (i % 8) & 1
            value = value * 2 + int(one)
            ones = self._ones(p, i)
            i = zeros + ones if one else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.depth:
            return 0, 0
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (zeros + a, zeros + b) if value >> (self.depth - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.depth - 1, -1, -1):
            one = value >> (self.depth - 1 - p) & 1
            i = self._place(p, i - self.planes[p][0] if one else i, bool(one))
        return i

    def _place(self, plane: int, k: int, one: bool) -> int:
        """Place of the k-th one (or zero) of a plane: the block by bisection in the directory, then its bits."""
        _, ranks, bits = self.planes[plane]
        before = ranks.astype(np.int64) if one else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(bits[block * RANK_BITS // 8 : (block + 1) * RANK_BITS // 8], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(part == one)[k - int(before[block])])

    def occurrences(self, value: int) -> list[int]:
        """All places of an id, ascending."""
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the lowest bit up."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        order = np.zeros(self.n, dtype=kind)
        for bit, (zeros, _, bits) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(order)
            back[np.flatnonzero(~ones)] = order[:zeros]
            back[np.flatnonzero(ones)] = order[zeros:] | kind(1 << bit)
            order = back
        return order


# --- operator ---------------------------------------------------------------------------------------------------------

#: Ids after which a shard is closed at the next document; a longer document makes a longer shard.
SHARD_IDS = 1 << 18
#: Bytes of Parquet that a range of documents aims at.
RANGE_BYTES = 16 << 20


def ranges_for(docs: DataFrame, target: int = RANGE_BYTES) -> int:
    """Partitions for a range sort: input bytes over ``target``, and at least the session's shuffle partitions. Beyond 200,000, as
    each is a file of every map task, ranges grow instead: they are sorted with spill and read as streams."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(size // target, 200_000)) if size < 1 << 60 else floor


def by_id(docs: DataFrame, id_column: str, text_column: str, ranges: int | None = None) -> DataFrame:
    """(doc_id, text) dealt into ascending ranges of ids and sorted in each; null ids first, rows of equal id by a hash of the text and
    then as they were read. So rows of one id, or of none, and copies of one row are dealt to as many ranges as others."""
    cols = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    cols = cols.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("read"))
    order = ["doc_id", "hash", "read"]
    return cols.repartitionByRange(ranges or ranges_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")


SHARD_SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("matrix", T.BinaryType()),
    ]
)


def _write_shards(tokenizer: str, end_id: int, shard_ids: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        start, number, n, held, docs, lengths = 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "shard": pa.array([number], pa.int32()),
                    "start": pa.array([start], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "matrix": pa.array([wavelet_bytes(ids)], pa.binary()),
                }
            )

        part = 0
        for part, doc, text in rows_of(batches):
            held.append(encode(text) + end)
            docs.append(doc)
            lengths.append(len(held[-1]) // 4)
            n += lengths[-1]
            if n >= shard_ids:
                yield close()
                start, number, n, held, docs, lengths = start + n, number + 1, 0, [], [], []
        if docs:
            yield close()

    return shards


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, start, docs, lengths, matrix in rows_of(batches):
        ids = WaveletMatrix(matrix).ids().astype("<u4").view(np.uint8)
        ends = np.cumsum(np.array(lengths, dtype=np.int64))
        starts = ends - lengths
        view = memoryview(ids)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part] * len(docs), pa.int32()),
                "doc_id": pa.array(docs, pa.int64()),
                "at": pa.array(starts + start, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
            }
        )


def write_token_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_ids: int = SHARD_IDS,
    ranges: int | None = None,
) -> tuple[DataFrame, str]:
    """Encode every text, end it with ``end_id`` and write the ids, in ascending id order, as wavelet-matrix shards.

    One range sort by id deals the documents out; each task writes its range's shards, so nothing but a shard is held in
    memory. A row of the table is one shard: its range, its number and start in the range, the ids and lengths of its
    documents and the bytes of its wavelet matrix. Returns the table, read back, and its path. Null texts count as empty
    (one id, the end), null ids sort first, rows with equal ids stay separate documents, other columns are ignored, an
    empty table gives no shard.
    """
    dealt = by_id(docs, id_column, text_column, ranges)
    rows = dealt.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_write_shards(tokenizer, end_id, shard_ids), SHARD_SCHEMA), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of its
    ids as little-endian unsigned 32-bit integers), decoded from the matrices. The only rows that meet in one task are
    the ranges' totals, one each."""
    rows = shards.select("part", "start", "doc_ids", "lengths", "matrix").mapInArrow(
        _read_shards, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    total: Column = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = shards.groupBy("part").agg(F.sum(total).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("base"))
    joined = rows.join(bases, F.col("part") == F.col("of"))
    return joined.select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
