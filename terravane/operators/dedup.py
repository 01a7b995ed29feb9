"""Near-duplicate listings: blocks, cosine of character n-grams, price gap, components, survivors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import shared

MAX_BLOCK, AREA_WIDTH, COSINE, PRICE_GAP, MIN_TEXT = 2048, 5, 0.85, 0.03, 30
#: N-grams that are multiplied at once; characters and texts of a side that are compared at once; n-grams that are held for the next.
COLUMNS, PART, ROWS, HELD = 4096, 1 << 20, 512, 4 << 20
#: Products of two dense counts that take as long as an n-gram of a pair that is finished alone.
APIECE = 1000
#: Mean characters of texts whose n-grams are sorted at once.
SHORT = 300


def area_bucket(area: Column, width: float = AREA_WIDTH) -> Column:
    return F.coalesce(F.floor(area / width), F.lit(-1))


_SPACE, _U = ord(" "), np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

#: N-grams of a text: their 64-bit hashes, ascending, and how often each occurs.
Grams = tuple[np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def _windows(words: list[list[str]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts, and the place of the text of each. All windows of the texts with single spaces are hashed at once;
    those with a space inside span two words, or two texts, as these have a space each at their ends."""
    whole = [f" {' '.join(w)} " if w else "" for w in words]
    code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(whole), dtype=np.int32), [len(w) for w in whole])
    inner, found, owners, value = code == _SPACE, [], [], code + _U(1)
    for n in range(2, high + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        value = _mixed(value[:size] * _MIX[0] + code[n - 1 :])
        if n >= low:
            crosses = np.zeros(size, dtype=bool)
            for k in range(1, n - 1):
                crosses |= inner[k : k + size]
            found.append(value[~crosses] ^ _U(n))
            owners.append(owner[:size][~crosses])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def grams(text: str, low: int = 3, high: int = 5) -> Grams:
    """Character n-grams inside words padded by a space on either side, lower-cased; a padded word of fewer than n characters has none
    of that n."""
    hashes, counts = np.unique(_windows([text.lower().split()], low, high)[0], return_counts=True)
    return hashes, counts.astype(float)


def grams_of(texts: list[str]) -> list[Grams]:
    """N-grams of each text; short texts are sorted at once."""
    if not texts or sum(map(len, texts)) > SHORT * len(texts):
        return [grams(t) for t in texts]
    hashes, owner = _windows([t.lower().split() for t in texts], 3, 5)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, np.int64)
    counts, cuts = np.diff(np.append(first, len(hashes))).astype(float), np.searchsorted(owner[first], np.arange(1, len(texts)))
    return list(zip(np.split(hashes[first], cuts), np.split(counts, cuts), strict=True))


#: Places of pairs in x and in y, and their cosines.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _dot(x: Grams, y: Grams) -> float:
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return float((x[1] * y[1][at])[y[0][at] == x[0]].sum())


def _cosines(x: list[Grams], y: list[Grams] | None, threshold: float, able: np.ndarray) -> Found:
    """Those of the able pairs (place in x, place in y; without y, i < j of x) whose cosine is at least the threshold.

    Products of count matrices add up a slice of the n-grams at a time, those that weigh most first. What is left of two texts adds at
    most the product of its lengths, so pairs that can no longer reach the threshold are out, and the rest of the slices is
    left out with the last of them; as soon as they are few, they are finished one by one. N-grams of one text alone add nothing. Sums of counts are whole numbers, so single precision
    is exact below 2^24."""
    rows = x if y is None else x + y
    hashes = np.concatenate([h for h, _ in rows]) if rows else np.zeros(0, np.uint64)
    if not len(hashes) or not able.any():
        return _NONE
    counts = np.concatenate([c for _, c in rows])
    square = np.array([(c * c).sum() for _, c in rows])
    kind = np.float32 if square.max() < 1 << 24 else np.float64
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h, _ in rows])
    order = np.argsort(hashes)
    hashes, counts, owner = hashes[order], counts[order], owner[order]
    starts = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    size = np.diff(np.append(np.flatnonzero(starts), len(hashes)))
    shared_ = np.repeat(size > 1, size)
    column = (np.cumsum(size > 1) - 1)[np.repeat(np.arange(len(size)), size)[shared_]]
    counts, owner, n = counts[shared_], owner[shared_], int((size > 1).sum())
    rank = np.empty(n, np.uint16 if n <= 1 << 16 else np.int64)
    rank[np.argsort(-np.bincount(column, counts * counts / np.maximum(square, 1)[owner], n))] = np.arange(n)
    column = rank[column]
    order = np.argsort(column, kind="stable")
    counts, owner, column = counts[order], owner[order], column[order].astype(np.int64)
    norm = np.maximum(square, 1) ** 0.5
    m = len(x)
    scale = norm[:m, None] * (norm if y is None else norm[m:])[None]
    left, dot, lengths = np.bincount(owner, counts * counts, len(rows)), np.zeros(able.shape), np.array([len(h) for h, _ in rows])
    for low in range(0, n, COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        dense = np.zeros((len(rows), min(COLUMNS, n - low)), dtype=kind)
        dense[owner[part], column[part] - low] = counts[part]
        dot += dense[:m] @ (dense if y is None else dense[m:]).T
        left = np.maximum(left - np.bincount(owner[part], counts[part] ** 2, len(rows)), 0)
        rest = left**0.5
        able = able & (dot + rest[:m, None] * (rest if y is None else rest[m:])[None] >= (threshold - 1e-9) * scale)
        i, j = np.nonzero(able)
        if not len(i):
            return _NONE
        if APIECE * (lengths[i] + lengths[j + (0 if y is None else m)]).sum() < able.size * (n - low - COLUMNS):
            dot[i, j] = [_dot(x[a], (x if y is None else y)[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            break
    i, j = np.nonzero(able)
    cos = dot[i, j] / scale[i, j]
    good = cos >= threshold
    return i[good], j[good], cos[good]


def _parts(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of places of at most PART characters and ROWS texts, or one text."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > PART or i - begin >= ROWS):
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    return [*out, (begin, len(texts))] if texts else []


def _agree(a: np.ndarray, b: np.ndarray, gap: float) -> np.ndarray:
    """Whether prices agree: a missing one with any, those of 0 and less with each other."""
    top = np.maximum(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.isnan(top) | (top <= 0) | (np.abs(a - b) / top <= gap)


def _near(p: np.ndarray, q: np.ndarray, gap: float) -> np.ndarray:
    return _agree(p[:, None], q[None], gap)


def _next_cosines(texts: list[str]) -> np.ndarray:
    """The cosine of each text and the one after it."""
    n = len(texts)
    hashes, owner = _windows([t.lower().split() for t in texts], 3, 5)
    key = np.sort(np.unique(hashes, return_inverse=True)[1].astype(np.int64) * n + owner)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    key, counts = key[first], np.diff(np.append(first, len(key))).astype(float)
    owner = key % n
    norm = np.maximum(np.bincount(owner, counts * counts, n), 1) ** 0.5
    both = np.flatnonzero((key[1:] == key[:-1] + 1) & (owner[1:] > 0))  # an n-gram of a text and of the next
    return np.bincount(owner[both], counts[both] * counts[both + 1], n)[: n - 1] / (norm[:-1] * norm[1:])


def chained(texts: list[str], threshold: float, p: np.ndarray, gap: float = PRICE_GAP) -> np.ndarray:
    """A number for each text, equal for runs in which each text is linked to the next one. It only spares comparisons: where fewer
    than half of a part's neighbours are linked, the rest stays apart."""
    linked = np.zeros(max(len(texts) - 1, 0), dtype=bool)
    for a, b in _parts(texts):
        a = max(a - 1, 0)
        own = (_next_cosines(texts[a:b]) >= threshold) & _agree(p[a : b - 1], p[a + 1 : b], gap)
        linked[a : b - 1] = own
        if 2 * own.sum() < len(own):
            break
    return np.concatenate(([0], np.cumsum(~linked)))[: len(texts)]


def _tree(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of a symmetric matrix."""
    seen, a, b = np.zeros(len(linked), dtype=bool), [], []
    for s in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [] if seen[s] else [s]
        seen[s] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            a += [i] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _compared(x: list[str], y: list[str] | None, threshold: float, p: np.ndarray, q: np.ndarray, gap: float, group: np.ndarray | None) -> Iterator[Found]:
    """Pairs (i, j, cosine) of x and y, or i < j of x alone, whose n-gram counts have at least the threshold's cosine and whose prices p
    and q agree, a part of each side at a time. ``group``: the number of each text's component (x, then y), which is brought up
    to date; pairs of one component are not compared."""
    alone, shift, held = y is None, 0 if y is None else len(x), {}
    y = x if alone else y

    def counted(t: list[str], side: bool, a: int, b: int) -> list[Grams]:
        if (side, a) not in held:
            if sum(len(g) for own in held.values() for g, _ in own) > HELD:
                held.clear()
            held[side, a] = grams_of(t[a:b])
        return held[side, a]

    work = [(*u, *v) for u in _parts(x) for v in _parts(y) if not alone or u <= v]
    for a, b, c, d in sorted(work, key=lambda w: (abs(w[0] - w[2]), w)) if group is not None else work:
        able = _near(p[a:b], q[c:d], gap)
        own = alone and a == c
        if own:
            able = np.triu(able, 1)
        if group is not None:
            able &= group[a:b, None] != group[None, shift + c : shift + d]
        if not able.any():
            continue
        left = counted(x, False, a, b)
        i, j, cos = _cosines(left, None if own else counted(y, not alone, c, d), threshold, able)
        if group is not None and len(i):
            n = b - a
            linked = np.zeros((n if own else n + d - c,) * 2, dtype=bool)
            linked[i, j if own else j + n] = linked[j if own else j + n, i] = True
            at = np.concatenate((np.arange(a, b), shift + np.arange(c, d)))
            for k, m in zip(*(at[e] for e in _tree(linked)), strict=True):
                if group[k] != group[m]:
                    group[group == group[k]] = group[m]
        yield a + i, c + j, cos


def _settled(p: np.ndarray, group: np.ndarray, gap: float) -> bool:
    """Whether no pair of two runs of ``group`` has prices that agree: so if prices ascend, none is missing, and the ends of runs that
    meet don't agree; or if there is but one run."""
    ends = np.flatnonzero(group[1:] != group[:-1])
    return not len(ends) or bool((p[1:] >= p[:-1]).all() and not _agree(p[ends], p[ends + 1], gap * (1 + 1e-9)).any())


def components_of(x: list[str], y: list[str] | None, threshold: float, p: np.ndarray, q: np.ndarray, gap: float = PRICE_GAP, group: np.ndarray | None = None) -> np.ndarray:
    """A number for each text of x and then y, equal for those that pairs of x and y, or of x alone, connect. ``group``: numbers of
    those that are known to be connected."""
    if group is None:
        group = np.arange(len(x) + len(y or []))
    elif _settled(p if y is None else np.concatenate((p, q)), group, gap):
        return group
    for _ in _compared(x, y, threshold, p, q, gap, group):
        pass
    return group


def text_pairs(x: list[str], y: list[str] | None, threshold: float) -> list[tuple[int, int, float]]:
    """Pairs (i, j, cosine) of x and y, or i < j of x alone, whose n-gram counts have at least the threshold's cosine."""
    p, q = (np.full(len(t or []), np.nan) for t in (x, y))
    return [(int(i), int(j), float(c)) for found in _compared(x, y, threshold, p, p if y is None else q, PRICE_GAP, None) for i, j, c in zip(*found, strict=True)]


def chunk_pairs(texts: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """Pairs of texts (places i < j) with a cosine of n-gram counts of at least the threshold."""
    if not any(len(t.strip()) > MIN_TEXT for t in texts):
        return []
    return sorted(text_pairs(texts, None, threshold))


def chunks(df: DataFrame, id_: str, block: list[Column], price: Column, max_block: int = MAX_BLOCK) -> DataFrame:
    """Columns block and chunk: a block beyond ``max_block`` rows is cut into equal runs by price (nulls first), then id. So a group
    that one task sees is bounded, whatever its block's size."""
    rows = df.withColumn("block", F.concat_ws("|", *(F.coalesce(b.cast("string"), F.lit("")) for b in block)))
    rows = shared.placed(rows, ["block"], [price.asc_nulls_first(), F.col(id_).asc()], "place", "block_rows")
    n = F.greatest(F.lit(2), F.ceil(F.col("block_rows") / max_block))
    chunk = F.when(F.col("block_rows") > max_block, F.floor((F.col("place") - 1) / F.ceil(F.col("block_rows") / n))).otherwise(0)
    return rows.withColumn("chunk", chunk.cast("int"))


def _classes(df: DataFrame, id_: str, text: Column, block: list[Column], price: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, price, b) of one of each class of equal block, text and price, and the members (id, rep) of all classes. Blocks
    of one row or without a text beyond MIN_TEXT, and texts without words, have no pair."""
    key = F.concat_ws("|", *(F.coalesce(b.cast("string"), F.lit("")) for b in block))
    number = price.cast("double")
    rows = df.select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.when(~F.isnan(number), number).alias("price"), key.alias("b")).filter("id IS NOT NULL")
    digests = shared.cut(rows.select("id", "b", "price", F.sha2("text", 256).alias("digest"), F.col("text").rlike(rf"(?sU)\S.{{{MIN_TEXT - 1},}}\S").alias("long"), F.col("text").rlike(r"(?U)\S").alias("words")))
    blocks = digests.groupBy("b").agg(F.bool_or("long").alias("any_long"), F.count("*").alias("n")).filter("any_long AND n > 1").select(F.col("b").alias("_b"))
    able = digests.filter("words").join(blocks, F.col("b") == F.col("_b"), "left_semi")
    least = able.groupBy("b", "digest", "price").agg(F.min("id").alias("rep")).select(F.col("b").alias("_b"), F.col("digest").alias("_d"), F.col("price").alias("_p"), "rep")
    members = able.join(least, (F.col("b") == F.col("_b")) & (F.col("digest") == F.col("_d")) & F.col("price").eqNullSafe(F.col("_p"))).select("id", "rep")
    members = shared.cut(members)
    return rows.join(members.filter("id = rep").select("id"), "id", "left_semi"), members


def _class_pairs(reps: DataFrame, threshold: float, gap: float, max_block: int, forest: bool) -> DataFrame:
    """(a, b, cosine) of likely duplicates among classes. A block's runs by price are compared with themselves and with each
    following run that reaches into the price gap, so no pair is lost and a task holds two runs at a time. ``forest``: (a, b, 1) that
    connect the same ids as all pairs do, each id with the smallest one of its component in the task. Neighbours by price are linked
    first; only what they leave apart is compared."""
    kind = reps.schema["id"].dataType.simpleString()
    rows = chunks(reps, "id", [F.col("b")], F.col("price"), max_block).filter("block_rows > 1").select("block", "chunk", "id", "text", "price")
    runs = rows.groupBy("block", "chunk").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.bool_or(F.col("price").isNull()).alias("missing"))
    one = runs.select("block", F.col("chunk").alias("c1"), "high", "missing")
    two = runs.select(F.col("block").alias("_block"), F.col("chunk").alias("c2"), "low")
    reach = F.col("missing") | (F.col("low") <= 0) | (F.col("low") * (1 - gap) * (1 - 1e-9) <= F.col("high"))  # nulls are first; prices of 0 and less agree
    work = shared.cut(one.join(two, (F.col("block") == F.col("_block")) & (F.col("c1") <= F.col("c2")) & ((F.col("c1") == F.col("c2")) | reach)).select("block", "c1", "c2"))
    legs = work.select("block", F.col("c1").alias("chunk"), "c1", "c2").unionByName(work.filter("c1 < c2").select("block", F.col("c2").alias("chunk"), "c1", "c2"))

    def pairs(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        first = (g["chunk"] == g["c1"]).to_numpy()
        x, y = g[first], g[~first]
        alone = not len(y)
        texts = x["text"].tolist(), None if alone else y["text"].tolist()
        p, q = x["price"].to_numpy(float), (x if alone else y)["price"].to_numpy(float)
        ids, others = x["id"].to_numpy(), (x if alone else y)["id"].to_numpy()
        if forest:  # each component's ids with its smallest one
            every = pd.Series(ids if alone else np.concatenate((ids, others)))
            known = chained(texts[0] + (texts[1] or []), threshold, p if alone else np.concatenate((p, q)), gap)  # both runs, by price
            least = every.groupby(components_of(*texts, threshold, p, q, gap, known)).transform("min")
            yield pd.DataFrame({"a": least, "b": every, "cosine": 1.0})[(least != every).to_numpy()]
            return
        for i, j, cos in _compared(*texts, threshold, p, q, gap, None):
            a, b = ids[i], others[j]
            less = (a < b).astype(bool)
            yield pd.DataFrame({"a": np.where(less, a, b), "b": np.where(less, b, a), "cosine": cos})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of runs are runs of sorted rows; a batch's last one may go on in the next."""
        held = None
        for b in batches:
            if b.empty:
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            last = rows.iloc[-1]
            goes_on = (rows["block"] == last["block"]) & (rows["c1"] == last["c1"]) & (rows["c2"] == last["c2"])
            held = rows[goes_on]
            yield from found(rows[~goes_on])
        if held is not None:
            yield from found(held)

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, g in rows.groupby(["block", "c1", "c2"], sort=False):
            if len(g) > 1:
                yield from pairs(g.sort_values("price", na_position="first", kind="stable"))

    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes are much work here
    both = rows.join(legs, ["block", "chunk"]).repartition(tasks, "block", "c1", "c2").sortWithinPartitions("block", "c1", "c2")
    return both.mapInPandas(run, f"a {kind}, b {kind}, cosine double")


def duplicate_pairs(df: DataFrame, id_: str, text: Column, block: list[Column], price: Column, threshold: float = COSINE, gap: float = PRICE_GAP, max_block: int = MAX_BLOCK) -> DataFrame:
    """(a, b, cosine) of all likely duplicates in a block: cosine and price agree (a missing price agrees with any). Copies give all
    their pairs, so the result grows with the square of a group; ``duplicate_links`` does not."""
    reps, members = _classes(df, id_, text, block, price)
    between = shared.cut(_class_pairs(reps, threshold, gap, max_block, False))
    x, y = members.select(F.col("id").alias("x"), F.col("rep").alias("rx")), members.select(F.col("id").alias("y"), F.col("rep").alias("ry"))
    within = x.join(y, (F.col("rx") == F.col("ry")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("cosine"))
    across = between.join(x, F.col("a") == F.col("rx")).join(y, F.col("b") == F.col("ry"))
    return within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine"))


def duplicate_links(df: DataFrame, id_: str, text: Column, block: list[Column], price: Column, threshold: float = COSINE, gap: float = PRICE_GAP, max_block: int = MAX_BLOCK) -> DataFrame:
    """(a, b) that connect ids exactly as all ``duplicate_pairs`` would: each copy with its class, and classes with each other."""
    reps, members = _classes(df, id_, text, block, price)
    between = _class_pairs(reps, threshold, gap, max_block, True).select("a", "b")
    return members.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(between)


def groups_of(pairs: DataFrame) -> DataFrame:
    """(id, group) of connected ids, the group being the smallest id."""
    return shared.components(pairs.select("a", "b"))


def survivors(df: DataFrame, groups: DataFrame, id_: str, newest: Column, longest: Column) -> DataFrame:
    """One row per group: the newest (null is oldest), then the longest, then the smallest id. Adds duplicate_group. Ids are unique.
    The best of a group is a partial minimum; all joins are on ids, so large groups meet in no task."""
    own = groups.select(F.col("id").alias("_of"), F.col("group").alias("_group"))
    rank = F.struct(newest.isNull().alias("undated"), (-F.unix_micros(newest)).alias("age"), (-longest).alias("length"), F.col(id_).alias("id"))
    best = df.select(F.col(id_).alias("_id"), rank.alias("_rank")).join(own, F.col("_id") == F.col("_of")).groupBy("_group").agg(F.min("_rank").alias("_rank"))
    joined = df.join(own, F.col(id_) == F.col("_of"), "left").join(best.select(F.col("_rank.id").alias("_best")), F.col(id_) == F.col("_best"), "left")
    kept = joined.filter("_group IS NULL OR _best IS NOT NULL").withColumn("duplicate_group", F.coalesce("_group", F.col(id_)))
    return kept.drop("_of", "_group", "_best")
