"""Table operators against plain Python."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import cleaning, dedup, modeling, shared
from terravane.plans import queries
from terravane.sources import store


@pytest.mark.parametrize("groups", [["g"], []])
def test_places_in_large_and_null_groups(spark, groups):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1, 2, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r["g"], r["v"], r["id"]): (r["place"], r["total"]) for r in shared.placed(df, groups, [F.col("v").asc_nulls_first(), F.col("id").desc()]).collect()}
    by, want = defaultdict(list), {}
    for r in rows:
        by[r[0] if groups else 0].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
        want |= {r: (i, len(own)) for i, r in enumerate(own, 1)}
    assert got == want
    assert shared.placed(df.limit(0), groups, [F.col("id").asc()]).count() == 0


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(5)
    names = [f"n{i:04}" for i in range(1500)]
    path = rng.sample(names[:700], 700)
    pairs = list(zip(path, path[1:])) + [(names[800], n) for n in names[801:1000]] + [tuple(rng.sample(names[1000:], 2)) for _ in range(250)] + [(names[5], names[5])]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = shared.components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r["id"]: r["group"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert shared.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_survivors_are_newest_then_longest_then_first(spark):
    rows = [(1, "2024-01-01", "ab"), (2, "2024-02-01", "a"), (3, None, "abcdef"), (4, "2024-02-01", "abc"), (5, "2024-02-01", "xyz"), (6, None, "lone"), (7, None, "p"), (8, None, "q")]
    df = spark.createDataFrame(rows, "id int, day string, text string").withColumn("at", F.to_timestamp("day"))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7)], "id int, group int")
    out = dedup.survivors(df, groups, "id", F.col("at"), F.length("text"))
    assert sorted((r["id"], r["duplicate_group"]) for r in out.collect()) == [(4, 1), (6, 6), (7, 7)]
    assert out.columns == [*df.columns, "duplicate_group"]


def test_pairs_of_a_block_and_of_cut_blocks(spark):
    base = "a flat with a view of the river and two rooms near the market"
    rows = [(i, base + f" number {i % 3}", 100.0 if i < 6 else 200.0, "x") for i in range(12)] + [(20, base, None, "x"), (21, base, 100.0, None), (22, None, 100.0, "x"), (23, "", None, "")]
    df = spark.createDataFrame(rows, "id int, text string, price double, place string")
    got = {(r["a"], r["b"]) for r in dedup.duplicate_pairs(df, "id", F.col("text"), [F.col("place")], F.col("price")).collect()}
    want, plain = set(), lambda t: t or ""
    for i, r in enumerate(rows):
        for s in rows[i + 1 :]:
            near = {(0, 1): c for _, _, c in dedup.chunk_pairs([plain(r[1]), plain(s[1])], 0.85)}
            close = r[2] is None or s[2] is None or abs(r[2] - s[2]) / max(r[2], s[2]) <= 0.03
            if (r[3] or "") == (s[3] or "") and near and close:
                want.add((r[0], s[0]))
    assert got == want and len(got) > 20
    cut = dedup.chunks(df.filter("price IS NOT NULL AND place = 'x'"), "id", [F.col("place")], F.col("price"), 5).collect()
    assert max(sum(1 for r in cut if r["chunk"] == c) for c in {r["chunk"] for r in cut}) <= 5
    assert dedup.duplicate_pairs(df.limit(0), "id", F.col("text"), [F.col("place")], F.col("price")).count() == 0


@pytest.mark.parametrize("limit", [3, 50])
def test_crawl_stops_after_known_rows(spark, limit):
    known = [1, 2, 5, 6, 7, 8, 10]
    df = spark.createDataFrame([(i, f"t{i}") for i in range(1, 13)], "id int, t string")
    got = sorted(r["id"] for r in store.stop_after_known(df, spark.createDataFrame([(k,) for k in known], "id int"), "id", "id", limit).collect())
    assert got == ([3, 4] if limit == 3 else [3, 4, 9, 11, 12])


def test_capped_sample_keeps_shares(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(1000)], "id int, p string")
    out = modeling.capped_sample(df, "p", "id", 100)
    assert {r["p"]: r["count"] for r in out.groupBy("p").count().collect()} == {"a": 90, "b": 10} and out.columns == df.columns


def test_pairs_and_copies_across_the_runs_of_a_block(spark):
    base = "a flat with a view of the river and two rooms near the market number"
    rng = random.Random(11)
    prices = [100.0 + i % 7 for i in range(40)] + [None, None, 0.0, -5.0] + [300.0] * 12
    rows = [(i, base + f" {rng.randrange(4)}", p) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "id int, text string, price double").withColumn("place", F.lit("x"))
    args = (df, "id", F.col("text"), [F.col("place")], F.col("price"))
    want = set()
    for i, r in enumerate(rows):
        for s in rows[i + 1 :]:
            close = r[2] is None or s[2] is None or max(r[2], s[2]) <= 0 or abs(r[2] - s[2]) / max(r[2], s[2]) <= 0.03
            if close and dedup.chunk_pairs([r[1], s[1]], 0.85):
                want.add((r[0], s[0]))
    got = [(r["a"], r["b"]) for r in dedup.duplicate_pairs(*args, max_block=5).collect()]
    assert set(got) == want and len(got) == len(want)
    sides = lambda p: {(r["id"], r["group"]) for r in dedup.groups_of(p).collect()}
    assert sides(dedup.duplicate_links(*args, max_block=5)) == sides(spark.createDataFrame(sorted(want), "a int, b int"))


def plain_cosine(a, b):
    def grams(t):
        out = Counter()
        for w in t.lower().split():
            w = f" {w} "
            out.update(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))
        return out

    x, y = grams(a), grams(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[g] for g, v in x.items()) / norm if norm else 0.0


@pytest.mark.parametrize(("part", "columns"), [(10, 16384), (1 << 20, 16384), (1 << 20, 100)])
def test_cosines_by_brute_force(part, columns, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(f"{rng.randrange(10**6):06}" for _ in range(40)) for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.03 else "other" for w in b.split()) for b in base for _ in range(3)] + ["", " ", "a", "A b", "é中 x"]
    monkeypatch.setattr(dedup, "PART", part)
    monkeypatch.setattr(dedup, "COLUMNS", columns)
    want = [(i, j, plain_cosine(texts[i], texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    want = [w for w in want if w[2] >= 0.85]
    for got in (dedup.chunk_pairs(texts, 0.85), sorted((i, j, c) for i, j, c in dedup.text_pairs(texts, texts, 0.85) if i < j)):
        assert [p[:2] for p in got] == [w[:2] for w in want] and len(want) > 10 and all(abs(p[2] - w[2]) < 1e-9 for p, w in zip(got, want, strict=True))


def test_survivors_of_documents_of_all_lengths(spark, tmp_path):
    short, rng = "a short text of some fifty characters, no more", random.Random(8)
    long = [" ".join("".join(rng.choices(letters, k=5)) for _ in range(1200))[:5000] for letters in ("abcdefgh", "rstuvwxyz")]
    texts = [short, short, "another text that is short, too, and no copy", long[0], long[0], long[0] + " end", long[1], "", ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["duplicate_group"]) for r in queries.QUERIES["near_dup_survivors"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0), (2, 2), (5, 3), (6, 6), (7, 7), (8, 8)}


def test_exact_quantiles(spark):
    rng, rows = random.Random(1), []
    for g, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 8), ("g", 102), ("h", 101), (None, 57), ("big", 30_000), ("ties", 4000)):
        rows += [(g, rng.choice([1.0, 2.0, 2.0, 7.5]) if g == "ties" else None if n > 10 and rng.random() < 0.05 else rng.gauss(0, 1)) for _ in range(n)]
    rows.append(("none", None))
    df, shares = spark.createDataFrame(rows, "g string, v double").repartition(5), [0.25, 0.5, 0.75, 0.0, 1.0]
    want = {r["g"]: r["p"] for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", shares).alias("p")).collect()}
    got = {r["g"]: list(r)[1:] for r in shared.quantiles(df, ["g"], F.col("v"), shares).collect()}
    assert want.keys() == got.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(want[k], got[k], strict=True))
    assert abs(shared.quantiles(df, [], F.col("v"), [0.5]).first()["q0"] - df.agg(F.median("v")).first()[0]) < 1e-12
    assert shared.quantiles(df.limit(0), [], F.col("v"), [0.5]).first()["q0"] is None and shared.quantiles(df.limit(0), ["g"], F.col("v"), [0.5]).count() == 0


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 5.0), ("y", None, None), (None, 7.0, 1.0)], "g string, a double, b double")
    out = cleaning.impute(df, cleaning.fit_medians(df, ["a", "b"], ["g"]), ["a", "b"], ["g"]).collect()
    assert {(r["g"], r["a"], r["b"]) for r in out} == {("x", 1.0, 5.0), ("x", 3.0, 5.0), ("y", 3.0, 3.0), (None, 7.0, 1.0)}


#: A number after a plus sign, alone and beside addresses, other digits and letters like digits; its count of hits, and the text without it.
WRITTEN = [
    ("call +1 (743) 555-3824 now", 1, "call +[SDT_DA_XOA] now"),
    ("12.158.146.20 +1 (743) 555-3824", 1, "12.158.146.20 +[SDT_DA_XOA]"),
    ("157.212.123.28 +1 (043) 155-3824", 1, "157.212.123.28 +[SDT_DA_XOA]"),
    ("+1 (743) 555-3824l +1 (743) 555-38245", 2, "+[SDT_DA_XOA]l +[SDT_DA_XOA]5"),
    ("1 (743) 555-3824 +1 (743) 555", 0, "[SDT_DA_XOA] +1 (743) 555"),
    ("+1 (743) 555 3824, +1 (٧43) 555-3824", 0, "+1 (743) 555 3824, +1 (٧43) 555-3824"),
    ("17432555382", None, None),
    (None, None, None),
]


def written(spark, at):
    spark.createDataFrame([(i, w[0]) for i, w in enumerate(WRITTEN)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_numbers_after_a_plus_sign_are_counted_as_written(spark, tmp_path):
    got = {r["doc_id"]: r["hits"] for r in queries.QUERIES["phone_counts"](spark, written(spark, tmp_path)).collect()}
    assert got == {i: hits for i, (_, hits, _) in enumerate(WRITTEN) if hits}


def test_numbers_after_a_plus_sign_are_cut_as_written(spark, tmp_path):
    got = {r["doc_id"]: (r["hits"], r["text"]) for r in queries.QUERIES["phone_scrub"](spark, written(spark, tmp_path)).collect()}
    assert got == {i: (hits, clean) for i, (_, hits, clean) in enumerate(WRITTEN) if hits is not None}


@pytest.mark.parametrize("rows", [7, 512])
def test_components_without_comparing_what_is_connected(rows, monkeypatch):
    rng = random.Random(6)
    words = [f"{rng.randrange(10**5):05}" for _ in range(60)]
    texts = [" ".join(w if rng.random() > 0.04 else "other" for w in words[k % 4 * 15 : k % 4 * 15 + 15]) for k in range(60)] + ["", "é 中"]
    p = np.array([rng.choice([100.0, 102.0, 104.5, 0.0, float("nan")] if k % 4 else [100.0, 150.0]) for k in range(62)])
    want = {(i, j) for i, j, _ in dedup.text_pairs(texts, None, 0.85) if np.isnan(p[i] + p[j]) or max(p[i], p[j]) <= 0 or abs(p[i] - p[j]) / max(p[i], p[j]) <= 0.03}
    monkeypatch.setattr(dedup, "ROWS", rows)
    for x, y, q, edges in ((texts, None, p, want), (texts[:30], texts[30:], p[30:], {(i, j) for i, j in want if i < 30 <= j})):
        group, plain = dedup.components_of(x, y, 0.85, p[: len(x)], q), list(range(62))
        for i, j in list(edges) * 3:
            plain = [min(plain[i], plain[j]) if g in (plain[i], plain[j]) else g for g in plain]
        assert len(set(zip(group.tolist(), plain, strict=True))) == len(set(group.tolist())) == len(set(plain)) < 50


def test_grams_of_short_texts_at_once():
    for a, b in zip(dedup.grams_of(texts := ["", "a", "a b  a b", "abc abc d", " ", "中é x"]), map(dedup.grams, texts), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert dedup.grams_of([]) == [] and len(dedup.grams_of([""])[0][0]) == 0


def test_many_near_copies_are_compared_at_once():
    rng = random.Random(5)
    texts = [f"Nhà STANDARD Bán nhà mặt tiền giá {rng.randrange(10**5)} triệu, sổ hồng Brand#{k % 3} {'x' * (k % 3 * 30)}" for k in range(900)]
    began = time.perf_counter()
    pairs = dedup.text_pairs(texts, None, 0.85)
    assert time.perf_counter() - began < 5 and len(pairs) > 100_000  # one at a time: more than that
    for i, j, cos in rng.sample(pairs, 50):
        assert abs(plain_cosine(texts[i], texts[j]) - cos) < 1e-12


def test_neighbours_by_price_connect_without_a_comparison(monkeypatch):
    rng = random.Random(7)
    p = np.array([float("nan")] * 2 + sorted(rng.uniform(900, 3000) for _ in range(1500)))
    texts = [f"Nhà LARGE Bán nhà mặt tiền giá {rng.randrange(10**5)} triệu, sổ hồng Brand#14" for _ in p]
    assert all(abs(a - plain_cosine(x, y)) < 1e-12 for a, x, y in zip(dedup._next_cosines(texts[:40] + ["", "é 中"]), texts[:40], texts[1:40] + [""]))
    p[700:] += 500  # a step beyond the gap; missing prices agree with any
    monkeypatch.setattr(dedup, "_cosines", None)
    group = dedup.chained(texts[2:], 0.85, p[2:])
    assert len(set(dedup.components_of(texts[2:], None, 0.85, p[2:], p[2:], group=group).tolist())) == 2
    assert not dedup._settled(p, np.concatenate(([0, 0], group)), 0.03)
    monkeypatch.undo()
    assert len(set(dedup.components_of(texts, None, 0.85, p, p, group=np.concatenate(([0, 0], group + 1))).tolist())) == 1
    other = [t if k % 2 else "another text that shares no word at all with these" for k, t in enumerate(texts[2:])]
    assert len(set(dedup.components_of(other, None, 0.85, p[2:], p[2:], group=dedup.chained(other, 0.85, p[2:])).tolist())) == 4


@pytest.mark.parametrize("edges", [0, 1 << 22])
def test_components_in_one_task_and_in_rounds(spark, edges, monkeypatch):
    monkeypatch.setattr(shared, "EDGES", edges)
    pairs = [(9, 2), (2, 7), (7, 5), (5, 30), (30, 31), (40, 41), (50, 51), (50, 52), (60, 61), (61, 62), (60, 62), (70, 70)]
    want = {2: 2, 9: 2, 7: 2, 5: 2, 30: 2, 31: 2, 40: 40, 41: 40, 50: 50, 51: 50, 52: 50, 60: 60, 61: 60, 62: 60}
    for kind in ("long", "string"):
        of = (lambda x: f"{x:02}") if kind == "string" else (lambda x: x)
        got = shared.components(spark.createDataFrame([(of(a), of(b)) for a, b in pairs], f"a {kind}, b {kind}")).collect()
        assert sorted((r["id"], r["group"]) for r in got) == [(of(k), of(v)) for k, v in sorted(want.items())]


def test_few_pairs_left_are_finished_one_by_one(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"{rng.randrange(10**6):06}" for _ in range(40)) for _ in range(60)] + ["", "é"]
    texts += [t + " end" for t in texts[:20]]
    grams, able = dedup.grams_of(texts), np.triu(np.ones((len(texts),) * 2, dtype=bool), 1)
    monkeypatch.setattr(dedup, "COLUMNS", 200)
    monkeypatch.setattr(dedup, "APIECE", 1 << 40)
    want = dedup._cosines(grams, None, 0.85, able)
    ones, dot = [], dedup._dot
    monkeypatch.setattr(dedup, "APIECE", 1)
    monkeypatch.setattr(dedup, "_dot", lambda x, y: ones.append(1) or dot(x, y))
    got = dedup._cosines(grams, None, 0.85, able)
    assert [g.tolist() for g in got] == [w.tolist() for w in want] and len(got[0]) == 20 and 20 <= len(ones) < 800
    half = dedup._cosines(grams[:30], grams[30:], 0.85, np.ones((30, len(texts) - 30), dtype=bool))
    assert len(half[0]) == 20 and all(abs(dot(grams[3], grams[62 + 3]) - d) < 1e-9 for d in [dot(grams[62 + 3], grams[3])]) and dot(grams[60], grams[60]) == 0
