"""Crawls, gate, gold labels, models, experiments, tables and commands on small tables."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from terravane import cli
from terravane.functions import money, phones
from terravane.operators import gold, models, svd
from terravane.plans import gate, pipeline, runner, tables
from terravane.sources import crawl, store, wards

# --- crawls -----------------------------------------------------------------------------------------------------------


def session(answers, **options):
    """A session over a list of (status, text) or exceptions, and the seconds that it slept."""
    slept, asked, now = [], [], [0.0]

    def fetch(url, params):
        asked.append((url, dict(params)))
        a = answers(url, params) if callable(answers) else answers[len(asked) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    def sleep(s):
        slept.append(s)
        now[0] += s

    return crawl.PoliteSession(fetch, clock=lambda: now[0], sleep=sleep, **options), slept, asked


def test_requests_wait_retry_and_give_up():
    s, slept, asked = session([(200, "a"), (429, ""), OSError("x"), (200, "b"), (404, "")])
    with s:
        assert s.get("u") == "a" and slept == []
        assert s.get("u") == "b" and s.stats == {"requests": 4, "retries": 2, "errors": 0} and 1.5 <= slept[0] <= 1.9
        with pytest.raises(crawl.CrawlError, match="404"):
            s.get("u")
    with pytest.raises(crawl.CrawlError, match="closed"):
        s.get("u")
    s, slept, _ = session(lambda u, p: (503, ""), retries=3, delay=1.0)
    with pytest.raises(crawl.CrawlError, match="3 attempts"):
        s.get("u")
    assert s.stats == {"requests": 3, "retries": 3, "errors": 1} and [x for x in slept if x in (1.0, 2.0, 4.0)] == [1.0, 2.0, 4.0]


def gateway(total):
    """A gateway of records 1 .. total, the newest first."""

    def answer(url, p):
        ids = range(p["o"] + 1, min(p["o"] + p["limit"], total) + 1)
        return 200, json.dumps({"ads": [{"list_id": i, "subject": f"Nhà {i}, LH 0901234567", "price": 5, "phone": "1", "size": "60"} for i in ids], "total": total})

    return answer


def test_gateway_pages_end_at_the_total_or_the_limit():
    for total, most, want in ((45, 100, 45), (45, 30, 30), (0, 10, 0)):
        s, _, asked = session(gateway(total))
        got = list(crawl.gateway_records(s, "u", 1, most))
        assert [r["list_id"] for r, _ in got] == list(range(1, want + 1)) and [o for _, o in got] == list(range(1, want + 1)) and "phone" not in str(got)
    assert crawl.unseen(iter([]), set(), "id", 5) is not None
    rows = [({"id": i}, i) for i in range(1, 10)]
    assert [r["id"] for r in crawl.unseen(iter(rows), {"1", "3", "4"}, "id", 9, 2)] == [2]
    assert [r["id"] for r in crawl.unseen(iter(rows), {"1", "3", "4"}, "id", 3, None)] == [2, 5, 6]


def test_gateway_crawl_into_the_store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    first = crawl.crawl_gateway(spark, session(gateway(30))[0], "u", 1, at, 12, "g")
    assert first == {"written": 12, "skipped_duplicate": 0, "pii_redactions": 12}
    assert crawl.crawl_gateway(spark, session(gateway(30))[0], "u", 1, at, 50, "g")["written"] == 18
    assert crawl.crawl_gateway(spark, session(gateway(30))[0], "u", 1, at, 50, "g", resume=False)["written"] == 0
    rows = spark.read.parquet(at)
    assert rows.count() == 30 and rows.filter(F.contains("subject", F.lit("0901"))).count() == 0 and rows.first()["size"] == 60.0 and "phone" not in rows.columns
    assert len(crawl.dry_run(session(gateway(30))[0], "u", 1)) == 6


def test_page_crawl_passes_over_what_fails(spark, tmp_path):
    def answer(url, p):
        if "id3" in url:
            return 404, ""
        if "-id" in url:
            return 200, f"<h1>Nhà {url[-1]}</h1><div class='address'>Gọi 0901234567</div>"
        page = int(url.partition("?cp=")[2] or 1)
        items = {1: (1, 2), 2: (3, 4), 3: ()}[page]
        return 200, "".join(f"<div class='prop-info'><a href='/x-id{i}'>t</a><div class='price'>{i} tỷ</div></div>" for i in items)

    at = f"file://{tmp_path}/pages"
    got = crawl.crawl_pages(spark, session(answer)[0], "https://s.example.org", "quan", at, 10, "p")
    assert got == {"scanned": 4, "detail_errors": 1, "written": 3, "skipped_duplicate": 0, "pii_redactions": 3}
    assert crawl.crawl_pages(spark, session(answer)[0], "https://s.example.org", "quan", at, 10, "p")["written"] == 0
    assert {(r["id"], r["title"], r["price_text_list"], r["address"]) for r in spark.read.parquet(at).collect()} == {(i, f"Nhà {i}", f"{i} tỷ", f"Gọi {phones.MARKER}") for i in "124"}


def test_checkpoint_survives_and_forgets(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    c = store.Checkpoint(spark, at)
    assert c.get("page") is None
    c.save(page=3)
    c.save(written=5)
    assert store.Checkpoint(spark, at).data == {"page": 3, "written": 5}
    next((tmp_path / "state").glob("part-*")).write_text('{"page": ')
    for crc in (tmp_path / "state").glob(".part-*"):
        crc.unlink()
    assert store.Checkpoint(spark, at).data == {}
    c.reset()
    assert not (tmp_path / "state").exists()


# --- gate, gold, wards ------------------------------------------------------------------------------------------------


def test_gate_counts_and_report(spark):
    kind = "body string, price double, ward_name string, ward_name_v3 string, latitude double, longitude double, area_name string, note string"
    rows = [("x" * 300, 5e9, "P.1", None, None, None, "Tân Bình", None), ("short", 1.0, None, "", 0.0, 106.0, "Quận 1", "gọi 0901 234 567"), (None, None, None, None, 10.0, 106.0, None, "8490123456789")]
    checks, report = gate.run([gate.gateway_view(spark.createDataFrame(rows, kind), "g")])
    got = {r["metric"]: r["value"] for r in checks.collect()}
    assert got == {"rows": 3, "long_share": 1 / 3, "price_share": 1 / 3, "place_share": 2 / 3, "target_rows": 1, "phones": 1, "phones_independent": 2}
    assert "0/7 ngưỡng đạt" in report and "| Tỷ lệ tin có phường hoặc toạ độ | 66,7% | ≥ 70,0% | CHƯA ĐẠT |" in report and "Nguồn thô: g 3." in report
    none, _ = gate.collect([gate.gateway_view(spark.createDataFrame([], kind), "g")])
    assert none.first()["rows"] == 0 and pipeline.gate(none).filter("metric = 'phones'").first()["passed"]


def test_labels_are_stated_near_a_word_of_their_field(spark):
    cases = [
        ("dt 60 m2", 60.0, "area_m2", True), ("gia 60 ty, nha dep rong rai thoang mat gan cho, 2 phong", 60.0, "area_m2", False), ("60,5m2", 60.5, "area_m2", True), ("1160 m2", 60.0, "area_m2", False),
        ("3 phong ngu", 3.0, "bedrooms", True), ("115 trieu/m2", 1.0, "bedrooms", False), ("nha 3 lau dai lam", 3.0, "floors", False), ("3 lau", 3.0, "floors", True), ("phong tam 2", 2.0, "bathrooms", True),
        ("2 wc " * 40 + "nha", 2.0, "bathrooms", True), ("", 2.0, "floors", False), ("x", None, "floors", False),
    ]
    df = spark.createDataFrame(cases, "t string, v double, f string, want boolean")
    for f, m in gold.FIELDS.items():
        for r in df.filter(F.col("f") == f).select("t", "want", gold.stated(F.col("v"), F.col("t"), m.words).alias("got")).collect():
            assert r["got"] == r["want"], r


def test_gold_scores_and_report(spark):
    rows = [(i, "Bán nhà", f"{i % 3 + 1} phòng ngủ, {i + 20}m2", float(i + 20), i % 3 + 1 + (i == 4), 0, None) for i in range(12)] + [(99, "x", None, 5.0, 1, 1, 1)]
    g = gold.build(spark.createDataFrame(rows, "id int, subject string, body string, size double, rooms int, toilets int, floors int"), "id", size=10)
    assert g.select("id").distinct().count() == 10 and {r["field"] for r in g.collect()} == {"area_m2", "bedrooms"}
    judged = gold.judged(g)
    scores = {r["field"]: r for r in gold.measure(judged).collect()}
    assert scores["area_m2"]["f1"] == 1.0 and scores["bedrooms"]["precision"] == 1.0 and scores["area_m2"]["n_gold_total"] == 10
    text = gold.report(gold.measure(judged), gold.error_breakdown(judged))
    assert "| Diện tích (m²) | 10/10 | 1,000 | 1,000 | **1,000** ✓ |" in text
    assert [r["outcome"] for r in spark.createDataFrame([(2.0, 3.0)], "p double, g double").select(F.when(gold.agrees(F.col("p"), F.col("g"), F.lit(0.0)), "same").otherwise("other").alias("outcome")).collect()] == ["other"]


def test_ward_mapping_is_kept(spark, tmp_path):
    rows = [("P.1", "Phường Mới", "Q.1")] * 3 + [("P.2", "Phường Mới", "Q.1")] * 2 + [("P.3", None, "Q.3"), ("P.4", "Khác", "Q.4")]
    df = spark.createDataFrame(rows, "ward_name string, ward_name_v3 string, area_name string")
    at = f"file://{tmp_path}/wards"
    kept = wards.mapping(spark, df, at)
    assert {(r["new_ward"], r["old_ward"], r["support"], r["majority_share"]) for r in kept.collect()} == {("Phường Mới", "Phường 1", 5, 0.6), ("Phường Khác", "Phường 4", 1, 1.0)}
    assert wards.mapping(spark, df.limit(0), at).count() == 2 and wards.save(wards.learn(df.limit(0)), at).count() == 2 and wards.save(wards.learn(df.limit(0)), at, True).count() == 0
    assert wards.weak(wards.learn(df), 0.7).count() == 1
    with pytest.raises(FileNotFoundError):
        wards.load(spark, f"file://{tmp_path}/none")


# --- models -----------------------------------------------------------------------------------------------------------


def plain_features():
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    return spark.createDataFrame([(i, a, b, float(np.exp(1 + 2 * a + b))) for i, a, b in rows], "id int, a double, b double, price double")


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_neighbours_by_brute_force(points, weights, monkeypatch):
    monkeypatch.setattr(models, "QUERIES", 30)  # several blocks
    train, test = points.filter("id >= 80"), points.filter("id < 80")
    got = {r["id"]: r["prediction"] for r in models.nearest(plain_features(), "price", 4, weights)(train.repartition(3), test).collect()}
    x = train.toPandas()
    for r in test.collect():
        d = np.hypot(x["a"] - r["a"], x["b"] - r["b"])
        near = d.nsmallest(4).index
        w = 1 / d[near] if weights == "distance" else d[near] * 0 + 1
        assert abs(got[r["id"]] / np.exp((w * np.log(x["price"][near])).sum() / w.sum()) - 1) < 1e-6
    assert len(got) == 80


def test_network_learns(points):
    train, test = points.filter("id >= 80"), points.filter("id < 80")
    out = models.network(plain_features(), "price", (16,), epochs=40, rate=0.05)(train.repartition(2), test)
    errors = out.select((F.abs(F.col("prediction") - F.col("price")) / F.col("price")).alias("e")).toPandas()["e"]
    assert out.columns == [*test.columns, "prediction"] and len(errors) == 80 and errors.median() < 0.15


def test_catalogue_grids_and_budgets():
    specs = {s.name: s for s in models.catalogue(plain_features, ["p"], "price", "a")}
    assert len(specs) == 10 and specs["Ridge"].grid_size == 25 and specs["K láng giềng"].grid_size == 10 and specs["Hồi quy tuyến tính"].grid_size == 0
    assert specs["K láng giềng"].search_budget(40) == 10 and specs["Random Forest"].search_budget(40) == 40 and specs["Dummy (trung vị)"].search_budget(40) == 0
    assert len(models.catalogue(plain_features, ["p"], "price", "a", fast=True)) == 5


def test_singular_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 20)) + 0.01 * rng.normal(size=(60, 20))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in a.tolist()], ["tfidf"]).repartition(3)
    out = svd.TruncatedSVD(components=5).fit(df).transform(df)
    got = np.array([r["svd"].toArray() for r in out.collect()])
    _, s, vt = np.linalg.svd(a)
    assert got.shape == (60, 5) and np.allclose(np.sort(np.linalg.norm(got, axis=0)), np.sort(s[:5]), rtol=1e-6)
    assert svd.feasible(120, 30) == 29 and svd.feasible(5, 1) == 1 and svd.TruncatedSVD(components=99).fit(df).basis.shape[1] == 19


# --- experiments ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def listings(spark):
    rng, day, rows = random.Random(2), datetime.datetime(2025, 3, 1), []
    for i in range(1100):
        area, place = rng.uniform(20, 120), rng.choice(["Tân Bình", "Tân Phú"])
        price = area * (8e7 if place == "Tân Bình" else 5e7) * np.exp(rng.gauss(0, 0.1))
        text = rng.choice(["nhà mới hẻm xe hơi", "nhà cũ cần bán gấp", "sổ hồng riêng gần chợ"])
        rows.append((f"x{i}", "new" if i < 600 else "old", float(price), area, place, f"Phường {i % 3}", "Nhà phố", "sổ hồng", "Đông", "hẻm", float(i % 4) if i % 5 else None, day, text, text, text, f"x{i - i % 2}"))
    kind = "listing_id string, source string, total_price_vnd double, area_m2 double, district string, ward string, property_type string, legal_status string, direction string, position string, bedrooms double, published_at timestamp, description string, description_clean string, description_tokens string, duplicate_group string"
    return spark.createDataFrame(rows, kind).withColumns({f"{c}_missing": F.lit(0) for c in runner.MISSING}).withColumns({c: F.lit(1.0) for c in runner.MISSING if c != "bedrooms"}).coalesce(1).cache()


def few(use_text=False, use_flags=True):
    wanted = {"Dummy (trung vị)", "Trung vị giá/m² theo nhóm", "Cây quyết định"}
    specs = [s for s in models.catalogue(lambda: runner.features(use_text, use_flags, 4), runner.GROUPS, runner.LABEL, runner.AREA) if s.name in wanted]
    return [s if not s.grid else models.ModelSpec(s.name, s.tier, s.make, {"maxDepth": [2, 4]}) for s in specs]


@pytest.fixture
def one_partition(spark):
    """Many small jobs: one task each."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_experiments_end_to_end(spark, listings, one_partition, tmp_path):
    root = f"file://{tmp_path}/results"
    assert runner.champion_of(spark, root, "e1_new", few())[0] is None and runner.best_params(spark, root, "e1_new") == {}
    runner.run_e1(spark, listings, few(), root, {"new": "Nguồn mới", "none": "-"}, 2, None)
    e1 = runner.read_results(spark, root, "e1_new")
    by = {m["name"]: m for m in e1["models"]}
    assert runner.read_results(spark, root, "e1_none") is None and len(by) == 3 and by["Cây quyết định"]["best_params"] == {"maxDepth": "4"} and by["Cây quyết định"]["search_budget"] == 2
    assert by["Trung vị giá/m² theo nhóm"]["holdout"]["mdape"] < 12 < by["Dummy (trung vị)"]["holdout"]["mdape"] and runner.pick_champion(e1)["name"] == "Cây quyết định"
    runner.run_e2(spark, listings, few()[-1:], root, "old", "new", "2025", 1)
    runner.run_e3(spark, listings, few(), root, "new")
    runner.analyse(spark, listings, few(), root, "new", (0.5, 1.0))
    card = runner.export_champion(spark, listings, root, "new", few())
    assert card.startswith("# Model card: Cây quyết định") and "03/2025" in card
    texts = tables.render_all(spark, root, ["new", "old"], "new")
    assert set(texts) == {"e1-results-new.md", "slide-e1.md", "e2-results.md", "e3-results.md", "error-analysis.md", "learning-curve.md"}
    assert "Nhóm dẫn đầu (Cây quyết định)" in texts["e1-results-new.md"] and "| Phường 0 |" in texts["e3-results.md"] and "| 100% |" in texts["learning-curve.md"]
    values = {"area_m2": 60.0, "district": "Tân Bình", "ward": "Phường 1", "property_type": "Nhà phố", "bedrooms": 2.0, "description": "nhà đẹp giá 5 tỷ"}
    found = runner.price_of(spark, values, root, few())
    assert found["low"] < found["price"] < found["high"] and 3e9 < found["price"] < 7e9
    why = runner.explanation(spark, values, root, few(), ("area_m2", "district"))
    assert {c for c, _ in why} == {"area_m2", "district"}
    assert runner.reference_values(listings, ["district"]) == {"district": ["Tân Bình", "Tân Phú"]}


def test_leakage_is_refused(spark, listings):
    ready = runner.feature_frame(listings.limit(50))
    assert runner.leakage_checklist(ready)["rows"] == 50
    with pytest.raises(ValueError, match="money"):
        runner.leakage_checklist(runner.feature_frame(listings.limit(3).withColumn("description_tokens", F.lit("giá 5_tỷ"))))
    assert [runner.coerce(v) for v in ("3", "0.5", "None", "(128, 64)", "sqrt", 7)] == [3, 0.5, None, (128, 64), "sqrt", 7]


def test_numbers_of_figures(spark, listings, tmp_path):
    found = tables.figures(listings)
    assert found["count_by_district"].count() == 2 and found["unit_price_by_month"].count() == 2
    assert found["area_distribution"].agg(F.sum("n")).first()[0] == 1100 and found["price_distribution"].filter("bin < 0 OR bin > 59").count() == 0
    tables.save_figures(listings, f"file://{tmp_path}/figures")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/figures/count_by_district").columns == ["district", "new", "old", "others"]


def test_tables_follow_the_numbers():
    row = lambda name, mdape, std=1.0, tier="1 · tuyến tính": {"name": name, "tier": tier, "cv_mean": {"rmse": 1.0, "mae": 0.5, "mdape": mdape, "r2": 0.5}, "cv_std": {"rmse": 0.9, "mae": 0.1, "mdape": std, "r2": 0.1}, "holdout": {"rmse": 1.0, "mae": 0.5, "mdape": mdape, "r2": None, "n_non_finite": 2}, "search_budget": 5}
    e1 = {"models": [row("Ridge", 20.0), row("Lasso", 20.5), row("Random Forest", 30.0), row(tables.BASELINE, 25.0, tier="0 · mốc")], "label": "a — b", "n_rows": 1234, "holdout_test_size": 0.2, "cv_folds": 5, "seed": 42, "search_iterations": 40}
    text = tables.render_e1(e1)
    assert "# E1: a · b" in text and "1.234 dòng, hold-out 80/20" in text and "Nhóm dẫn đầu (Ridge, Lasso)" in text and "4,50–5,00" in text and "**20,0 ± 1,0**" in text and "tràn số" in text
    assert "Lượt rút thật thấp hơn ngân sách ở: " in text and "**Ridge**" in tables.render_e1_slide(e1)
    e2 = {"models": [{"name": "Ridge", "transfer": {"rmse": 1.0, "mae": 1.0, "mdape": 24.0, "r2": 0.1}}, {"name": "Neu", "transfer": {"rmse": 1.0, "mae": 1.0, "mdape": None, "r2": 0.1, "n_non_finite": 3}}], "train_rows": 1000, "test_rows": 10, "cutoff": "x"}
    assert "| +4,0 |" in tables.render_e2(e2, e1) and "xấu đi: **4,0" in tables.render_e2(e2, e1) and "(không có mốc)" in tables.render_e2(e2)
    rows = [{"configuration": c, "cv_mean": {"mdape": m, "rmse": 1.0, "r2": 0.5}, "cv_std": {"mdape": 1.0}} for (c, _, _), m in zip(runner.CONFIGURATIONS, (20.0, 19.0, 21.0, 19.5), strict=True)]
    assert "Cờ thủ công giúp được, TF-IDF/SVD làm tệ đi." in tables.render_ablation({"model": "m", "rows": rows}) and "| -1,00 |" in tables.render_ablation_slide({"rows": rows})
    curve = lambda last: tables.render_learning_curve({"model": "m", "points": [{"fraction": 0.5, "n_train": 5, "rmse": 1.0, "mdape": 20.0}, {"fraction": 1.0, "n_train": 10, "rmse": 1.0, "mdape": last}]})
    assert "vẫn còn giảm 2,0" in curve(18.0) and "xấu đi 2,0" in curve(22.0) and "gần như không giảm" in curve(19.9)
    assert tables.number(float("nan")) == "tràn số" and tables.best_place([3.0, None, 1.0], True) == 2 and tables.best_place([None, 0.2], False) == 1


def test_commands(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = [{"list_id": i, "subject": "Bán nhà", "body": f"{i % 3 + 1} phòng ngủ, dt {50 + i}m2", "price": (3 + i) * 1e9, "size": 50.0 + i, "rooms": i % 3 + 1, "ward_name": "P.1", "ward_name_v3": "Mới", "area_name": "Tân Bình", "latitude": 1.0, "longitude": 1.0} for i in range(6)]
    (raw / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    own = ["--results", f"file://{tmp_path}/results"]
    crawled = json.loads(cli.run(spark, [*own, "crawl", "gateway", "--url", "u", "--areas", "1", "--out", f"file://{tmp_path}/store", "--max-per-area", "4"], gateway(9)))
    assert crawled == {"1": {"written": 4, "skipped_duplicate": 0, "pii_redactions": 4}}
    assert len(json.loads(cli.run(spark, [*own, "crawl", "gateway", "--url", "u", "--areas", "1", "--dry-run"], gateway(9)))) == 3
    assert "Nguồn thô: gateway 6." in cli.run(spark, [*own, "gate", "--gateway", str(raw)])
    assert "| read | 6 |" in cli.run(spark, [*own, "prepare", "--gateway", str(raw), "--out", f"file://{tmp_path}/listings"])
    assert spark.read.parquet(f"file://{tmp_path}/listings").count() == 6
    assert "| Số phòng ngủ | 6/6 | 1,000 |" in cli.run(spark, [*own, "gold", "--gateway", str(raw)])
    assert cli.run(spark, [*own, "tables"]) == "" and cli.logger("x") is cli.logger("x") and cli.revision()
    assert len(money.FLAGS) == 24
