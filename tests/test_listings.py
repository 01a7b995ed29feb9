"""Loaders of the three kinds of sources."""

import datetime

import pytest

from terravane.sources import listings


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame([("Phường Mới", "Phường 5", "Quận 3", 0.9)], "new_ward string, old_ward string, old_district string, majority_share double")


GATEWAY = """list_id long, list_time long, subject string, body string, price double, price_string string, price_million_per_m2 double, size double, rooms int, floors int,
 toilets int, width double, house_type int, property_legal_document int, direction int, category_name string, street_name string, ward_name string, ward_name_v3 string,
 area_name string, latitude double, longitude double, _collected_at timestamp"""


def test_gateway_records(spark, mapping):
    rows = [
        (1, 1704067200000, "Bán nhà", "4 phòng ngủ, hướng Tây", 5e9, None, 100.0, 50.0, None, 3, 2, 4.0, 1, 1, 6, "Nhà ở", "Lê Lợi", "Phường 13", None, "Quận 10", 10.5, 106.5, None),
        (2, None, "Cho thuê nhà", None, 1.0, "5 tỷ", None, None, 99, None, None, None, 9, None, None, "Căn hộ/Chung cư", "", None, "Phường Mới", None, None, None, None),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = {r["listing_id"]: r for r in listings.unified([listings.from_gateway(spark.createDataFrame(rows, GATEWAY), mapping, "g")]).collect()}
    a, b, c = out["g-1"], out["g-2"], out["g-3"]
    assert list(a.asDict()) == list(listings.SCHEMA) and a["published_at"] is not None
    assert (a["total_price_vnd"], a["price_kind"], a["price_mismatch"], a["bedrooms"], a["bedrooms_from_text"], a["floors"], a["floors_from_text"]) == (5e9, "structured", False, 4, True, 3, False)
    assert (a["position"], a["legal_status"], a["direction"], a["property_type"], a["ward"], a["district"], a["ward_frame"]) == ("mặt tiền", "sổ hồng", "Đông Nam", "Nhà phố", "Phường 13", "Quận 10", "old")
    assert (b["total_price_vnd"], b["price_kind"], b["bedrooms"], b["property_type"], b["street"]) == (5e9, "total", None, "Căn hộ chung cư", "không rõ")
    assert (b["ward"], b["district"], b["ward_frame"], b["is_rental"]) == ("Phường 5", "Quận 3", "mapped", True)
    assert c["total_price_vnd"] is None and c["ward_frame"] == "unmapped" and not c["is_rental"] and not c["price_mismatch"]


def test_pages_and_history(spark, mapping):
    names = "listing_id title description price_vnd_ld price_text usable_area_text land_area_text area_text bedrooms_text floors_text bathrooms_text frontage_text legal_status direction property_type_ld address posted_at_text".split()
    kind = ", ".join(f"{n} string" for n in names) + ", latitude double, longitude double, _collected_at timestamp"
    page = ("7", "Nhà 1 trệt 2 lầu", "sổ hồng", None, "52 triệu/m²", "", "100 m2", None, "3", None, None, None, "", "Đông", "House", "Lê Lợi, Phường 5, Quận 3, TPHCM", "31/12/2024", None, None, None)
    p = listings.from_pages(spark.createDataFrame([page, ("8", *[None] * 19)], kind), mapping, "p")
    table = "k long, name string, description string, price double, published_at timestamp, area double, bedroom_count int, bathroom_count int, floor_count int, frontage_width double, road_width double, house_direction string, property_type_name string, street_name string, ward_name string, district_name string"
    day = datetime.datetime(2024, 5, 1)
    rows = [(i, "Nhà 3 tầng", None, 3e9, day, 40.0, 2, 1, None if i else 5, None, None, None, "Biệt thự", None, "P.13", "Q.3") for i in range(4)]
    h = listings.from_history(spark.createDataFrame(rows, table), "h", "k")
    out = {r["listing_id"]: r for r in listings.unified([p, h]).collect()}
    a, b = out["p-7"], out["h-1"]
    assert (a["area_m2"], a["area_from_text"], a["bedrooms"], a["floors"], a["floors_from_text"], a["legal_status"], a["direction"]) == (100, False, 3, 3, True, "sổ hồng", "Đông")
    assert (a["street"], a["ward"], a["district"], a["published_at"].date()) == ("Lê Lợi", "Phường 5", "Quận 3", datetime.date(2024, 12, 31))
    assert (b["floors"], b["floors_from_text"], out["h-0"]["floors"], b["ward"], b["district"], b["property_type"], b["direction"]) == (3, True, 5, "Phường 13", "Quận 3", "Biệt thự", "không rõ")
    assert len(out) == 6 and listings.from_history(spark.createDataFrame(rows, table), "h", "k", sample=2).count() == 2


def test_history_rows_of_a_province_up_to_a_day(spark, tmp_path):
    day = lambda d: datetime.datetime(2025, 6, d)
    spark.createDataFrame([("a", "X", 1.0, day(1)), ("b", "X", 2.0, day(30)), ("c", "Y", 3.0, day(1))], "name string, province_name string, price double, published_at timestamp").write.parquet(f"{tmp_path}/h")
    table = spark.read.parquet(f"{tmp_path}/h")
    out = listings.history_rows(table, "X", "2025-06-15")
    assert out.columns == list(listings.HISTORY) and [(r["name"], r["area"]) for r in out.collect()] == [("a", None)] and listings.history_rows(table, "X").count() == 2
