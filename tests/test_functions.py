import pytest
from pyspark.sql import functions as F

from terravane.functions import address, extract, phones, price
from terravane.functions.text import flat

PRICES = [
    ("5 tỷ 2", None, 5.2e9), ("5,2 tỷ", None, 5.2e9), ("5 tỷ 200 triệu", None, 5.2e9), ("5200 triệu", None, 5.2e9), ("52 triệu/m²", 100.0, 5.2e9),
    ("4ty9", None, 4.9e9), ("5 tỷ 25", None, 5.25e9), ("13900000000", None, 1.39e10), ("5.850 tỷ", None, 5.85e9), ("5.200 triệu", None, 5.2e9),
    ("giá 9.29 tỷ", None, 9.29e9), ("thoả thuận", None, None), ("Giá liên hệ", None, None), ("", None, None), (None, None, None), ("52 triệu/m²", None, None),
]
FLOORS = [("1 trệt 2 lầu", 3), ("trệt lửng 2 lầu", 4), ("nhà 3 tầng", 3), ("nhà lầu", 2), ("nhà đúc 3 tấm", 4), ("tám lầu", 9), ("nhà cấp 4", 1), ("sử dụng lâu dài", None), ("nhà 2 mẹ con", None)]
WARDS = [("13", "Phường 13"), ("P.13", "Phường 13"), ("Thảo Điền", "Phường Thảo Điền"), (None, "không rõ"), ("  ", "không rõ"), ("TP.HCM", "không rõ"), ("Việt Nam", "không rõ")]
HIDDEN = [
    "Liên hệ 0901234567 xem nhà", "LH 0901 234 567 chính chủ", "sđt 0901.234.567", "Call 0901-234-567 gặp Ms Lan", "Zalo +84 901 234 567", "hotline 84901234567",
    "SDT: 0901*234*567", "Điện thoại (028) 3822 1234", "LH O9O1234567 xem nhà ngay", "lh 09Ol234567", "sdt 0901\u200b234\u200b567", "lien he ٠٩٠١٢٣٤٥٦٧",
    "gọi 0️⃣9️⃣0️⃣1️⃣2️⃣3️⃣4️⃣5️⃣6️⃣7️⃣ nhé", "liên hệ không chín không một hai ba bốn năm sáu bảy", "Bán đất 5x20 0901234567", "Nhà 1/23 0908123456", "LH 09OOO23456 xem nhà", "Liên hệ 09\u03361234567",
]
OTHER = [
    "Nhà 2 tầng, diện tích 4x15 = 60m2, giá 5,2 tỷ", "Giá 850.000.000 đồng, bao sang tên", "Giá 950.000.000, sổ hồng riêng", "Mã tin 573829145, đăng hôm nay", "Giá 3.500.000.000 đồng, thương lượng",
    "Đăng ngày 01.02.2026, sổ hồng riêng", "Hẻm 6m thông, cách chợ 300m, xây năm 2018", "Mặt tiền đường Trường Chinh, ngang 4m dài 15m", "Căn hộ 2PN 2WC, 68m2, ban công hướng Đông Nam", "", "OO lll",
]
AREAS = [
    ("nha 50mx dt 50m", 50.0), ("dt 50m", 50.0), ("ban nha 60mat, dien tich 60m gia tot", 60.0), ("dt 55m2, cong nhan 48,5 m2, xay 50m2", 55.0), ("dt 55m2 xay dung kien co va thoang mat, cong nhan 48,5 m2", 48.5), ("cach cho 500m, nha 4x16", 64.0), ("4m x 15m", 60.0),
    ("100m2 5x20", 100.0), ("hem 6m", None), ("dt: 9 m2", None), ("cong nhan 40m2 va cong nhan 45m2", 40.0), ("dt 70mx 20, dt 80 mv", 80.0), ("", None), (None, None), ("50m2 50m2 dtcn 50m2x", 50.0),
]


def test_prices(spark):
    df = spark.createDataFrame(PRICES, "t string, a double, want double")
    rows = df.select("t", "want", price.parse_price(F.col("t"), F.col("a"))["total"].alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]


def test_floors_and_wards(spark):
    rows = spark.createDataFrame(FLOORS, "t string, want int").select("t", "want", extract.floors(flat(F.col("t"))).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]
    rows = spark.createDataFrame(WARDS, "t string, want string").select("t", "want", address.ward(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]


def test_areas(spark):
    rows = spark.createDataFrame(AREAS, "t string, want double").select("t", "want", extract.area(flat(F.col("t"))).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]


def test_phones_are_cut_exactly():
    m = phones.MARKER
    for text, want in (
        ("Nhà 60m2, giá 5,2 tỷ, LH 0901234567 gặp chủ", f"Nhà 60m2, giá 5,2 tỷ, LH {m} gặp chủ"), ("0901234567 0987654321", f"{m} {m}"), ("Bán đất 5x20 0901234567", f"Bán đất 5x20 {m}"),
        ("Gọi 0901234567 hoặc 0987654321", f"Gọi {m} hoặc {m}"), ("gọi 0️⃣9️⃣0️⃣1️⃣2️⃣3️⃣4️⃣5️⃣6️⃣7️⃣ nhé", f"gọi {m} nhé"), ("x² 0901234567", f"x² {m}"), ("Zalo +84 901 234 567", f"Zalo +{m}"),
    ):
        assert phones.scrub(text)[0] == want


def test_records_at_any_depth(spark):
    from pyspark.sql import types as T

    kind = T._parse_datatype_string("ad struct<seller_info:struct<phone:string>,body:string>, phone string, tags array<struct<Email:string,t:string>>, m map<string,array<string>>, n int")
    row = ((("0901234567",), "sdt 0909888777"), "1", [("x", "lh 0901234567"), (None, None)], {"k": ["gọi 0901234567", "giá 5,2 tỷ"], "ZALO": ["0901234567"]}, 3)
    out = phones.scrub_rows(spark.createDataFrame([row], kind))
    assert out.columns == ["ad", "tags", "m", "n"]
    r = out.first().asDict(recursive=True)
    m = phones.MARKER
    assert r == {"ad": {"body": f"sdt {m}"}, "tags": [{"t": f"lh {m}"}, {"t": None}], "m": {"k": [f"gọi {m}", "giá 5,2 tỷ"]}, "n": 3}


@pytest.mark.parametrize("text", HIDDEN)
def test_hidden_phones(text):
    clean, hits = phones.scrub(text)
    assert hits >= 1 and phones.find_phones(clean) == []


@pytest.mark.parametrize("text", OTHER)
def test_other_numbers_stay(text):
    assert phones.scrub(text) == (text, 0)


def test_entry_and_queries_have_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
