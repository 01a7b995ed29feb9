"""Districts, wards and streets in addresses, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.text import UNKNOWN, flat, group, squeeze

#: Districts with a name, and those that were merged into another.
DISTRICTS = ["Bình Tân", "Bình Thạnh", "Gò Vấp", "Phú Nhuận", "Tân Bình", "Tân Phú", "Thủ Đức", "Bình Chánh", "Cần Giờ", "Củ Chi", "Hóc Môn", "Nhà Bè"]
MERGED = {2: "Thủ Đức", 9: "Thủ Đức"}
NOT_A_WARD = r"^(?:|tp\.?\s*hcm|tphcm|tp\.? ho chi minh|thanh pho ho chi minh|ho chi minh|viet nam|khong ro)$"
PROPERTY_TYPES = {
    "Nhà phố": ["nha", "nha mat pho", "nha ngo/hem", "nha pho lien ke", "nha rieng", "house", "singlefamilyresidence"],
    "Căn hộ chung cư": ["can ho/chung cu", "can ho chung cu", "can ho", "apartment"],
    "Biệt thự": ["biet thu", "biet thu/nha lien ke"],
    "Đất": ["dat", "land"],
    "Mặt bằng kinh doanh": ["shophouse", "shop", "van phong, mat bang kinh doanh", "office", "store"],
}


def district(c: Column) -> Column:
    """A named district in list order, else a numbered one (1 to 12, merged ones by their new name), else unknown."""
    t = flat(c)
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(UNKNOWN))
    for name in DISTRICTS:
        out = out.when(t.rlike(rf"\b{_plain(name)}\b"), F.lit(name))
    n = F.coalesce(group(t, r"\b(?:quan|q)\s*\.?\s*(\d{1,2})\b"), group(t, r"^(\d{1,2})$")).try_cast("int")
    for old, new in MERGED.items():
        out = out.when(n == old, F.lit(new))
    return out.when(n.between(1, 12), F.concat(F.lit("Quận "), n.cast("string"))).otherwise(F.lit(UNKNOWN))


def _plain(name: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", name.lower().replace("đ", "d")) if unicodedata.category(x) != "Mn")


def ward(c: Column) -> Column:
    """``Phường N`` or ``Phường <name>`` without its prefix; unknown for empty text and names of the city or country."""
    t = flat(c)
    n = F.coalesce(group(t, r"\b(?:phuong|p)\s*\.?\s*(\d{1,2})\b"), group(t, r"^(\d{1,2})$")).try_cast("int")
    name = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iu)^\s*(?:phường|phuong|p\.|xã|x\.|thị\s*trấn|tt\.)\s*", ""))
    return F.when(n.isNotNull(), F.concat(F.lit("Phường "), n.cast("string"))).when(flat(name).rlike(NOT_A_WARD), F.lit(UNKNOWN)).otherwise(F.concat(F.lit("Phường "), name))


def parse_address(c: Column) -> Column:
    """Struct (street, ward, district). Comma parts from the left: each is the district if it names one, else the ward if it is
    marked as ward or commune, else the street; the first part for each wins."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), squeeze), lambda p: p != "")
    is_ward = lambda p: p.rlike(r"(?iu)^(?:phường|phuong|p\.?\s*\d|p\.|xã\s|x\.|thị\s*trấn)")
    is_district = lambda p: ~is_ward(p) & (district(p) != UNKNOWN) & ~p.rlike(r"^\d+$")
    is_city = lambda p: flat(p).rlike(NOT_A_WARD)
    wards = F.filter(parts, is_ward)
    districts = F.filter(parts, is_district)
    streets = F.filter(parts, lambda p: ~is_ward(p) & ~is_district(p) & ~is_city(p))
    return F.struct(
        F.get(streets, 0).alias("street"),
        F.coalesce(ward(F.get(wards, 0)), F.lit(UNKNOWN)).alias("ward"),
        F.coalesce(district(F.get(districts, 0)), F.lit(UNKNOWN)).alias("district"),
    )


def resolved(parsed: Column) -> Column:
    """Whether a parsed address names its district."""
    return parsed["district"] != UNKNOWN


def property_type(c: Column) -> Column:
    """One of five types by its accent-free name; others are unknown."""
    table = F.create_map(*(F.lit(x) for kind, names in PROPERTY_TYPES.items() for n in names for x in (n, kind)))
    return F.coalesce(F.try_element_at(table, flat(c)), F.lit(UNKNOWN))
