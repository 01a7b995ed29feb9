"""Listings of three kinds of sources as one table: gateway records (JSON), pages (HTML records) and a history table.

Each loader gives the columns of ``SCHEMA`` that its source knows; ``unified`` puts them together. A structured value goes before
one from the text, and the columns ``*_from_text`` say where a value came from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import address, extract, price
from terravane.functions.text import UNKNOWN
from terravane.operators import cleaning, modeling

#: The columns of a listing, in order, and their types.
SCHEMA = {
    "listing_id": "string", "source": "string", "collected_at": "timestamp", "published_at": "timestamp", "title": "string", "description": "string",
    "total_price_vnd": "double", "price_kind": "string", "price_mismatch": "boolean", "area_m2": "double", "bedrooms": "double", "bathrooms": "double",
    "floors": "double", "frontage_m": "double", "alley_width_m": "double", "position": "string", "legal_status": "string", "direction": "string",
    "property_type": "string", "street": "string", "ward": "string", "district": "string", "ward_frame": "string", "latitude": "double",
    "longitude": "double", "area_from_text": "boolean", "bedrooms_from_text": "boolean", "floors_from_text": "boolean", "is_rental": "boolean",
}
CATEGORIES = ("position", "legal_status", "direction", "property_type", "street", "ward", "district", "ward_frame", "price_kind")
#: What a gateway's codes stand for.
LEGAL = {1: "sổ hồng", 2: "hợp đồng mua bán", 3: "giấy tay"}
DIRECTION = {1: "Đông", 2: "Tây", 3: "Nam", 4: "Bắc", 5: "Đông Bắc", 6: "Đông Nam", 7: "Tây Bắc", 8: "Tây Nam"}
HOUSE_TYPE = {1: "Nhà mặt phố", 2: "Nhà ngõ/hẻm", 3: "Nhà phố liền kề", 4: "Biệt thự"}
POSITION = {1: "mặt tiền", 2: "hẻm"}
#: Plausible ranges.
AREA, ROOMS, FLOORS, FRONTAGE = cleaning.VALID_AREA, (1, 20), (1, 15), (1.5, 30)
STRUCTURED = "structured"


def decoded(code: Column, table: Mapping[int, str], otherwise: Column | None = None) -> Column:
    """The meaning of a code; of an unknown or missing one ``otherwise``."""
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    known = F.try_element_at(names, code.try_cast("int"))
    return known if otherwise is None else F.coalesce(known, otherwise)


def stated(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _read(df: DataFrame, title: str, body: str) -> DataFrame:
    """Columns found_<name>: the attributes that the text states. They are columns rather than fields of a struct, which Spark
    would take apart and evaluate again wherever a field is used."""
    return df.withColumns({f"found_{k}": c for k, c in extract.extract_all(F.col(title), F.col(body)).items()})


def _priced(number: Column, text: Column, area: Column) -> tuple[Column, Column]:
    """Total and its kind: the number where there is one, else what the text says."""
    own, read = price.numeric_price(number), price.parse_price(text, area)
    return F.coalesce(own, read["total"]), F.when(own.isNotNull(), F.lit(STRUCTURED)).otherwise(read["kind"])


def _listing(df: DataFrame, source: str, own: Mapping[str, Column]) -> DataFrame:
    columns = {"source": F.lit(source), **own}
    out = df.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()))
    return out.withColumn("is_rental", price.looks_like_rental(F.col("title"), F.col("total_price_vnd")))


def _places(df: DataFrame, mapping: DataFrame, old: Column, new: Column, district: Column) -> DataFrame:
    """Columns ward, district_resolved and ward_frame."""
    named = df.withColumns({"own_ward": address.ward(old), "new_ward": address.ward(new), "own_district": address.district(district)})
    return modeling.resolve_wards(named, mapping, "own_ward", "new_ward", "own_district")


def from_gateway(records: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """Records of a gateway: numbers and codes, times in epoch milliseconds, wards of either frame (``mapping``: new to old)."""
    d = _places(_read(records, "subject", "body"), mapping, F.col("ward_name"), F.col("ward_name_v3"), F.col("area_name"))
    area, area_text = cleaning.pick(F.col("size"), F.col("found_area_m2"), *AREA)
    bedrooms, bedrooms_text = cleaning.pick(F.col("rooms"), F.col("found_bedrooms"), *ROOMS)
    floors, floors_text = cleaning.pick(F.col("floors"), F.col("found_floors"), *FLOORS)
    total, kind = _priced(F.col("price"), F.col("price_string"), F.col("size"))
    unit = price.numeric_price(F.col("price_million_per_m2")) * 1e6
    return _listing(
        d,
        source,
        {
            "listing_id": F.concat(F.lit(f"{source}-"), F.col("list_id").cast("string")),
            "collected_at": F.col("_collected_at"),
            "published_at": F.timestamp_millis(F.col("list_time").cast("string").try_cast("long")),
            "title": F.col("subject"),
            "description": F.col("body"),
            "total_price_vnd": total,
            "price_kind": kind,
            "price_mismatch": ~price.cross_checks(total, unit, area),
            "area_m2": area,
            "bedrooms": bedrooms,
            "bathrooms": cleaning.pick(F.col("toilets"), F.col("found_bathrooms"), *ROOMS)[0],
            "floors": floors,
            "frontage_m": cleaning.pick(F.col("width"), F.col("found_frontage_m"), *FRONTAGE)[0],
            "alley_width_m": F.col("found_alley_width_m"),
            "position": decoded(F.col("house_type"), POSITION, F.col("found_position")),
            "legal_status": decoded(F.col("property_legal_document"), LEGAL, F.col("found_legal_status")),
            "direction": decoded(F.col("direction"), DIRECTION, F.col("found_direction")),
            "property_type": address.property_type(decoded(F.col("house_type"), HOUSE_TYPE, F.col("category_name"))),
            "street": stated(F.col("street_name")),
            "ward": F.col("ward"),
            "district": F.col("district_resolved"),
            "ward_frame": F.col("ward_frame"),
            "latitude": F.col("latitude"),
            "longitude": F.col("longitude"),
            "area_from_text": area_text,
            "bedrooms_from_text": bedrooms_text,
            "floors_from_text": floors_text,
        },
    )


def from_pages(records: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """Records of detail pages: everything is text, dates are dd/mm/yyyy, the address is one line, the area is read from its field."""
    d = _read(records, "title", "description").withColumn("place", address.parse_address(F.col("address")))
    d = _places(d, mapping, F.col("place.ward"), F.lit(None).cast("string"), F.col("place.district"))
    field = F.coalesce(*(stated(F.col(c)) for c in ("usable_area_text", "land_area_text", "area_text")))
    area, area_text = cleaning.pick(extract.extract_all(field, F.lit(""))["area_m2"], F.col("found_area_m2"), *AREA)
    bedrooms, bedrooms_text = cleaning.pick(F.col("bedrooms_text"), F.col("found_bedrooms"), *ROOMS)
    floors, floors_text = cleaning.pick(F.col("floors_text"), F.col("found_floors"), *FLOORS)
    total, kind = _priced(F.col("price_vnd_ld"), F.col("price_text"), F.col("found_area_m2"))
    return _listing(
        d,
        source,
        {
            "listing_id": F.concat(F.lit(f"{source}-"), F.col("listing_id").cast("string")),
            "collected_at": F.col("_collected_at"),
            "published_at": F.try_to_timestamp(F.col("posted_at_text"), F.lit("dd/MM/yyyy")),
            "title": F.col("title"),
            "description": F.col("description"),
            "total_price_vnd": total,
            "price_kind": kind,
            "price_mismatch": F.lit(False),
            "area_m2": area,
            "bedrooms": bedrooms,
            "bathrooms": cleaning.pick(F.col("bathrooms_text"), F.col("found_bathrooms"), *ROOMS)[0],
            "floors": floors,
            "frontage_m": cleaning.pick(F.col("frontage_text"), F.col("found_frontage_m"), *FRONTAGE)[0],
            "alley_width_m": F.col("found_alley_width_m"),
            "position": F.col("found_position"),
            "legal_status": F.coalesce(stated(F.col("legal_status")), F.col("found_legal_status")),
            "direction": F.coalesce(stated(F.col("direction")), F.col("found_direction")),
            "property_type": address.property_type(F.col("property_type_ld")),
            "street": F.col("place.street"),
            "ward": F.col("ward"),
            "district": F.col("district_resolved"),
            "ward_frame": F.col("ward_frame"),
            "latitude": F.col("latitude"),
            "longitude": F.col("longitude"),
            "area_from_text": area_text,
            "bedrooms_from_text": bedrooms_text,
            "floors_from_text": floors_text,
        },
    )


#: The columns of the history table that are kept.
HISTORY = (
    "name", "description", "property_type_name", "province_name", "district_name", "ward_name", "street_name", "project_name", "price", "area", "floor_count",
    "frontage_width", "house_depth", "road_width", "bedroom_count", "bathroom_count", "house_direction", "balcony_direction", "published_at",
)


def history_rows(table: DataFrame, province: str, cutoff: str | None = None, columns: Sequence[str] = HISTORY) -> DataFrame:
    """Rows of a province up to a day (None: all days), absent columns null. Both filters and the columns reach the scan."""
    rows = table.filter(F.col("province_name") == province)
    if cutoff is not None:
        rows = rows.filter(F.col("published_at") <= F.lit(cutoff).cast("timestamp"))
    return rows.select(*((F.col(c) if c in table.columns else F.lit(None)).alias(c) for c in columns))


def from_history(table: DataFrame, source: str, id_: str, sample: int | None = None, seed: int = modeling.SEED) -> DataFrame:
    """A history table with numeric columns, in the old wards; floors come from the text where the column is null. ``sample``: that
    many rows, the first by a hash of the id."""
    if sample is not None:
        table = table.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string"))), id_).limit(sample)
    d = _read(table, "name", "description")
    numbers = {"area_m2": "area", "bedrooms": "bedroom_count", "bathrooms": "bathroom_count", "frontage_m": "frontage_width", "alley_width_m": "road_width"}
    return _listing(
        d,
        source,
        {
            "listing_id": F.concat(F.lit(f"{source}-"), F.col(id_).cast("string")),
            "published_at": F.col("published_at"),
            "title": F.col("name"),
            "description": F.col("description"),
            "total_price_vnd": price.numeric_price(F.col("price")),
            "price_kind": F.lit(STRUCTURED),
            "price_mismatch": F.lit(False),
            **{to: F.col(c) for to, c in numbers.items()},
            "floors": F.coalesce(F.col("floor_count").cast("double"), F.col("found_floors").cast("double")),
            "position": F.col("found_position"),
            "legal_status": F.col("found_legal_status"),
            "direction": F.col("house_direction"),
            "property_type": address.property_type(F.col("property_type_name")),
            "street": F.col("street_name"),
            "ward": address.ward(F.col("ward_name")),
            "district": address.district(F.col("district_name")),
            "ward_frame": F.lit("old"),
            "area_from_text": F.lit(False),
            "bedrooms_from_text": F.lit(False),
            "floors_from_text": F.col("floor_count").isNull() & F.col("found_floors").isNotNull(),
        },
    )


def unified(sources: Sequence[DataFrame]) -> DataFrame:
    """All listings in the schema's order; missing categories are unknown."""
    return cleaning.unify(sources, list(SCHEMA), CATEGORIES, UNKNOWN)
