"""Attributes of listings in text, as column expressions over ``flat`` text (see terravane.functions.text.flat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.text import contexts, first_matching, flat, group, let

#: Patterns on accent-free lower-case text.
NUMBER = r"(\d+(?:[.,]\d+)?)"
DIMENSIONS = NUMBER + r"\s*m?\s*[x*×]\s*" + NUMBER + r"\s*m?\b"
WIDTH_LENGTH = r"ngang\s*" + NUMBER + r"\s*m?\D{0,12}?(?:dai|sau)\s*" + NUMBER + r"\s*m?\b"
AREA = NUMBER + r"\s*(?:m2|mv|m)\b"
AREA_LABEL = r"dt|dtcn|dtsd|dien\s*tich|cong\s*nhan|\bcn\b|so\s*do|shr"
CERTIFIED = r"cong\s*nhan|dtcn|\bcn\b"
BEDROOMS = r"(\d{1,2})\s*(?:pn\b|phong\s*ngu|p\.?n\b|bedroom|phong\b(?!\s*(?:khach|tam|bep|an\b|tho\b|giat|ve\s*sinh|karaoke|gym))|p\b)"
BEDROOMS_AFTER = r"(?:phong\s*ngu|pn)\s*[:\-]?\s*(\d{1,2})\b"
BATHROOMS = r"(\d{1,2})\s*(?:wc\b|toilet|nha\s*tam|phong\s*tam|vs\b)"
BATHROOMS_AFTER = r"(?:wc|toilet|nha\s*tam)\s*[:\-]?\s*(\d{1,2})\b"
ALLEY_BEFORE = r"(?<!(?:hem|hxh|ngo)\s{0,3}(?:rong|ngang)?\s{0,3}[:\-]?\s{0,3})"
FRONTAGE = ALLEY_BEFORE + r"(?:mat\s*tien|mt|ngang|rong)\s*[:\-]?\s*" + NUMBER + r"\s*m\b"
ALLEY_WIDTH = r"(?:hem|hxh|ngo)\s*(?:rong|ngang)?\s*[:\-]?\s*" + NUMBER + r"\s*m\b"
UPPER_FLOORS = r"(\d{1,2})\s*(?:lau|tam\b|me\b(?!\s*con))"
UPPER_WORDS = r"\b(mot|hai|ba|bon|nam|sau|bay|tam|chin)\s*(?:lau|tam\b)"
NUMBER_WORDS = {"mot": 1, "hai": 2, "ba": 3, "bon": 4, "nam": 5, "sau": 6, "bay": 7, "tam": 8, "chin": 9}
LEGAL = [
    ("sổ hồng riêng", r"\bshr\b|so\s*hong\s*rieng"),
    ("sổ hồng", r"so\s*hong|\bsh\b|so\s*do|\bsd\b|so\s*rieng"),
    ("hợp đồng mua bán", r"hdmb|hop\s*dong\s*mua\s*ban"),
    ("giấy tay", r"giay\s*tay|vi\s*bang|giay\s*viet\s*tay"),
    ("đang chờ sổ", r"dang\s*cho\s*so|cho\s*ra\s*so|dang\s*lam\s*so"),
]
DIRECTION = [
    ("Đông Bắc", r"\bdong\s*bac\b"),
    ("Đông Nam", r"\bdong\s*nam\b"),
    ("Tây Bắc", r"\btay\s*bac\b"),
    ("Tây Nam", r"\btay\s*nam\b"),
    ("Đông", r"huong\s*dong\b"),
    ("Tây", r"huong\s*tay\b"),
    ("Nam", r"huong\s*nam\b"),
    ("Bắc", r"huong\s*bac\b"),
]
POSITION = [("mặt tiền", r"\b(?:mat\s*tien|mt)\b"), ("hẻm", r"\b(?:hem|hxh|hxt|ngo)\b")]
#: Characters around an area that tell what it is.
CONTEXT = 24


def value(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).try_cast("double")


def within(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def dimensions(t: Column) -> Column:
    """Struct (width, length) of the first plausible pair, a labelled one before ``W x L``; null without."""

    def pairs(pattern: str) -> Column:
        w, n = (F.transform(F.regexp_extract_all(t, F.lit(pattern), i), value) for i in (1, 2))
        both = F.transform(F.arrays_zip(w.alias("w"), n.alias("n")), lambda p: F.struct(p["w"].alias("width"), p["n"].alias("length")))
        return F.get(F.filter(both, lambda p: p["width"].between(1.5, 50) & p["length"].between(3, 200)), 0)

    return F.coalesce(pairs(WIDTH_LENGTH), pairs(DIMENSIONS))


def area(t: Column) -> Column:
    """The number with an area unit whose surroundings speak most for an area (certified 2, labelled 1, bare 0; the first of
    equals), within 10 to 1,000; a bare ``m`` needs a label; parts of ``W x L`` don't count. Else width times length."""

    def better(acc: Column, c: Column) -> Column:
        v = value(F.regexp_extract(c["match"], NUMBER, 1))
        score = F.when(F.concat(c["left"], F.lit(" "), c["right"]).rlike(CERTIFIED), 2).when(c["left"].rlike(AREA_LABEL), 1).otherwise(0)
        part = c["left"].rlike(r"[x*×]\s*$") | c["right"].rlike(r"^\s*[x*×]")
        able = v.between(10, 1000) & ~(c["match"].rlike(r"m$") & (score == 0)) & ~part
        wins = F.coalesce(able & (score > acc["score"]), F.lit(False))
        return F.when(wins, F.struct(score.alias("score"), v.alias("value"))).otherwise(acc)

    begin = F.struct(F.lit(-1).alias("score"), F.lit(None).cast("double").alias("value"))
    best = F.aggregate(contexts(t, AREA, CONTEXT), begin, better, lambda a: a["value"])
    d = dimensions(t)
    return F.coalesce(best, within(F.bround(d["width"] * d["length"], 1), 10, 1000))


def count_in(t: Column, patterns: list[str], high: int) -> Column:
    """The first match of the first pattern that gives 1 to ``high``."""
    found = [group(t, p).try_cast("int") for p in patterns]
    return F.coalesce(*(F.when(f.between(1, high), f) for f in found))


def bedrooms(t: Column) -> Column:
    return count_in(t, [BEDROOMS, BEDROOMS_AFTER], 20)


def bathrooms(t: Column) -> Column:
    return count_in(t, [BATHROOMS, BATHROOMS_AFTER], 20)


def floors(t: Column) -> Column:
    """1 for a one-storey house; a stated total; else ground + mezzanine + upper floors, and one more if only upper floors are
    named; 1 to 15."""
    ground = t.rlike(r"\b(?:tret|ham|ban\s*ham)\b").cast("int")
    mezzanine = t.rlike(r"\blung\b").cast("int")
    words = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    upper = F.coalesce(group(t, UPPER_FLOORS).try_cast("int"), F.try_element_at(words, group(t, UPPER_WORDS)), F.when(t.rlike(r"\blau\b(?!\s*(?:dai|nam))"), 1))
    total = F.coalesce(upper, F.lit(0)) + ground + mezzanine + F.when(upper.isNotNull() & (ground == 0), 1).otherwise(0)
    out = F.when(t.rlike(r"\bcap\s*4\b"), F.lit(1)).otherwise(F.coalesce(group(t, r"(\d{1,2})\s*tang\b").try_cast("int"), F.when(total > 0, total)))
    return within(out, 1, 15)


def frontage(t: Column) -> Column:
    """The first frontage in metres that is no alley's width; without any, the width of the lot."""
    stated = value(group(t, FRONTAGE))
    return F.when(stated.isNotNull(), within(stated, 1.5, 30)).otherwise(dimensions(t)["width"])


def alley_width(t: Column) -> Column:
    return within(value(group(t, ALLEY_WIDTH)), 1, 20)


def extract_all(title: Column, body: Column) -> dict[str, Column]:
    """All attributes of a listing by name."""
    t = flat(F.concat_ws("\n", title, body))
    own = {
        "area_m2": area,
        "bedrooms": bedrooms,
        "bathrooms": bathrooms,
        "floors": floors,
        "frontage_m": frontage,
        "alley_width_m": alley_width,
        "position": lambda t: first_matching(t, POSITION),
        "legal_status": lambda t: first_matching(t, LEGAL),
        "direction": lambda t: first_matching(t, DIRECTION),
    }
    return {name: let(t, read) for name, read in own.items()}
