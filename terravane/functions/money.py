"""Money in text (it would leak the label) and the 24 text flags, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.text import deaccent, squeeze

PLACEHOLDER = " GIÁTIỀN "

#: Shapes of money, unit prices first; separators include the underscore that joins tokens.
_SEP = r"[\s_]*"
MONEY = [
    rf"(?iu)\d+[.,]?\d*{_SEP}(?:tỷ|tỉ|triệu|trieu|tr){_SEP}/?{_SEP}m{_SEP}[²2]",
    rf"(?iu)\d+[.,]?\d*{_SEP}(?:tỷ|tỉ|ty|ti){_SEP}\d*{_SEP}(?:triệu|trieu|tr)?",
    rf"(?iuU)\d+[.,]?\d*{_SEP}(?:triệu|trieu|tr|củ|cu)\b",
    rf"(?iu)\d{{9,}}{_SEP}(?:đ|vnd|vnđ|đồng|dong)?",
    rf"(?iuU)\d{{4,}}{_SEP}(?:đ|vnd|vnđ|đồng|dong)\b",
    rf"(?iuU)\bgiá{_SEP}[:\-]?{_SEP}\d+[.,]?\d*",
]
MONEY_LEFT = rf"(?iuU)(?:^|\W)(?:\d+[.,]?\d*{_SEP}(?:tỷ|tỉ|ty\b|ti\b|triệu|trieu|tr\b|củ\b)|\d{{4,}}{_SEP}(?:đồng|vnd|vnđ|đ)\b|\d{{9,}})"

#: Flags on accent-free text.
FLAGS = {
    "co_mat_tien": r"mat\s*tien|\bmt\b",
    "hem_xe_hoi": r"hem\s*xe\s*hoi|\bhxh\b|xe\s*hoi\s*vao",
    "hem_nho": r"hem\s*(?:nho|ba\s*gac|xe\s*may)|hem\s*[123]\s*m",
    "so_hong_rieng": r"so\s*hong\s*rieng|\bshr\b",
    "giay_tay": r"giay\s*tay|vi\s*bang",
    "ngop_bank": r"ngop|ngan\s*hang\s*siet|\bno\s*bank\b|ket\s*tien",
    "ban_gap": r"(?:ban|can|thanh\s*ly|xa)\s*gap|gap\s*(?:ban|can|thanh\s*ly)|can\s*ban\s*nhanh|ban\s*nhanh",
    "giam_gia": r"giam\s*gia|giam\s*\d|cat\s*lo|\blo\s*von\b",
    "moi_xay": r"moi\s*xay|nha\s*moi|xay\s*moi|vao\s*o\s*ngay",
    "cu_nat": r"nha\s*cu|nha\s*nat|can\s*sua|xuong\s*cap",
    "full_noi_that": r"full\s*noi\s*that|noi\s*that\s*day\s*du|hoan\s*thien",
    "gan_cho": r"gan\s*cho|sat\s*cho",
    "gan_truong": r"gan\s*truong|truong\s*hoc",
    "gan_benh_vien": r"gan\s*benh\s*vien",
    "gan_metro": r"metro|tuyen\s*so\s*\d",
    "kinh_doanh": r"kinh\s*doanh|\bkd\b|buon\s*ban|cho\s*thue\s*duoc",
    "thang_may": r"thang\s*may",
    "san_thuong": r"san\s*thuong",
    "o_to_do_cua": r"o\s*to\s*(?:do|ngu)\s*cua|oto\s*do\s*cua|xe\s*hoi\s*do\s*cua",
    "khu_dan_cu": r"khu\s*dan\s*cu|\bkdc\b|khu\s*compound",
    "no_hau": r"no\s*hau",
    "dinh_lo_gioi": r"lo\s*gioi|quy\s*hoach|dinh\s*quy\s*hoach",
    "chinh_chu": r"chinh\s*chu",
    "so_chung": r"so\s*chung|chung\s*so",
}

#: Function words; words of advertisements; words that tell of a price and always stay.
BASE_STOPWORDS = {
    "và", "của", "có", "các", "được", "cho", "với", "là", "trong", "này", "đã", "khi",
    "một", "những", "để", "tại", "từ", "hay", "hoặc", "nếu", "thì", "mà", "nên", "vì",
    "cũng", "rất", "sẽ", "đang", "bị", "ra", "vào", "lên", "xuống", "về", "theo", "như",
}
AD_STOPWORDS = {
    "liên", "hệ", "lh", "chính", "chủ", "xem", "nhà", "24", "7", "alo", "zalo", "call",
    "hotline", "em", "anh", "chị", "ạ", "nhé", "nha", "ib", "inbox", "quan", "tâm",
    "sđt", "sdt", "gọi", "ngay", "tel", "phone", "ms", "mr", "giatien",
}
PRICE_SIGNAL_WORDS = {
    "gấp", "ngộp", "kẹt", "giảm", "lỗ", "rẻ", "cắt", "thiện", "chí", "bank", "nợ",
    "thương", "lượng", "bao", "sang", "tên",
}
STOPWORDS = sorted((BASE_STOPWORDS | AD_STOPWORDS) - PRICE_SIGNAL_WORDS)


def strip_money(text: Column, passes: int = 4) -> Column:
    """Each money shape replaced by a placeholder, again until nothing new appears (at most ``passes`` times)."""
    out = F.coalesce(text, F.lit(""))
    for _ in range(passes):
        for pattern in MONEY:
            out = F.regexp_replace(out, pattern, PLACEHOLDER)
    return squeeze(out)


def money_left(text: Column) -> Column:
    """How many money-like tokens remain, by a stricter pattern."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(MONEY_LEFT))


def flags(text: Column) -> dict[str, Column]:
    t = deaccent(F.coalesce(text, F.lit("")))
    return {k: t.rlike(p).cast("int") for k, p in FLAGS.items()}


def normalise(text: Column) -> Column:
    """Lower case, single-spaced; punctuation stays, as a segmenter needs it."""
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def tokenize(text: Column, stopwords: Sequence[str] = STOPWORDS, segment: Callable[[Column], Column] = lambda c: c) -> Column:
    """Words without punctuation, stop words and single characters. ``segment`` joins the syllables of a word by underscores, if a
    segmenter is at hand; without one, words end at white space."""
    words = F.transform(F.split(segment(normalise(text)), " "), lambda w: F.trim(F.regexp_replace(w, r"(?U)[^\w\s]", ""), F.lit("_")))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stopwords)))


def pretokenize(text: Column, segment: Callable[[Column], Column] = lambda c: c) -> Column:
    """The words as one text, so that they are found once and not in every fit."""
    return F.array_join(tokenize(text, segment=segment), " ")


def analyzer(tokens: Column) -> Column:
    """The words of such a text."""
    return F.filter(F.split(F.coalesce(tokens, F.lit("")), " "), lambda w: w != "")
