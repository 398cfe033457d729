"""Scalar text functions as column expressions: normalisers, constraint parsers, search terms, keys.

Word borders are ASCII, and blanks include the Unicode ones, whatever the regular expression engine would say.
All functions take null as the empty text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------------------------
STOP_WORDS = (
    "tim giup anh em cho minh toi ma nao con hang linh kien co cua nay nhung cac mot nhieu duoc thuoc dang day do voi va "
    "theo can muon xin hay loai cai nhin hinh dac diem giong tuong tu uu tien vi tri nhan nhan-dang"
).split()
STOP_WORDS_V4 = (
    "anh em giup tim loc cho con hang linh kien image photo hinh nay phan tich giong search find please the and voi cua "
    "trong tren duoi nhung cac co mot nhieu duoc thuoc dang day do"
).split()
SHAPES = {
    "oval": "oval|bau duc|ellipse|elliptical",
    "round": "tron|round|circular",
    "rectangular": "chu nhat|rectangular|rectangle",
    "square": "vuong|square",
    "l_shape": "chu l|l shape|l-shaped",
    "u_shape": "chu u|u shape|u-shaped",
}
SIDES = {"left": "ben trai|trai|left|lhf", "right": "ben phai|phai|right|rhf", "both": "ca hai|hai ben|both"}
COLORS = {
    "gray": "xam|ghi|gray|grey",
    "black": "den|black",
    "white": "trang|white",
    "green": "xanh la|green",
    "blue": "xanh duong|blue",
    "red": "do|red",
    "yellow": "vang|yellow",
}
COLORS_V4 = {
    "gray": ("xam", "gray", "grey"),
    "black": ("den", "black"),
    "white": ("trang", "white"),
    "red": ("do", "red"),
    "blue": ("xanh duong", "blue"),
    "green": ("xanh la", "green"),
    "yellow": ("vang", "yellow"),
    "brown": ("nau", "brown"),
    "beige": ("beige", "kem", "cream"),
}
ANCHOR_SHAPES = {"oval": "oval", "round": "tròn", "rectangular": "chữ nhật", "square": "vuông"}
ANCHOR_SIDES = {"left": "trái", "right": "phải"}
ANCHOR_COLORS = {"gray": "xám", "black": "đen", "white": "trắng"}
HINTS = {
    "bushing": ("bushing", "bac lot", "bac", "cao su", "rubber"),
    "mau xam": ("xam", "gray", "grey"),
    "mau den": ("den", "black"),
    "mau trang": ("trang", "white"),
    "lo": ("lo", "hole", "holes"),
    "flange": ("flange", "vien", "go"),
    "ngam": ("ngam", "clip", "hook"),
    "oval": ("oval", "bau duc"),
    "tron": ("tron", "round"),
}
INTENT_TERMS = (
    "catalogue,catalog,mã,ma hang,mã hàng,linh kiện,con hàng,id,code,part,bushing,bracket,clip,hook,ngàm,ngam,lỗ,lo,hole,oval,"
    "tròn,tron,trái,trai,phải,phai,left,right,lhf,rhf,màu,mau,xám,xam,đen,den,hình dạng,hinh dang,đặc điểm,dac diem,vị trí,"
    "vi tri,giống,giong,tương tự,tuong tu"
).split(",")
GREETING = "^(hello|hi|hey|xin chao|chao|chao em|hello em|alo|good (morning|afternoon|evening))( (em|denis|anh|ban))?$"
HOLE = r"(?:^|\s)(\d+)\s*(?:lo|hole|holes)(?:\s|$)"
LOOSE_HOLE = r"(\d+)\s*(?:lỗ|lo|hole|holes)"
EXACT_TOKEN = "[A-Za-z0-9][A-Za-z0-9._-]{3,}"
EXTENSIONS = {"image/webp": "webp", "image/png": "png", "image/jpeg": "jpg"}
PUNCTUATION = ".,;:!?()[]{}\"'`"
#: Blanks of the query language beyond those of ASCII.
WIDE_BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
# -----------------------------------------------------------------------------------------------------------------


def _folds(form: str) -> tuple[str, str]:
    """Characters that decompose to one base character and combining marks, and their bases."""
    pairs = []
    for code in range(0xA0, 0xFFFF):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize(form, c) if not 0x300 <= ord(x) <= 0x36F)
            if plain != c and len(plain) == 1:
                pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_NFD, _NFKD = _folds("NFD"), _folds("NFKD")


def _several() -> dict[str, str]:
    """Compatibility characters (ligatures, fractions, numbers in circles, units) of several base characters, with a
    letter or digit among them; what has none is a blank to all normalisers anyway."""
    found = {}
    for code in range(0xA0, 0xFFFF):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(x) <= 0x36F)
        if len(plain) > 1 and re.search("[A-Za-z0-9]", plain):
            found[chr(code)] = plain
    return found


_SEVERAL = _several()


def _class(characters: list[str]) -> str:
    """A pattern of one of the characters, in ranges; plain ones fail at its first test."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "(?![\\x00-\\x9F])[" + "".join(f"\\u{x:04X}-\\u{y:04X}" for x, y in runs) + "]"


_SEVERAL_CLASS = _class(list(_SEVERAL))


def expanded(text: Column) -> Column:
    """text with those characters written out; texts without one are left alone."""
    known = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")
    found = F.regexp_extract_all(text, F.lit(_SEVERAL_CLASS), F.lit(0))
    each = F.zip_with(F.split(text, _SEVERAL_CLASS, -1), found, lambda before, x: F.concat(before, F.coalesce(known[x], F.lit(""))))
    return F.when(text.rlike(_SEVERAL_CLASS), F.array_join(each, "")).otherwise(text)


def strip_marks(text: Column, compatible: bool = False) -> Column:
    """Canonical (or compatible) decomposition without combining marks."""
    source, target = _NFKD if compatible else _NFD
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.translate(expanded(text) if compatible else text, source, target), r"[\u0300-\u036F]", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, WIDE_BLANKS, " " * len(WIDE_BLANKS)), r"[\s\x0B]+", " "))


def norm_v5(text: Column) -> Column:
    """Marks stripped, lower case, punctuation to blanks, blanks collapsed; the barred d stays."""
    return collapse(F.translate(F.lower(strip_marks(text)), PUNCTUATION, " " * len(PUNCTUATION)))


def norm_v4(text: Column) -> Column:
    """Marks stripped, small barred d to d, then lower case, all else to blanks: a capital barred d is lost."""
    return F.trim(F.regexp_replace(F.lower(F.translate(strip_marks(text, True), "đ", "d")), "[^a-z0-9]+", " "))


def norm_v1(text: Column) -> Column:
    """As norm_v4, but lower case comes before the barred d."""
    return F.trim(F.regexp_replace(F.translate(F.lower(strip_marks(text, True)), "đ", "d"), "[^a-z0-9]+", " "))


def norm_intent(text: Column) -> Column:
    return F.trim(F.lower(strip_marks(text)))


def bounded(pattern: str) -> str:
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def first_of(text: Column, patterns: dict[str, str]) -> Column:
    """The first name whose pattern stands in text as words, else null."""
    return F.coalesce(*(F.when(text.rlike(bounded(p)), F.lit(name)) for name, p in patterns.items()))


def number(text: Column) -> Column:
    return F.when(text == "", None).otherwise(text.cast("long"))


def hole_count(normalized: Column) -> Column:
    return number(F.regexp_extract(normalized, HOLE, 1))


def loose_hole_count(text: Column) -> Column:
    """On merely lower-cased text, without a border behind the word."""
    return number(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), LOOSE_HOLE, 1))


def all_hole_counts(normalized_v4: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalized_v4, F.lit(r"(\d+) ?(?:lo|holes|hole)"), 1), lambda x: x.cast("long"))


def terms_v5(normalized: Column) -> Column:
    words = F.array_distinct(F.split(normalized, " "))
    return F.filter(words, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS, "lo", "hole", "holes") & ~x.rlike(r"^\d+$"))


def constraints_v5(message: Column) -> Column:
    n = norm_v5(message)
    return F.struct(
        n.alias("normalized"),
        hole_count(n).alias("hole_count"),
        first_of(n, SHAPES).alias("shape"),
        first_of(n, SIDES).alias("side"),
        first_of(n, COLORS).alias("color"),
        terms_v5(n).alias("terms"),
    )


def raw_words(message: Column, separators: str) -> Column:
    """Non-empty pieces of the message as it is."""
    wide = F.translate(F.coalesce(message, F.lit("")), WIDE_BLANKS, " " * len(WIDE_BLANKS))
    return F.filter(F.split(wide, separators), lambda x: x != "")


def all_terms_v4(message: Column) -> Column:
    words = F.transform(raw_words(message, r"[\s\x0B,;:()/]+"), norm_v4)
    return F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS_V4))


def colors_v4(normalized: Column) -> Column:
    found = [F.when(reduce(lambda a, b: a | b, (F.contains(normalized, F.lit(w)) for w in words)), F.lit(c)) for c, words in COLORS_V4.items()]
    return F.array_compact(F.array(*found))


def exact_tokens(message: Column, most: int) -> Column:
    """The longest code-like tokens, longest first, then by place."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(f"({EXACT_TOKEN})"), 1))
    placed = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda s: s["x"])


def constraints_v4(message: Column) -> Column:
    n = norm_v4(message)
    terms, colors = all_terms_v4(message), colors_v4(n)
    holes = F.coalesce(number(F.regexp_extract(F.coalesce(message, F.lit("")), "(?iu)" + LOOSE_HOLE, 1)), F.lit(-1).cast("long"))
    side = F.coalesce(first_of(n, {"left": "left|ben trai|trai", "right": "right|ben phai|phai", "both": "both|ca hai|hai ben"}), F.lit("all"))
    strong = (F.size(colors) > 0).cast("int") + (holes >= 0).cast("int") + (F.size(terms) >= 2).cast("int") + (side != "all").cast("int")
    return F.struct(n.alias("normalized"), F.slice(F.array_distinct(terms), 1, 12).alias("terms"), colors.alias("colors"), holes.alias("hole_count"), exact_tokens(message, 6).alias("tokens"), side.alias("side"), strong.alias("strong_count"))


def intent_v1(message: Column) -> Column:
    """action, side, whether the question is complex, and search terms with the longest code-like token first."""
    n = norm_v1(message)
    action = F.coalesce(first_of(n, {"count": "bao nhieu|dem|count", "compare": "so sanh|compare|khac nhau"}), F.lit("find"))
    side = F.coalesce(first_of(n, {"left": "ben trai|left", "right": "ben phai|right", "both": "ca hai|both"}), F.lit("all"))
    hard = (F.length(message) > 120) | (action == "compare") | n.rlike(bounded("tai sao|giai thich|phan tich|de xuat|thong ke"))
    words = F.slice(F.filter(raw_words(message, r"[\s\x0B,;:()]+"), lambda x: F.length(x) >= 3), 1, 8)
    token = exact_tokens(message, 1)
    return F.struct(action.alias("action"), side.alias("side"), hard.alias("complex"), F.get(token, F.lit(0)).alias("token"), F.array_distinct(F.concat(token, words)).alias("terms"))


def anchors(c: Column) -> Column:
    """Up to six search anchors of a V5 constraint struct."""
    holes = F.when(c["hole_count"].isNotNull(), F.array(F.concat(c["hole_count"].cast("string"), F.lit(" lỗ")), F.concat(c["hole_count"].cast("string"), F.lit(" lo")))).otherwise(F.array().cast("array<string>"))
    words = F.array(*(F.coalesce(*(F.when(c[k] == name, F.lit(word)) for name, word in table.items())) for k, table in (("shape", ANCHOR_SHAPES), ("side", ANCHOR_SIDES), ("color", ANCHOR_COLORS))))
    return F.slice(F.array_distinct(F.array_compact(F.concat(holes, words, F.slice(c["terms"], 1, 4)))), 1, 6)


def hints(message: Column) -> Column:
    n = norm_v1(message)
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(n, F.lit(k)) for k in keys)), F.lit(label)) for label, keys in HINTS.items())))


def intent(message: Column, has_image: Column) -> Column:
    """kind (catalogue, unsupported, unknown), confidence and reason of a message; an image or five digits in a row,
    blanks aside, always mean the catalogue."""
    n = norm_intent(message)
    packed = F.regexp_replace(F.translate(F.coalesce(message, F.lit("")), WIDE_BLANKS, ""), r"[\s\x0B]+", "")
    code_like = packed.rlike(r"\d{5}")
    folded = [_fold(t) for t in INTENT_TERMS]
    hits = reduce(lambda a, b: a + b, (F.contains(n, F.lit(t)).cast("int") for t in folded))
    cases = [(has_image, "catalogue", F.lit(1.0), "image_or_embedding"), (packed == "", "unsupported", F.lit(1.0), "empty"), (code_like, "catalogue", F.lit(0.95), "code_like"), (hits > 0, "catalogue", F.least(F.lit(1.0), 0.55 + 0.12 * hits), "catalogue_terms")]
    first = lambda k, other: F.coalesce(*(F.when(c[0], c[k] if k == 2 else F.lit(c[k])) for c in cases), F.lit(other))
    return F.struct(first(1, "unknown").alias("kind"), hits.alias("hits"), F.round(first(2, 0.55), 6).alias("confidence"), first(3, "no_catalogue_signal").alias("reason"))


def _fold(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text) if not 0x300 <= ord(x) <= 0x36F).lower().strip()


def is_greeting(message: Column) -> Column:
    return norm_v1(message).rlike(GREETING)


def safe_code(text: Column) -> Column:
    """A product code for object keys: upper case, all else to underscores, trimmed, 120 at most, UNKNOWN if empty."""
    cleaned = F.regexp_replace(strip_marks(F.upper(F.trim(F.coalesce(text, F.lit("")))), True), "[^A-Z0-9_-]+", "_")
    cut = F.substring(F.regexp_replace(cleaned, "^_+|_+$", ""), 1, 120)
    return F.when(cut == "", "UNKNOWN").otherwise(cut)


def safe_upload_id(text: Column) -> Column:
    """An upload id for object keys: letters, digits, _ and -, 100 at most; empty if nothing is left."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9_-]+", ""), 1, 100)


def code_from_file(name: Column) -> Column:
    """The code that a file name suggests: without its extension, all but letters and digits to underscores, upper case."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")
    return F.upper(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def object_key(asset_type: Column, code: Column, upload_id: Column, mime: Column) -> Column:
    """type/CODE/id.extension.  Without an upload id a digest of the other parts stands for it, so that reruns agree."""
    own = safe_upload_id(upload_id)
    made = F.md5(F.concat_ws("|", asset_type, safe_code(code), F.coalesce(mime, F.lit(""))))
    extension = F.coalesce(*(F.when(mime == m, F.lit(e)) for m, e in EXTENSIONS.items()), F.lit("bin"))
    return F.concat(asset_type, F.lit("/"), safe_code(code), F.lit("/"), F.when(own != "", own).otherwise(made), F.lit("."), extension)


def row_text(drop_empty: bool, norm, *columns: str) -> Column:
    """The searchable text of a catalogue row."""
    parts = [F.when(F.col(c) != "", F.col(c)) if drop_empty else F.coalesce(F.col(c), F.lit("")) for c in columns]
    return norm(F.concat_ws(" ", *parts))
