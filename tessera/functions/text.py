"""Column functions on names, addresses and HTML."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of administrative names, in the order of their removal.
PREFIXES = ["tinh", "thanh pho", "tp", "xa", "phuong", "quan", "huyen", "thi xa", "thi tran", "dac khu"]
# Accented prefixes, of which one is removed.
ACCENTED = ["tỉnh", "thành phố", "thị xã", "thành thị", "quận", "huyện", "thị trấn", "phường", "xã"]

WHITE = r"[\s\u00A0\uFEFF\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _folding() -> tuple[str, str]:
    """Letters with a canonical decomposition into a letter and marks, and that letter."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for point in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and all(0x300 <= ord(c) <= 0x36F for c in base[1:]):
            source.append(chr(point))
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folding()


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"[\u0300-\u036F]", "")


def normalize_search(c: Column) -> Column:
    return F.lower(strip_diacritics(c))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, WHITE + "+", " "), "^ | $", "")


def normalize_admin_name(c: Column) -> Column:
    """Folded, lower-cased, punctuation as spaces, each known prefix removed at most once in fixed order; null is ''."""
    base = collapse(F.regexp_replace(normalize_search(F.coalesce(c, F.lit(""))), r"[().,/\-]", " "))
    return reduce(lambda x, p: F.regexp_replace(x, f"^{p} ", ""), PREFIXES, base)


def admin_key(name: str | None) -> str:
    """normalize_admin_name of a Python string, for the literals of reference tables."""
    base = "".join(c for c in unicodedata.normalize("NFD", name or "") if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D").lower()
    base = " ".join(base.translate(str.maketrans("().,/-", "      ")).split())
    for prefix in PREFIXES:
        base = base.removeprefix(prefix + " ")
    return base


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_search(c), "[^a-z0-9]+", " "))


def _dashes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-|-$", "")


def slugify(c: Column) -> Column:
    return _dashes(reduce(lambda x, p: F.regexp_replace(x, f"^{p}{WHITE}+", ""), ["thanh pho", "tinh", "thu do"], normalize_search(c)))


def to_code(province: Column, name: Column) -> Column:
    return F.concat(province, F.lit("-"), _dashes(normalize_search(name)))


def strip_admin_prefix(c: Column) -> Column:
    """Without one accented prefix at the start."""
    return collapse_ends(F.regexp_replace(c, f"(?iu)^({'|'.join(ACCENTED)})" + WHITE + "+", ""))


def collapse_ends(c: Column) -> Column:
    """Trimmed of all white space."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def name_matches(a: Column, b: Column) -> Column:
    """Either name holds the other, without a prefix and regardless of case."""
    x, y = F.lower(strip_admin_prefix(a)), F.lower(strip_admin_prefix(b))
    return F.contains(x, y) | F.contains(y, x)


def infer_commune_type(c: Column, unaccented: bool = False) -> Column:
    """phuong, dac_khu or xa. unaccented: the variant that also takes names without accents and trailing types."""
    end, c = "(?![A-Za-z0-9_])", F.lower(c)
    phuong = f"^(phường|thị trấn){end}" if not unaccented else f"^(phường|phuong|thị trấn|thi tran){end}|(?<![A-Za-z0-9_])phường$"
    special = f"^đặc khu{end}" if not unaccented else f"^(đặc khu|dac khu){end}"
    return F.when(c.rlike(phuong), "phuong").when(c.rlike(special), "dac_khu").otherwise("xa")


def clean_html(c: Column) -> Column:
    """Comments within a line, tags and &nbsp; as spaces; white space collapsed and trimmed."""
    c = F.regexp_replace(c, r"<!--[^\n\r\u2028\u2029]*?-->", " ")
    c = F.regexp_replace(c, rf"(?i)<br{WHITE}*/?>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return collapse(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))


def first_match(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, trimmed; null without a match."""
    return F.when(c.rlike(pattern), collapse_ends(F.regexp_extract(c, pattern, 1)))


def _quoted(literal: str) -> str:
    return "".join("\\" + x if not x.isalnum() and x.isascii() and x != " " else x for x in literal)


def meta_content(c: Column, key: str) -> Column:
    """Non-empty content of a meta element by property, then by name; each with content after it before one ahead."""
    k = _quoted(key)
    tries = [t for a in ("property", "name") for t in (rf'(?i)<meta[^>]+{a}="{k}"[^>]+content="([^"]+)"', rf'(?i)<meta[^>]+content="([^"]+)"[^>]+{a}="{k}"')]
    return F.coalesce(*[first_match(c, t) for t in tries])


def section_paragraph(c: Column, heading: Column | str) -> Column:
    """The paragraph right after an <h3> of that very text, cleaned; null without text."""
    if isinstance(heading, str):
        raw = first_match(c, rf"<h3[^>]*>{_quoted(heading)}</h3><p>([^\n\r\u2028\u2029]*?)</p>")
    else:
        pattern = F.concat(F.lit(r"<h3[^>]*>\Q"), heading, F.lit(r"\E</h3><p>([^\n\r\u2028\u2029]*?)</p>"))
        raw = F.when(F.regexp_like(c, pattern), collapse_ends(F.call_function("regexp_extract", c, pattern, F.lit(1))))
    return F.when(raw != "", clean_html(raw))


def split_list(c: Column) -> Column:
    """Parts between commas, trimmed, without empty ones; null is no part."""
    return F.coalesce(F.filter(F.transform(F.split(c, ","), collapse_ends), lambda x: x != ""), F.array().cast("array<string>"))


def quoted_list(c: Column) -> Column:
    """The non-empty strings in double quotes."""
    return F.coalesce(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1)), F.array().cast("array<string>"))


def unescape_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('\\"'), F.lit('"'))


# The note of a snapshot's source, and its translation for display.
SOURCE_NOTE = "Public reference snapshot transformed into an internal schema with attribution."
SHOWN_NOTE = "Nguồn tham chiếu công khai đã được chuẩn hóa để phục vụ hiển thị trong hệ thống."
NO_DATA = "Chưa có dữ liệu"


def vietnamize(c: Column) -> Column:
    """`X City` as `Thành phố X`, `TP.` as `TP`, and the source's note translated."""
    c = F.regexp_replace(c, rf"{WHITE}*([^,\s][^,]*?){WHITE}+City(?![A-Za-z0-9_])", "Thành phố $1")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])TP\.", "TP")
    return F.replace(c, F.lit(SOURCE_NOTE), F.lit(SHOWN_NOTE))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[F.when(collapse_ends(c) != "", c) for c in cs])


def administrative_centre(c: Column, card: bool = False) -> Column:
    """A centre for display. The page drops a comma at the end; the card drops the last part, and keeps what would be
    empty as it came."""
    own = vietnamize(c)
    if card:
        shown = collapse_ends(F.regexp_replace(own, rf"{WHITE}*,{WHITE}*[^,]+$", ""))
        return F.when(c != "", F.coalesce(F.nullif(shown, F.lit("")), c))
    shown = collapse_ends(F.regexp_replace(own, rf"{WHITE}*,{WHITE}*$", ""))
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit(NO_DATA))


def province_kind_label(kind: Column) -> Column:
    return F.when(kind == "city", "Thành phố trực thuộc Trung ương").otherwise("Tỉnh")


def ellipsis(c: Column) -> Column:
    return F.when(F.length(c) > 40, F.concat(F.substring(c, 1, 38), F.lit("…"))).otherwise(c)


def name_of_file(c: Column) -> Column:
    """A province's name from its file's: without `.json` and a number in front."""
    return F.regexp_replace(F.regexp_replace(c, r"\.json", ""), r"^\d+_", "")


def blank_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed_input(c: Column) -> Column:
    """A request's text field as it is read: trimmed."""
    return collapse_ends(c)


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^\uFEFF", "")


def camel_split(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def encode_component(c: Column) -> Column:
    """Percent-encoded, as one component of an address."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def with_query(address: Column, **values: Column) -> Column:
    """An address with its query."""
    pairs = [F.concat(F.lit(k + "="), encode_component(v)) for k, v in values.items()]
    return F.concat(address, F.lit("?"), F.concat_ws("&", *pairs))


def strict_json(c: Column) -> Column:
    """A whole text as VARIANT, or null if it is not one JSON value; Spark's parser alone lets anything follow a value."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def object_or_null(doc: Column) -> Column:
    """A VARIANT if it is an object."""
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)


def array_or_empty(doc: Column) -> Column:
    """The items of a VARIANT if it is an array, else none."""
    return F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array().cast("array<variant>"))


def iso_now() -> Column:
    """The time of the query as an ISO stamp in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_today() -> Column:
    return F.left(iso_now(), F.lit(10))
