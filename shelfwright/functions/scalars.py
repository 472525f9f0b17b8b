"""Scalar functions as Column expressions: dates, numbers, identifiers, URLs, cover slots, names of volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DATE = 999912


def year_of(pubdate: Column) -> Column:
    """The first year 19xx or 20xx, null without one."""
    return F.nullif(F.regexp_extract(pubdate, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def date_key(pubdate: Column) -> Column:
    """yyyymm of texts of mixed precision; the month is held to 1..12 and 1 if missing; 999912 without a year."""
    year = year_of(pubdate)
    month = F.nullif(F.regexp_extract(pubdate, "(?:19|20)[0-9]{2}[^0-9]*([0-9]{1,2})", 1), F.lit("")).cast("int")
    held = F.least(F.lit(12), F.greatest(F.lit(1), F.coalesce(month, F.lit(1))))
    return F.coalesce(year * 100 + held, F.lit(UNKNOWN_DATE))


def month_key(at: Column) -> Column:
    """yyyymm of a timestamp."""
    return F.coalesce(F.year(at) * 100 + F.month(at), F.lit(UNKNOWN_DATE))


def to_number(text: Column) -> Column:
    """Digits of either width as a number."""
    return F.translate(text, "０１２３４５６７８９", "0123456789").try_cast("int")


def normalize_isbn(text: Column) -> Column:
    """10 or 13 characters of digits and X, else null."""
    bare = F.upper(F.regexp_replace(text, "[^0-9Xx]", ""))
    return F.when(F.length(bare).isin(10, 13), bare)


def cache_key(provider: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("\n", provider, url), 256)


def content_name(content: Column, ext: Column) -> Column:
    """Content-addressed file name: 32 hex digits of the hash, then the extension."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 32), ext)


def file_version(size: Column, mtime_ms: Column) -> Column:
    """base36(size)-base36(mtime), in lower case."""
    return F.lower(F.concat_ws("-", F.conv(size.cast("string"), 10, 36), F.conv(mtime_ms.cast("string"), 10, 36)))


def content_type(name: Column) -> Column:
    """Of an image by its extension; null for other files (fixed values)."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for names, kind in ((("jpg", "jpeg"), "image/jpeg"), (("png",), "image/png"), (("gif",), "image/gif"), (("webp",), "image/webp"), (("avif",), "image/avif"), (("bmp",), "image/bmp")):
        out = F.when(ext.isin(*names), kind) if out is None else out.when(ext.isin(*names), kind)
    return out


def is_content_file(name: Column) -> Column:
    """Archives and books, and the numbered pieces of split archives."""
    return F.coalesce(name.rlike(r"(?i)\.(rar|zip|7z|cbz|cbr|pdf|epub|mobi|azw3?|r[0-9]{2}|[0-9]{3})$"), F.lit(False))


def host_allowed(url: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(url, F.lit(p))
    return F.coalesce(out, F.lit(False))


def valid_image(status: Column, size: Column, digest: Column, placeholders: list[str], least: int = 2000) -> Column:
    """A cover worth keeping: fetched, not tiny, and no known placeholder."""
    return F.coalesce((status == 200) & (size >= least) & ~digest.isin(placeholders or [""]), F.lit(False))


def header_word(text: Column) -> Column:
    """A header value as RFC 2047 base64 unless it is plain ASCII."""
    return F.when(text.rlike(r"^[\x20-\x7e]*$"), text).otherwise(F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(text, "UTF-8")), F.lit("?=")))


def format_volume(lo: Column, hi: Column, unit: Column) -> Column:
    """第01巻 or 第01-06巻; numbers above two digits are not cut."""
    pad = lambda n: F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0"))
    return F.when(lo == hi, F.concat(F.lit("第"), pad(lo), unit)).otherwise(F.concat(F.lit("第"), pad(lo), F.lit("-"), pad(hi), unit))


def series_label(author: Column, title: Column) -> Column:
    a = F.trim(F.coalesce(author, F.lit("")))
    return F.when(a != "", F.concat(F.lit("["), a, F.lit("] "), title)).otherwise(title)


def volume_slot(lo: Column, hi: Column, unit: Column) -> Column:
    """Key of a volume's cover: ``v:unit:n`` or ``v:unit:n-m``. The series itself is the empty key."""
    return F.concat(F.lit("v:"), unit, F.lit(":"), lo, F.when(lo == hi, "").otherwise(F.concat(F.lit("-"), hi)))


def side_slot(label: Column) -> Column:
    return F.concat(F.lit("s:"), label)


_SLOT = "^v:([^:]+):([0-9]{1,4})(?:-([0-9]{1,4}))?$"


def parse_slot(slot: Column) -> Column:
    """STRUCT(kind, volume_from, volume_to, unit, label); null for keys that say nothing. Side labels may hold colons."""
    n = lambda g: F.nullif(F.regexp_extract(slot, _SLOT, g), F.lit("")).cast("int")
    lo, hi = n(2), F.coalesce(n(3), n(2))
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")

    def row(kind: str, a: Column, b: Column, unit: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("volume_from"), b.alias("volume_to"), unit.alias("unit"), label.alias("label"))

    return (
        F.when(slot == "", row("series", none, none, text, text))
        .when(F.startswith(slot, F.lit("s:")), row("side", none, none, text, F.substring(slot, 3, 1 << 30)))
        .when(slot.rlike(_SLOT) & (lo <= hi), row("volume", lo, hi, F.regexp_extract(slot, _SLOT, 1), text))
    )


def slot_volume_no(slot: Column) -> Column:
    return parse_slot(slot)["volume_from"]


def slot_label(slot: Column) -> Column:
    s = parse_slot(slot)
    side = F.when(s["label"] == "", "本編").otherwise(s["label"])
    return F.when(s["kind"] == "series", "代表表紙").when(s["kind"] == "side", side).otherwise(format_volume(s["volume_from"], s["volume_to"], s["unit"]))


def tag_text(xml: Column, tag: str) -> Column:
    """The text of the first element of that name, CDATA and entities resolved; null without one."""
    raw = F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(xml.rlike(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.trim(decode_entities(raw)))


def decode_entities(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def folded_key(text: Column) -> Column:
    """Lower case without white space and marks: the part of a series key that needs no Unicode folding."""
    return F.regexp_replace(F.lower(text), KEY_MARKS, "")


#: What a series key drops (fixed values), as a Java pattern.
KEY_MARKS = r"[\s　_\-‐–—~〜・,.、。!?！？'\"“”‘’()（）\[\]{}【】「」『』:：;；|/\\]"
