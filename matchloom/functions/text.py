"""Cleaning and scalar functions as column expressions.

All take and return Columns, so they stay inside code generation.  ``(?U)`` makes
character classes Unicode-aware.  Null text counts as empty where the result is
text to compare, and stays null where the result is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in word)


def any_of(words: Sequence[str]) -> str:
    return "|".join(_escaped(w) for w in words)


#: White space of Unicode.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACES))


def safe_float(text: Column) -> Column:
    """Comma or point decimal, spaces ignored; null unless positive."""
    value = strip(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))).try_cast("double")
    return F.when(value > 0, value)


def safe_int(text: Column) -> Column:
    """Truncated towards zero; null unless a number."""
    return strip(text).try_cast("double").try_cast("long")


def safe_str(text: Column, nulls: Sequence[str] = L.NULL_TEXTS) -> Column:
    s = strip(text)
    return F.when(~s.isin(*nulls), s)


def price_parse(text: Column) -> Column:
    """Digits and points only, to two places; zero is no price."""
    value = F.round(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("double"), 2)
    return F.when(value != 0, value)


def clean_str(text: Column) -> Column:
    return F.translate(strip(F.coalesce(text, F.lit(""))), " \n", "  ")


def normalize(text: Column) -> Column:
    """Upper case, one kind of dash, no quotes or brackets, single spaces, and no trailing
    `` Wd.d`` group (a rating after the letter W).

    One pass over the characters, and two short patterns after it."""
    dashes, gone = L.DASHES.strip("[]"), L.QUOTES.strip("[]") + "(){}[]"
    t = F.translate(F.upper(F.coalesce(text, F.lit(""))), dashes + SPACES + gone, "-" * len(dashes) + " " * len(SPACES))
    return F.regexp_replace(F.trim(F.regexp_replace(t, " {2,}", " ")), r"(?U) W\d+\.\d+$", "")


def strip_brand(text: Column, brands: Sequence[str] = L.BRAND_SUFFIXES) -> Column:
    """Without a known brand at the end; empty if there is none."""
    t = strip(F.regexp_replace(text, rf"(?iuU)\s+({any_of(brands)})$", ""))
    return F.when(t == text, F.lit("")).otherwise(t)


def strip_subitem(text: Column) -> Column:
    """Without a leading ``N / ``."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)^\d+\s*/\s*", "")


def strip_cyrillic(text: Column, min_length: int = L.NOCYR_MIN_LENGTH) -> Column:
    """Without Cyrillic letters; empty if fewer than ``min_length`` characters are left."""
    t = strip(F.regexp_replace(text, "[А-ЯЁа-яё]", ""))
    return F.when(F.length(t) >= min_length, t).otherwise(F.lit(""))


def article_clean(text: Column) -> Column:
    """Article cell: upper case; fragments of words that spilled into the cell are dropped."""
    t = F.regexp_replace(F.regexp_replace(F.upper(strip(F.coalesce(text, F.lit("")))), "[–—]", "-"), r"(?U)\s+", " ")
    fragment = ~t.rlike("[0-9A-Z]") & (t.contains(" ") | (F.length(t) >= 8) | t.rlike(r"[(){}\[\]]"))
    return F.when(fragment, F.lit("")).otherwise(t)


def quantity(text: Column) -> Column:
    """First number of the cell, 1 if there is none or it is not positive."""
    number = F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"\d[\d\s]*[,.]?\d*", 0)
    value = F.replace(F.regexp_replace(number, r"\s+", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value).otherwise(F.lit(1.0))


def standard_ref(text: Column, prefixes: Sequence[str] = L.STANDARD_PREFIXES, parts: Sequence[str] = L.STANDARD_PARTS) -> Column:
    """Empty when the article is a reference to a norm."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike(f"^({any_of(prefixes)})") | t.rlike(any_of(parts)), F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def cell(cells: Column, index: Column | int) -> Column:
    """Cell at a position from 0, trimmed, empty if it is not there."""
    at = (F.lit(index) if isinstance(index, int) else index) + 1
    return strip(F.replace(F.coalesce(F.when(at >= 1, F.try_element_at(cells, at)), F.lit("")), F.lit("\n"), F.lit(" ")))


def code_repair(cells: Column, index: Column | int, stamps: Sequence[str] = L.STAMP_WORDS) -> Column:
    """Code cell: no title-block words, digits joined over spaces, and the next cell
    appended when it goes on with digits and is no code itself."""
    at = F.lit(index) if isinstance(index, int) else index
    first, second = cell(cells, at), cell(cells, at + 1)
    joined = F.regexp_replace(first, r"(?<=\d)\s+(?=\d)", "")
    after = F.regexp_replace(second, r"(?<=\d)\s+(?=\d)", "")
    both = F.concat(joined, after)
    more = (after != "") & ~after.rlike(r"^\d{3}-\d{3}") & after.rlike(r"^[\d\-]") & (F.regexp_count(both, F.lit(r"\d+")) > F.regexp_count(joined, F.lit(r"\d+")))
    return F.when((first == "") | first.rlike(f"(?iu)^({'|'.join(stamps)})"), F.lit("")).otherwise(strip(F.when(more, both).otherwise(joined)))


def code_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def valid_code(text: Column, digits: int = L.CODE_DIGITS) -> Column:
    return F.length(code_digits(text)) == digits


def header_norm(text: Column) -> Column:
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\n ", "  "), r"(?U)\s+", " ")
    return F.lower(strip(t))


def head_key(norm: Column) -> Column:
    """Key of a header that ``header_norm`` has cleaned."""
    return F.regexp_replace(norm, r"(?U)[-\s]+", "")


def header_key(text: Column) -> Column:
    return head_key(header_norm(text))


def pos_value(text: Column) -> Column:
    """Position token, or null."""
    s = F.regexp_replace(strip(text), r"\.+$", "")
    return F.when(pos_token(s), s)


def pos_token(s: Column) -> Column:
    """Whether a stripped text without points at its end is a position."""
    named = (F.length(s) <= 25) & s.rlike("^[А-ЯЁA-Z]") & ~s.rlike(r"(?U)\s")
    return (s != "") & (s != "-") & (s.rlike(r"(?U)^\d+$") | s.rlike(r"^\d+\.\d+$") | named)


def embed_text(article: Column, name: Column) -> Column:
    parts = F.array(strip(F.coalesce(article, F.lit(""))), strip(F.coalesce(name, F.lit(""))))
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def embed_key(article: Column, name: Column) -> Column:
    return F.lower(strip(embed_text(article, name)))


def query_context(text: Column, prefix: str = L.CONTEXT_PREFIX, suffix: str = L.CONTEXT_SUFFIX) -> Column:
    """Without the leading place and the trailing "including:"; the text itself if nothing is left."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?iuU){prefix}", ""))
    t = strip(F.regexp_replace(t, f"(?iuU){suffix}", ""))
    return F.when(t != "", t).otherwise(F.coalesce(text, F.lit("")))


def params_text(params: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(F.map_entries(params), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "), F.lit(""))


def segments(text: Column, known: Sequence[str] = L.SEGMENTS, default: str = L.DEFAULT_SEGMENT) -> Column:
    """``a,b`` or ``all`` -> list of known segments; the default if none is left."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    everything = F.array(*[F.lit(s) for s in known])
    some = F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x.isin(*known))
    return F.when(t == "all", everything).when(F.size(some) == 0, F.array(F.lit(default))).otherwise(some)


def pad_article(text: Column, width: int = 6) -> Column:
    t = clean_str(text)
    number = F.regexp_replace(t, "^0+(?=.)", "")
    return F.when(t.rlike(r"^\d+$"), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)).otherwise(t)


def vat_exclude(price: Column, rate: Column, included: Column) -> Column:
    return F.round(price / F.when(included, 1 + rate).otherwise(F.lit(1.0)), 2)


def method_label(method: Column, labels: dict[str, str] = L.METHOD_LABELS, prefix: str = L.VECTOR_PREFIX, family: str = L.VECTOR_LABEL) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    m = F.coalesce(method, F.lit(""))
    return F.coalesce(F.try_element_at(table, m), F.when(m.startswith(prefix), F.lit(family)).otherwise(m))


def falsy(value: Column) -> Column:
    """Null for zero, as for null."""
    return F.when(value != 0, value)
