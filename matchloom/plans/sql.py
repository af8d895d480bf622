"""DuckDB fragments that several reference queries share."""

from matchloom.functions import lexicons as L

_S = r"[\s\x{00A0}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def norm(x: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({strip(f'upper(coalesce({x}, {chr(39)}{chr(39)}))')}, '[–—−‒]', '-', 'g'), '[«»“”„‟‘’`]', '', 'g'), '[(){{}}\\[\\]]', '', 'g')"
    t = strip(f"regexp_replace({t}, '{_S}+', ' ', 'g')")
    return strip(f"regexp_replace({t}, '{_S}+W\\d+\\.\\d+$', '')").replace("{{", "{").replace("}}", "}")


def brand(x: str) -> str:
    t = strip(f"regexp_replace({x}, '(?i){_S}+({'|'.join(L.BRAND_SUFFIXES)})$', '')")
    return f"CASE WHEN {t} = {x} THEN '' ELSE {t} END"


def nocyr(x: str) -> str:
    t = strip(f"regexp_replace({x}, '[А-ЯЁа-яё]', '', 'g')")
    return f"CASE WHEN length({t}) >= 3 THEN {t} ELSE '' END"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def safe_float(x: str) -> str:
    v = f"TRY_CAST({strip(f'replace(replace({x}, {chr(39)},{chr(39)}, {chr(39)}.{chr(39)}), {chr(39)} {chr(39)}, {chr(39)}{chr(39)})')} AS DOUBLE)"
    return f"CASE WHEN {v} > 0 THEN {v} END"


def safe_int(x: str) -> str:
    return f"CAST(trunc(TRY_CAST({strip(x)} AS DOUBLE)) AS BIGINT)"


def safe_str(x: str) -> str:
    return f"CASE WHEN {strip(x)} NOT IN ('None', '-', '—', '') THEN {strip(x)} END"


def price(x: str) -> str:
    v = f"round(TRY_CAST(regexp_replace(replace({x}, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE), 2)"
    return f"CASE WHEN {v} <> 0 THEN {v} END"


def clean(x: str) -> str:
    return f"translate({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, chr(160) || chr(10), '  ')"


def article_clean(x: str) -> str:
    t = f"regexp_replace(regexp_replace(upper({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}), '[–—]', '-', 'g'), '{_S}+', ' ', 'g')"
    return f"CASE WHEN NOT regexp_matches({t}, '[0-9A-Z]') AND (contains({t}, ' ') OR length({t}) >= 8 OR regexp_matches({t}, '[(){{}}\\[\\]]')) THEN '' ELSE {t} END".replace("{{", "{").replace("}}", "}")


def qty(x: str) -> str:
    v = f"TRY_CAST(replace(regexp_replace(regexp_extract(coalesce({x}, ''), '[0-9][0-9 ]*[,.]?[0-9]*'), ' +', '', 'g'), ',', '.') AS DOUBLE)"
    return f"CASE WHEN {v} > 0 THEN {v} ELSE 1.0::DOUBLE END"


def join_digits(x: str) -> str:
    """Digits joined over spaces (RE2 has no look-around, so twice)."""
    one = f"regexp_replace({x}, '([0-9]) +([0-9])', '\\1\\2', 'g')"
    return f"regexp_replace({one}, '([0-9]) +([0-9])', '\\1\\2', 'g')"


def code(first: str, second: str) -> str:
    a, b = join_digits(first), join_digits(second)
    stamp = f"regexp_matches({first}, '(?i)^({'|'.join(L.STAMP_WORDS)})')"
    more = f"({b} <> '' AND NOT regexp_matches({b}, '^[0-9]{{3}}-[0-9]{{3}}') AND regexp_matches({b}, '^[0-9-]') AND len(regexp_extract_all({a} || {b}, '[0-9]+')) > len(regexp_extract_all({a}, '[0-9]+')))"
    return f"CASE WHEN {first} = '' OR {stamp} THEN '' WHEN {more} THEN {strip(f'{a} || {b}')} ELSE {strip(a)} END".replace("{{", "{").replace("}}", "}")


def pos(x: str) -> str:
    s = f"regexp_replace({strip(x)}, '\\.+$', '')"
    return f"CASE WHEN {s} NOT IN ('', '-') AND (regexp_matches({s}, '^[0-9]+$') OR regexp_matches({s}, '^[0-9]+\\.[0-9]+$') OR (length({s}) <= 25 AND regexp_matches({s}, '^[А-ЯЁA-Z]') AND NOT regexp_matches({s}, '{_S}'))) THEN {s} END"


def any_in(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
