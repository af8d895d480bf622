"""Queries of sheets and price lists."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X
from matchloom.operators.stored import stored
from matchloom.plans import sql as S
from matchloom.plans.registry import query
from matchloom.plans.views import DUCK
from matchloom.sources import pricelists as P
from matchloom.sources import sheets as H

C = F.col


@query("src_catalog", f"SELECT row_no, {S.safe_int('c1')} AS num, {S.safe_str('c2')} AS article, coalesce({S.safe_str('c4')}, 'шт.') AS unit, {S.safe_float('c5')} AS kaznisa, {S.safe_float('c6')} AS rrts, {S.safe_float('c7')} AS mrc, {S.safe_float('c9')} AS partner, {S.safe_int('c11')} AS multiplicity FROM {{v_sheet_rows}} WHERE {S.safe_str('c2')} IS NOT NULL")
def src_catalog(t):
    return H.catalog_rows(t("v_sheet_rows")).select("row_no", "num", "article", "unit", "kaznisa", "rrts", "mrc", "partner", "multiplicity")


_SHEETS = "SELECT concat('f', CAST(p_partkey % 10 AS STRING)) AS file, CASE p_partkey % 3 WHEN 0 THEN 'Sheet1' WHEN 1 THEN 'bd' ELSE 'other' END AS sheet FROM {part} WHERE p_partkey % 10 < 6 OR p_partkey % 3 = 2"


@query("src_sheet_pick", f"SELECT file, CASE WHEN bool_or(sheet = 'bd') THEN 'bd' ELSE 'Sheet1' END AS sheet FROM ({_SHEETS}) WHERE sheet <> 'other' GROUP BY 1")
def src_sheet_pick(t):
    return H.pick_sheet(t.sql(_SHEETS).distinct())


@query("src_constants", f"SELECT 'person' AS kind, c2 AS name, NULL::DOUBLE AS value FROM (SELECT DISTINCT c2 FROM {{v_const_rows}} WHERE c2 NOT IN ('ФИО')) UNION ALL SELECT 'brand', c8, sum({S.safe_float('c10')}) FROM {{v_const_rows}} WHERE c8 <> 'Brand' GROUP BY c8 UNION ALL SELECT 'currency', c22, arg_max({S.safe_float('c23')}, row_no) FROM {{v_const_rows}} WHERE c22 IS NOT NULL GROUP BY c22")
def src_constants(t):
    rows = t("v_const_rows")
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), C(name).alias("name"), value.alias("value"))
    brands = H.brand_rows(rows).groupBy("brand").agg(F.sum("logistics").alias("s"))
    money = H.currency_rows(rows).groupBy("name").agg(F.max_by("rate", "row_no").alias("s"))
    return row(H.people(rows), "person", "full_name", F.lit(None).cast("double")).unionByName(row(brands, "brand", "brand", C("s"))).unionByName(row(money, "currency", "name", C("s")))


@query("srt_constants", "SELECT 'brand' AS kind, brand AS name, row_number() OVER (ORDER BY brand)::INT AS place FROM {v_constants} UNION ALL SELECT 'person', name, row_number() OVER (ORDER BY name)::INT FROM (SELECT DISTINCT c2 AS name FROM {v_const_rows} WHERE c2 NOT IN ('ФИО'))")
def srt_constants(t):
    """Small dimensions, in the order of their names."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("name")).alias("place")
    brands = t("v_constants").select(F.lit("brand").alias("kind"), C("brand").alias("name"))
    people = H.people(t("v_const_rows")).select(F.lit("person").alias("kind"), C("full_name").alias("name"))
    return brands.select("kind", "name", place).unionByName(people.select("kind", "name", place))


def _cells(t, width=8):
    return P.cells_of(t("v_pricelist_rows"), width)


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY created_at DESC, id DESC) AS r FROM {v_mapping}) WHERE r = 1"


def _mapped(x: str) -> str:
    v = f"TRY_CAST(replace(replace({x}, ' ', ''), ',', '.') AS DOUBLE)"
    return f"CASE WHEN {v} <> 0 THEN round({v} / CASE WHEN nds_included THEN 1 + nds_rate ELSE 1.0::DOUBLE END, 2) END"


@query("src_pricelist_mapped", f"""
SELECT file, row_no, c2 AS article, c3 AS name, coalesce(nullif(c4, ''), 'шт') AS unit, {S.safe_int('c9')} AS multiplicity, CASE WHEN brand_column = 8 THEN c8 ELSE m.brand END AS brand,
  CASE WHEN col_price_base = 5 THEN {_mapped('c5')} ELSE {_mapped('c6')} END AS price_base, CASE WHEN col_price_rrts = 5 THEN {_mapped('c5')} ELSE {_mapped('c6')} END AS price_rrts,
  {_mapped('c10')} AS price_opt, CASE WHEN col_price_partner = 11 THEN {_mapped('c11')} END AS price_partner, nullif({S.clean('c12')}, '') AS ntin, nullif({S.clean('c13')}, '') AS status,
  c7 AS category, CASE WHEN col_comment = 14 THEN {S.clean('c14')} END AS comment
FROM {{v_pricelist_rows}} p JOIN ({_LATEST}) m ON m.signature = p.file AND row_no >= data_start_row
WHERE coalesce(c2, '') <> '' AND NOT (coalesce(skip_row_if_empty_col, 0) = 6 AND coalesce(c6, '') = '')
""")
def src_pricelist_mapped(t):
    return P.parse_mapped(_cells(t, 14), P.latest_mappings(t("v_mapping")))


@query("src_mapping_lookup", f"SELECT f.file, m.id, m.supplier_code FROM (SELECT DISTINCT file FROM {{v_pricelist_rows}} UNION ALL SELECT 'new.csv') f LEFT JOIN ({_LATEST}) m ON m.signature = f.file AND m.signature <> 'b.csv'")
def src_mapping_lookup(t):
    failed = t.spark.createDataFrame([("b.csv",)], "signature string")
    files = t("v_pricelist_rows").select("file").distinct().union(t.spark.createDataFrame([("new.csv",)], "file string"))
    stored = P.latest_mappings(P.invalidate_mappings(t("v_mapping"), failed)).select(C("signature").alias("file"), "id", "supplier_code")
    return files.join(stored, "file", "left")


@query("win_latest_mapping", f"SELECT id, signature, created_at FROM ({_LATEST})")
def win_latest_mapping(t):
    return P.latest_mappings(t("v_mapping")).select("id", "signature", "created_at")


@query("src_snapshot", "SELECT file, sheet, count(*) AS rows_with_data, count(*) FILTER (row_no <= 15) AS n_preview, max(CASE WHEN row_no <= 15 THEN row_no END) AS last_row FROM {v_pricelist_rows} GROUP BY 1, 2")
def src_snapshot(t):
    return P.snapshot(_cells(t)).select("file", "sheet", "rows_with_data", F.size("preview").cast("long").alias("n_preview"), F.array_max(F.transform("preview", lambda x: x["row"])).alias("last_row"))


@query("src_signature", "SELECT file, concat('Price::', string_agg(line, ';' ORDER BY row_no)) AS signature FROM (SELECT file, row_no, array_to_string(list_filter([c1, c2, c3, c4, c5, c6, c7, c8], lambda x: x IS NOT NULL)[1:5], '|') AS line, row_number() OVER (PARTITION BY file ORDER BY row_no) AS r FROM {v_pricelist_rows} WHERE row_no <= 9) WHERE r <= 2 GROUP BY 1")
def src_signature(t):
    return P.text_signature(_cells(t), last_row=9)


_RULES = (("Price", 3, 2, "a", "vendor_b"), ("PRICE", 3, 3, "e", "vendor_c"), ("Price", 2, 3, "e", "vendor_a"))


@query("src_signature_profile")
def src_signature_profile(t):
    """The MD5 of each file's profile (its JSON is Spark's: no SQL; tested on a small table)."""
    return P.signature(P.snapshot(_cells(t)))


@query("src_supplier_detect", "SELECT file, arg_min(s, k) AS supplier FROM (SELECT file, 'vendor_b' AS s, 1 AS k FROM {v_pricelist_rows} WHERE row_no = 3 AND contains(lower(c2), 'a') UNION ALL SELECT file, 'vendor_c', 2 FROM {v_pricelist_rows} WHERE row_no = 3 AND contains(lower(c3), 'e') UNION ALL SELECT file, 'vendor_a', 3 FROM {v_pricelist_rows} WHERE row_no = 2 AND contains(lower(c3), 'e')) GROUP BY 1")
def src_supplier_detect(t):
    return P.detect_suppliers(_cells(t), _RULES, ())


_PRICE_BASE = f"{S.price('c5')}"


def _vendor(vendor: str, start: int, vat: float = 0.0, article: str = "c1", name: str = "c2", unit: str = "NULL", more: str = "", where: str = "", **columns: str) -> str:
    """SQL of one vendor's items, from the columns named."""
    net = lambda c: f"round({S.price(c)} / (1 + {vat}::DOUBLE), 2)" if vat else S.price(c)
    some = lambda f: f"nullif({S.clean(columns[f])}, '')" if f in columns else "NULL::VARCHAR"
    prices = ", ".join(f"{net(columns[p]) if p in columns else 'NULL::DOUBLE'} AS {p}" for p in P.PRICES)
    texts = ", ".join(f"{some(f)} AS {f}" for f in ("ntin", "status", "category", "comment"))
    pack = S.safe_int(columns["pack"]) if "pack" in columns else "NULL::BIGINT"
    return (
        f"SELECT * FROM (SELECT '{vendor}' AS file, row_no, {S.clean(article)} AS article, {S.clean(name)} AS name, coalesce(nullif({S.clean(unit)}, ''), 'шт') AS unit, {pack} AS multiplicity, "
        f"{columns.get('brand', repr(vendor))} AS brand, {prices}, {texts}{more} FROM {{v_vendor_rows}} WHERE file = '{vendor}' AND row_no >= {start} {where}) WHERE article <> ''"
    )


def _discounted(vendor: str, sheet: str, last: int, least: str, items: str, group: str, value: str) -> str:
    listed = f"SELECT {group} AS category, max(TRY_CAST({value} AS DOUBLE)) AS discount FROM {{v_vendor_rows}} WHERE file = '{vendor}' AND sheet = '{sheet}' AND row_no <= {last} AND TRY_CAST({value} AS DOUBLE) {least} GROUP BY 1"
    return f"SELECT i.* REPLACE (coalesce(price_partner, round(price_base * (1 - discount), 2)) AS price_partner) FROM ({items} AND name <> '') i LEFT JOIN ({listed}) d USING (category)"


_ITEM = "file, row_no, article, name, unit, multiplicity, brand, price_base, price_rrts, price_opt, price_partner, ntin, status, category, comment"
_PADDED = "CASE WHEN regexp_matches(trim({x}), '^[0-9]+$') THEN lpad(CAST(CAST({x} AS BIGINT) AS VARCHAR), 6, '0') ELSE {x} END"
_HIMEL = _vendor("himel", 4, unit="c3", pack="c4", price_base="c5", comment="c6", ntin="c7", brand="'Himel'")
_EKF = _vendor("ekf", 13, 0.12, unit="c6", price_base="c7", price_opt="c8", price_rrts="c9", price_partner="c10", pack="c11", brand="'EKF'", more=", sheet") + " AND name <> '' QUALIFY row_number() OVER (PARTITION BY article ORDER BY sheet = 'Новинки', row_no) = 1"
_IEK = _vendor("iek", 9, 0.12, category="c4", unit="c8", ntin="c9", status="c10", pack="c13", price_base="c15", price_rrts="c16", price_opt="c17", price_partner="c20", brand="'IEK'") + " AND name <> ''"
_DKC_ROWS = "last_value(CASE WHEN trim(coalesce(c6, '')) = '' THEN nullif(c2, '') END IGNORE NULLS) OVER (ORDER BY row_no)"
_DKC = _vendor("dkc", 17, article="c6", name="c8", unit="c9", pack="c10", price_rrts="c11", price_base="c12", brand="'DKC'", more=f", {_DKC_ROWS} AS above").replace("SELECT * FROM", "SELECT * REPLACE (above AS category) FROM", 1) + " AND name <> ''"
_LEGRAND = _discounted("legrand", "Заказ", 10, "> 0", _vendor("legrand", 5, article=_PADDED.format(x="coalesce(c3, c2)"), name="c4", category="c6", brand="coalesce(nullif(c7, ''), 'Legrand')", unit="c15", price_base="c16", where="AND sheet = 'Тариф'"), "c4", "c5")
_SCHNEIDER = _discounted("schneider", "Тариф 2026", 6, "IS NOT NULL", _vendor("schneider", 8, 0.12, price_base="c3", price_partner="c4", unit="c5", category="c6", brand="'Schneider Electric'"), "c1", "c2")


@query("src_vendor_profiles", " UNION ALL ".join(f"SELECT {_ITEM} FROM ({x})" for x in (_HIMEL, _EKF, _IEK, _DKC, _LEGRAND, _SCHNEIDER)))
def src_vendor_profiles(t):
    """Each vendor's file by that vendor's own layout; the files are written as cells first."""
    rows = stored(P.cells_of(t("v_vendor_rows"), 20), "vendor-rows")
    out = None
    for vendor in P.VENDORS:
        part = P.parse_vendor(rows.where(C("file") == vendor), vendor)
        out = part if out is None else out.unionByName(part)
    return out


@query("op_category_fill", "SELECT file, row_no, category FROM (SELECT file, row_no, c2, last_value(CASE WHEN coalesce(c2, '') = '' THEN coalesce(nullif(c1, ''), nullif(c3, '')) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no) AS category FROM {v_pricelist_rows}) WHERE coalesce(c2, '') <> ''")
def op_category_fill(t):
    return P.category_fill(_cells(t), 2).select("file", "row_no", "category")


_DISC = (("SMALL", 0.25), ("LARGE", 0.5))


@query("op_discount_matrix", f"SELECT file, row_no, CASE WHEN row_no % 3 = 0 THEN 1.5::DOUBLE ELSE round({_PRICE_BASE} * (1 - CASE c7 WHEN 'SMALL' THEN 0.25::DOUBLE WHEN 'LARGE' THEN 0.5::DOUBLE END), 2) END AS price_partner FROM {{v_pricelist_rows}}")
def op_discount_matrix(t):
    rows = t("v_pricelist_rows").select("file", "row_no", C("c7").alias("grp"), X.price_parse(C("c5")).alias("price_base"), F.when(C("row_no") % 3 == 0, 1.5).alias("price_partner"))
    return P.discount_matrix(rows, t.spark.createDataFrame(list(_DISC), "grp string, discount double"), "grp").select("file", "row_no", "price_partner")


@query("op_first_wins_union", "SELECT article, file, row_no FROM (SELECT c2 AS article, file, row_no, row_number() OVER (PARTITION BY c2 ORDER BY file, row_no) AS r FROM {v_pricelist_rows} WHERE coalesce(c2, '') <> '') WHERE r = 1")
def op_first_wins_union(t):
    rows = t("v_pricelist_rows").where("coalesce(c2, '') <> ''").select(C("c2").alias("article"), "file", "row_no", C("file").alias("sheet_no"))
    return P.first_wins(rows).select("article", "file", "row_no")
