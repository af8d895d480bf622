"""Queries of the pricing family."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.operators import pricing as P
from matchloom.operators import review as R
from matchloom.operators.stored import fresh_path
from matchloom.plans.matching import matches
from matchloom.plans.registry import query
from matchloom.plans.views import DUCK
from matchloom.sources import writers as W

C = F.col

#: Matched lines with their product's prices and brand.
DUCK["v_lines"] = "SELECT m.item_id, m.doc_id, m.seq, m.name_raw, m.article_raw, m.unit, m.qty, m.status, m.match_method, m.product_id, c.article, c.name AS product_name, c.unit AS product_unit, c.brand, c.kaznisa, c.rrts, c.mrc, c.opt, c.partner FROM {v_matches} m LEFT JOIN {v_catalog} c ON c.id = m.product_id"
DUCK["v_coef"] = """
SELECT l.*, coalesce(nullif(k.margin, 0), 1)::DOUBLE AS margin, coalesce(nullif(k.logistics, 0), 1)::DOUBLE AS logistics, coalesce(nullif(k.rate, 0), 1)::INT AS rate,
  coalesce(nullif(k.currency_rate, 0), 1)::DOUBLE AS currency_rate, coalesce(nullif(k.nds, 0), 1)::DOUBLE AS nds, coalesce(nullif(k.gp, 0), 1)::DOUBLE AS gp
FROM {v_lines} l LEFT JOIN {v_constants} k ON upper(k.brand) = upper(l.brand)
"""
_CHOSEN = "CASE rate " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(L.RATE_FIELDS, 1)) + " ELSE rrts END"
_BASE = f"coalesce(nullif({_CHOSEN}, 0), nullif(rrts, 0), nullif(partner, 0), nullif(mrc, 0), nullif(opt, 0), nullif(kaznisa, 0), 0.0::DOUBLE)"
_GP = f"{_BASE} * CASE WHEN rate IN (6, 7) THEN gp ELSE 1.0::DOUBLE END"
DUCK["v_priced"] = f"""
SELECT *, cost * q AS cost_sum, quote * q AS quote_sum FROM (SELECT *, ceil(cost * margin) AS quote, coalesce(nullif(qty, 0), 1.0::DOUBLE) AS q FROM (
  SELECT *, CASE WHEN base = 0 THEN 0.0::DOUBLE ELSE ceil(base * currency_rate * nds * logistics) END AS cost FROM (SELECT *, {_GP} AS base FROM {{v_coef}})))
"""
_EDITS = "CASE WHEN item_id % 11 = 0 THEN 100.5::DOUBLE END AS user_price, CASE WHEN item_id % 11 IN (0, 1) THEN 50.25::DOUBLE END AS user_cost, CASE WHEN item_id % 11 IN (0, 1, 2) THEN 20.0::DOUBLE END AS user_constant"
DUCK["v_edited"] = f"""
SELECT *, cost * q AS cost_sum, quote * q AS quote_sum FROM (SELECT *, CASE WHEN user_price IS NOT NULL THEN ceil(user_price) ELSE ceil(cost * margin) END AS quote, coalesce(nullif(qty, 0), 1.0::DOUBLE) AS q FROM (
  SELECT *, CASE WHEN user_price IS NOT NULL THEN ceil(ceil(user_price) / margin) WHEN user_cost IS NOT NULL THEN ceil(user_cost) WHEN base = 0 THEN 0.0::DOUBLE ELSE ceil(base * currency_rate * nds * logistics) END AS cost
  FROM (SELECT *, coalesce(user_constant, {_GP}) AS base FROM (SELECT *, {_EDITS} FROM {{v_coef}}))))
"""


def lines(t):
    if "v_lines" not in t._held:
        c = t("v_catalog").select(C("id").alias("product_id"), "article", C("name").alias("product_name"), C("unit").alias("product_unit"), "brand", *L.PRICE_FIELDS)
        t._held["v_lines"] = matches(t).select("item_id", "doc_id", "seq", "name_raw", "article_raw", "unit", "qty", "status", "match_method", "product_id").join(c, "product_id", "left")
    return t._held["v_lines"]


def coefficients(t):
    return P.with_constants(lines(t), t("v_constants"))


def priced(t):
    if "v_priced" not in t._held:
        t._held["v_priced"] = P.priced(coefficients(t))
    return t._held["v_priced"]


def edited(t):
    edit = lambda most, v: F.when(C("item_id") % 11 <= most, F.lit(v))
    return coefficients(t).withColumns({"user_price": edit(0, 100.5), "user_cost": edit(1, 50.25), "user_constant": edit(2, 20.0)})


@query("mat_brand_constants", "SELECT item_id, margin, logistics, rate, currency_rate, nds, gp FROM {v_coef}")
def mat_brand_constants(t):
    return coefficients(t).select("item_id", *P.COEFFICIENTS)


@query("prc_base", f"SELECT item_id, {_BASE} AS base FROM {{v_coef}}")
def prc_base(t):
    return coefficients(t).select("item_id", P.base_price().alias("base"))


@query("prc_gp", f"SELECT item_id, {_GP} AS base FROM {{v_coef}}")
def prc_gp(t):
    return coefficients(t).select("item_id", P.gp_price().alias("base"))


_FOUR = ("cost", "cost_sum", "quote", "quote_sum")


@query("prc_cost_and_quote", "SELECT item_id, cost, cost_sum, quote, quote_sum FROM {v_priced}")
def prc_cost_and_quote(t):
    return priced(t).select("item_id", *_FOUR)


@query("prc_overrides", "SELECT item_id, cost, cost_sum, quote, quote_sum FROM {v_edited}")
def prc_overrides(t):
    return P.priced(edited(t)).select("item_id", *_FOUR)


@query("prc_inverse_constant", "SELECT item_id, CASE WHEN user_constant IS NOT NULL THEN user_constant WHEN user_cost IS NOT NULL THEN user_cost / (nds * logistics * currency_rate) WHEN user_price IS NOT NULL THEN user_price / (nds * logistics * currency_rate * margin) WHEN quote <> 0 THEN quote / (nds * logistics * currency_rate * margin) END AS constant FROM (SELECT * REPLACE (CASE WHEN item_id % 2 = 1 THEN user_constant END AS user_constant, CASE WHEN item_id % 3 = 1 THEN user_cost END AS user_cost) FROM {v_edited})")
def prc_inverse_constant(t):
    rows = P.priced(edited(t)).withColumns({"user_constant": F.when(C("item_id") % 2 == 1, C("user_constant")), "user_cost": F.when(C("item_id") % 3 == 1, C("user_cost"))})
    return rows.select("item_id", P.inverse_constant().alias("constant"))


_FIELD = "CASE item_id % 7 WHEN 0 THEN 'qty' WHEN 1 THEN 'constant' WHEN 2 THEN 'cost' WHEN 3 THEN 'cost_sum' WHEN 4 THEN 'quote' WHEN 5 THEN 'quote_sum' END"


@query("prc_edit_propagation", f"""
SELECT item_id, CASE WHEN f = 'qty' THEN v ELSE qty END AS qty, CASE WHEN f = 'qty' AND coalesce(product_unit, '') <> '' THEN product_unit ELSE unit END AS unit,
  CASE WHEN f = 'constant' THEN nullif(v, 0) END AS user_constant, CASE f WHEN 'cost' THEN nullif(v, 0) WHEN 'cost_sum' THEN nullif(v, 0) / coalesce(nullif(qty, 0), 1) END AS user_cost,
  CASE f WHEN 'quote' THEN v WHEN 'quote_sum' THEN nullif(v, 0) / coalesce(nullif(qty, 0), 1) END AS user_price
FROM (SELECT *, {_FIELD} AS f, (item_id % 5)::DOUBLE AS v FROM {{v_lines}})
""")
def prc_edit_propagation(t):
    edits = t("v_spec_items").select("item_id", F.expr(_FIELD).alias("field"), (C("item_id") % 5).cast("double").alias("value")).where("field is not null")
    return P.propagate_edits(lines(t), edits).select("item_id", "qty", "unit", "user_constant", "user_cost", "user_price")


@query("prc_reprice_brand", f"""
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN c0 ELSE cost END AS cost, CASE WHEN item_id % 4 = 0 THEN q0 ELSE quote END AS quote FROM (SELECT *, ceil(cost * margin) AS quote FROM (
  SELECT *, CASE WHEN base = 0 THEN 0.0::DOUBLE ELSE ceil(base * currency_rate * nds * logistics) END AS cost FROM (SELECT *, {_GP} AS base FROM (SELECT * EXCLUDE (base, cost, quote, cost_sum, quote_sum) REPLACE (3 AS rate), cost AS c0, quote AS q0 FROM {{v_priced}}))))
""")
def prc_reprice_brand(t):
    rows = priced(t).drop("base").withColumn("user_edited", C("item_id") % 4 == 0)
    return P.reprice(rows, rate=3).select("item_id", "cost", "quote")


_REF = "CASE WHEN {p} > 0 THEN ceil({p} * currency_rate) END"


@query("prc_reference_columns", f"SELECT item_id, {_REF.format(p='kaznisa')} AS ref_code_price, {_REF.format(p='kaznisa')} * coalesce(nullif(qty, 0), 1) AS ref_code_sum, {_REF.format(p='rrts')} AS ref_retail_price, {_REF.format(p='rrts')} * coalesce(nullif(qty, 0), 1) AS ref_retail_sum FROM {{v_coef}} WHERE coalesce(brand, '') <> '' AND coalesce(article, '') <> ''")
def prc_reference_columns(t):
    return P.reference_columns(coefficients(t)).select("item_id", "ref_code_price", "ref_code_sum", "ref_retail_price", "ref_retail_sum")


@query("fn_reference_price", f"SELECT item_id, {_REF.format(p='rrts')} AS price, {_REF.format(p='rrts')} * qty AS total FROM {{v_coef}}")
def fn_reference_price(t):
    p = P.reference_price(C("rrts"), C("currency_rate"))
    return coefficients(t).select("item_id", p.alias("price"), (p * C("qty")).alias("total"))


_WITH_PRODUCT = "coalesce(brand, '') <> '' AND coalesce(article, '') <> ''"


@query("sink_quote", f"""
SELECT doc_id, item_id, nullif(brand, '') AS brand, coalesce(nullif(article, ''), nullif(article_raw, '')) AS article, coalesce(nullif(product_name, ''), nullif(name_raw, '')) AS name, coalesce(nullif(product_unit, ''), nullif(unit, '')) AS unit,
  coalesce(nullif(qty, 0), 1.0::DOUBLE) AS qty, nullif(quote, 0) AS price, nullif(quote_sum, 0) AS sum, CASE WHEN item_id % 7 = 0 THEN concat('see ', name_raw) END AS comment, CASE WHEN item_id % 3 = 1 THEN '10 days' END AS delivery,
  CASE WHEN {_WITH_PRODUCT} THEN {_REF.format(p='kaznisa')} END AS ref_code_price, CASE WHEN {_WITH_PRODUCT} THEN {_REF.format(p='kaznisa')} * coalesce(nullif(qty, 0), 1) END AS ref_code_sum,
  CASE WHEN {_WITH_PRODUCT} THEN {_REF.format(p='rrts')} END AS ref_retail_price, CASE WHEN {_WITH_PRODUCT} THEN {_REF.format(p='rrts')} * coalesce(nullif(qty, 0), 1) END AS ref_retail_sum
FROM {{v_priced}} WHERE status <> 'heading'
""")
def sink_quote(t):
    """Quotes as written to the shared folder."""
    comment = F.when(C("item_id") % 7 == 0, F.concat(F.lit("see "), "name_raw"))
    delivery = F.when(C("item_id") % 3 == 0, "").when(C("item_id") % 3 == 1, "10 days")
    path = fresh_path(t.spark, "quotes")
    W.write_quote(priced(t).withColumns({"comment": comment, "delivery": delivery}), path)
    return t.spark.read.parquet(path)


@query("agg_quote_total", "SELECT doc_id, sum(quote_sum) AS total, count(*) AS n_lines FROM {v_priced} WHERE status <> 'heading' GROUP BY 1")
def agg_quote_total(t):
    return priced(t).where("status <> 'heading'").groupBy("doc_id").agg(F.sum("quote_sum").alias("total"), F.count("*").alias("n_lines"))


@query("flt_no_price", "SELECT item_id, product_id FROM {v_lines} WHERE product_id IS NOT NULL AND status <> 'not_found' AND coalesce(nullif(CASE WHEN item_id % 9 <> 0 THEN kaznisa END, 0), nullif(CASE WHEN item_id % 9 <> 0 THEN rrts END, 0), nullif(mrc, 0), nullif(opt, 0), nullif(partner, 0)) IS NULL")
def flt_no_price(t):
    some = lambda c: F.when(C("item_id") % 9 != 0, C(c))
    return R.without_price(lines(t).withColumns({"kaznisa": some("kaznisa"), "rrts": some("rrts")})).select("item_id", "product_id")


@query("flt_unit_mismatch", "SELECT item_id, unit, product_unit FROM {v_lines} WHERE product_id IS NOT NULL AND lower(trim(unit)) <> '' AND lower(trim(product_unit)) <> '' AND lower(trim(unit)) <> lower(trim(product_unit)) AND lower(trim(unit)) NOT IN ('шт', 'шт.')")
def flt_unit_mismatch(t):
    return R.unit_mismatches(lines(t)).select("item_id", "unit", "product_unit")


@query("agg_brands_present", "SELECT DISTINCT trim(brand) AS brand FROM {v_lines} WHERE coalesce(trim(brand), '') <> ''")
def agg_brands_present(t):
    return lines(t).select(F.trim("brand").alias("brand")).where("brand <> ''").distinct()
