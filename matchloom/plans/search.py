"""Queries that list, search, sort and filter."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.operators import catalog as K
from matchloom.operators import review as R
from matchloom.operators import search as Q
from matchloom.operators.stored import fresh_path
from matchloom.plans.matching import matches
from matchloom.plans.registry import query
from matchloom.sources.writers import write_catalog, write_template

C = F.col


@query("flt_active_segment", "SELECT id, article FROM {v_catalog} WHERE is_active AND segment IN ('ss', 'os')")
def flt_active_segment(t):
    return K.active(t("v_catalog"), ("ss", "os")).select("id", "article")


@query("flt_list", "SELECT id, article FROM {v_catalog} WHERE is_active AND brand = 'Brand#12' AND (contains(lower(article), '1') OR contains(lower(name), '1')) ORDER BY id LIMIT 20 OFFSET 2")
def flt_list(t):
    return Q.listed(t("v_catalog"), "Brand#12", "1", 2, 20).select("id", "article")


@query("flt_search_ranked", "SELECT id, row_number() OVER (ORDER BY e DESC, p DESC, k DESC, id)::INT AS place FROM (SELECT id, lower(article) = 'promo-1' AS e, starts_with(lower(article), 'promo-1') AS p, lower(kaznisa_code) = 'promo-1' AS k FROM {v_catalog} WHERE is_active AND segment = 'os' AND (contains(lower(article), 'promo-1') OR contains(lower(name), 'promo-1') OR contains(lower(kaznisa_code), 'promo-1'))) ORDER BY 2 LIMIT 30")
def flt_search_ranked(t):
    from pyspark.sql import Window

    found = Q.ranked_search(t("v_catalog"), "PROMO-1", segment="os")
    place = F.row_number().over(Window.orderBy((F.lower("article") == "promo-1").desc(), F.startswith(F.lower("article"), F.lit("promo-1")).desc(), (F.lower("kaznisa_code") == "promo-1").desc(), "id"))
    return found.select("id", place.alias("place"))


@query("flt_in_list", "SELECT article, name, brand, kaznisa, rrts, mrc, opt, partner FROM {v_catalog} WHERE article IN (SELECT article FROM {v_catalog} WHERE id IN (1, 5, 77))")
def flt_in_list(t):
    wanted = ",".join(r.article for r in t("v_catalog").where("id in (1, 5, 77)").select("article").collect())
    return Q.prices_of(t("v_catalog"), wanted + ", ,none")


@query("flt_preview", "SELECT item_id FROM {v_matches} WHERE status = 'heading' OR (status IN ('multiple', 'fuzzy') AND contains(lower(article_raw || name_raw), 'red'))")
def flt_preview(t):
    return R.preview(matches(t), "warn", " Red ").select("item_id")


@query("flt_count_active", "SELECT count(*) AS n FROM {v_catalog} WHERE is_active")
def flt_count_active(t):
    return t("v_catalog").where("is_active").agg(F.count("*").alias("n"))


@query("flt_rematch_targets", "SELECT item_id, status FROM {v_matches} WHERE status IN ('multiple', 'fuzzy', 'not_found') AND item_id % 4 <> 0")
def flt_rematch_targets(t):
    return R.rematch_targets(matches(t).withColumn("user_edited", C("item_id") % 4 == 0)).select("item_id", "status")


@query("flt_confidence", "SELECT doc, page, text, conf, \"left\", top FROM {v_word_boxes} WHERE trim(text) <> '' AND conf >= 25")
def flt_confidence(t):
    from matchloom.operators.tables import confident_words

    return confident_words(t("v_word_boxes")).select("doc", "page", "text", "conf", "left", "top")


@query("srt_catalog", "SELECT id, num, article, row_number() OVER (ORDER BY num, id)::INT AS place FROM {v_catalog} WHERE is_active")
def srt_catalog(t):
    """Places are counted by ranges of ``num``, so the sort stays distributed."""
    from matchloom.operators.reports import ordered_places

    return ordered_places(t("v_catalog").where("is_active"), "num", ["num", "id"]).select("id", "num", "article", "place")


_NULLABLE = ", ".join(f"nullif({c}, 0) AS {c}" for c in L.PRICE_FIELDS)


@query("sink_catalog", f"SELECT id, coalesce(CASE WHEN id % 10 > 1 THEN num END, place) AS num, article, name, unit, {_NULLABLE}, coalesce(brand, '') AS brand, nullif(multiplicity, 0) AS multiplicity, kaznisa_code FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 WHEN id % 10 > 1 THEN num END NULLS LAST, id)::BIGINT AS place FROM {{v_catalog}} WHERE is_active)")
def sink_catalog(t):
    """The catalog as written to the shared folder; some products have no number, or zero."""
    num = F.when(C("id") % 10 == 0, 0).when(C("id") % 10 > 1, C("num"))
    path = fresh_path(t.spark, "catalog")
    write_catalog(t("v_catalog").withColumn("num", num), path)
    return t.spark.read.parquet(path)


@query("sink_template", """
WITH p AS (SELECT row_number() OVER (ORDER BY full_name) + 1 AS row_no, full_name, coalesce(nullif(position, '—'), '') AS position, coalesce(email, '') AS email, coalesce(nullif(phone, ''), '') AS phone FROM (
    SELECT c2 AS full_name, first(c3 ORDER BY row_no) AS position, first(c4 ORDER BY row_no) AS email, first(c5 ORDER BY row_no) AS phone FROM {v_const_rows} WHERE c2 NOT IN ('Фамилия, имя', 'ФИО') GROUP BY 1)),
b AS (SELECT row_number() OVER (ORDER BY brand) + 1 AS row_no, brand, margin, gp FROM {v_constants}),
c AS (SELECT row_number() OVER (ORDER BY name) + 1 AS row_no, name AS currency, rate AS currency_value FROM (SELECT c22 AS name, arg_max(c23::DOUBLE, row_no) AS rate FROM {v_const_rows} WHERE c22 IS NOT NULL GROUP BY 1))
SELECT row_no::INT AS row_no, full_name, position, email, phone, brand, margin, gp, currency, currency_value FROM p FULL JOIN b USING (row_no) FULL JOIN c USING (row_no)
""")
def sink_template(t):
    """The constants table of the base template as written: people, brands and currencies by name."""
    from matchloom.operators.changes import upsert_currencies
    from matchloom.sources.sheets import currency_rows, people

    path = fresh_path(t.spark, "template")
    staff = people(t("v_const_rows")).withColumn("is_active", F.lit(True))
    money = upsert_currencies(t.spark.createDataFrame([], "name string, rate double"), currency_rows(t("v_const_rows")))
    write_template(t("v_catalog"), staff, t("v_constants"), money, path)
    return t.spark.read.parquet(f"{path}/constants").select("row_no", "full_name", "position", "email", "phone", "brand", "margin", "gp", "currency", "currency_value")
