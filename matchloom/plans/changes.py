"""Queries of the change-data and set families."""

from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.operators import changes as H
from matchloom.plans import sql as S
from matchloom.operators.stored import fresh_path
from matchloom.plans.registry import query
from matchloom.plans.views import DUCK

C = F.col

_NEW = "coalesce(nullif(i.price_opt, 0), i.price_base)"
_CHANGED = {"rrts": "i.price_rrts", "opt": _NEW, "partner": "i.price_partner"}
_IS = {f: f"({v} IS NOT NULL AND (c.{f} IS NULL OR abs(c.{f} - {v}) > 0.01))" for f, v in _CHANGED.items()}
DUCK["v_active"] = "SELECT * FROM {v_catalog} WHERE is_active AND article <> ''"
DUCK["v_diff"] = f"""
SELECT i.article, CASE WHEN i.article = '' THEN 'skipped' WHEN c.id IS NULL THEN 'new' WHEN {' OR '.join(_IS.values())} THEN 'updated' ELSE 'skipped' END AS kind,
  coalesce(nullif(i.name, ''), c.name) AS name, coalesce(nullif(i.brand, ''), c.brand, '') AS brand FROM {{v_incoming}} i LEFT JOIN {{v_active}} c USING (article)
UNION ALL SELECT article, 'deleted', name, coalesce(brand, '') FROM {{v_active}} WHERE article NOT IN (SELECT article FROM {{v_incoming}})
"""
DUCK["v_changes"] = " UNION ALL ".join(f"SELECT i.article, CASE WHEN c.id IS NULL THEN 'new' ELSE 'updated' END AS kind, '{f}' AS field, c.{f} AS old_value, {v} AS new_value FROM {{v_incoming}} i LEFT JOIN {{v_active}} c USING (article) WHERE i.article <> '' AND {_IS[f]}" for f, v in _CHANGED.items())
DUCK["v_price_history"] = "SELECT 'sup_a' AS supplier_code, article, field, old_value, new_value, 1::BIGINT AS import_log_id FROM {v_changes} WHERE kind = 'updated'"


def diff(t):
    if "v_diff" not in t._held:
        t._held["v_diff"] = H.price_diff(t("v_catalog"), t("v_incoming"), mark_missing=True)
    return t._held["v_diff"]


def history(t):
    return H.price_history(diff(t), "sup_a", 1)


@query("cdc_price_diff", "SELECT article, kind, field, old_value, new_value FROM {v_changes}")
def cdc_price_diff(t):
    return H.long_changes(diff(t).where("kind <> 'skipped'"))


@query("cdc_price_history", "SELECT * FROM {v_price_history}")
def cdc_price_history(t):
    return history(t)


@query("cdc_diff_store", "SELECT article, kind, name, brand, 'pending' AS status, coalesce(n, 0) AS n_changes FROM {v_diff} d LEFT JOIN (SELECT article, count(*) AS n FROM {v_changes} GROUP BY 1) USING (article) WHERE kind <> 'skipped'")
def cdc_diff_store(t):
    stored = H.store_diff(diff(t), 7, "sup_a", "a.csv").unionByName(H.store_diff(diff(t), 8, "sup_b", "b.csv"))
    return H.load_diff(stored, 7).select("article", "kind", "name", "brand", "status", F.size("changes").cast("long").alias("n_changes"))


@query("cdc_apply_diff", """
WITH n AS (SELECT article, max(CASE WHEN field = 'rrts' THEN new_value END) AS rrts, max(CASE WHEN field = 'opt' THEN new_value END) AS opt, max(CASE WHEN field = 'partner' THEN new_value END) AS partner FROM {v_changes} GROUP BY 1),
k AS (SELECT DISTINCT article FROM {v_diff} WHERE kind = 'updated')
SELECT c.article, coalesce(n.rrts, c.rrts) AS rrts, coalesce(n.opt, c.opt) AS opt, coalesce(n.partner, c.partner) AS partner, c.segment, is_active AND d.kind IS DISTINCT FROM 'deleted' AS is_active FROM {v_catalog} c LEFT JOIN (SELECT n.* FROM n JOIN k USING (article)) n USING (article) LEFT JOIN (SELECT article, kind FROM {v_diff} WHERE kind = 'deleted') d USING (article)
UNION ALL SELECT d.article, n.rrts, n.opt, n.partner, 'ss', TRUE FROM {v_diff} d LEFT JOIN n USING (article) WHERE kind = 'new'
""")
def cdc_apply_diff(t):
    """The catalog as a confirmed import left it."""
    return H.confirm_import(t("v_catalog"), diff(t), fresh_path(t.spark, "imports"), 7, "sup_a").select("article", "rrts", "opt", "partner", "segment", "is_active")


@query("cdc_confirmed_jobs", """
SELECT 7::BIGINT AS job_id, 'confirmed' AS status, count(DISTINCT article) FILTER (kind = 'new') AS rows_new, count(DISTINCT article) FILTER (kind = 'updated') AS rows_updated, count(DISTINCT article) FILTER (kind = 'deleted') AS rows_deleted,
  (SELECT count(*) FROM {v_changes} JOIN (SELECT DISTINCT article FROM {v_diff} WHERE kind = 'updated') USING (article)) AS rows_history FROM {v_diff}
""")
def cdc_confirmed_jobs(t):
    """The stored records of confirmed imports; a second confirmation is refused by them."""
    path = fresh_path(t.spark, "imports")
    H.confirm_import(t("v_catalog"), diff(t), path, 7, "sup_a")
    try:
        H.confirm_import(t("v_catalog"), diff(t), path, 7, "sup_a")
        raise AssertionError("confirmed twice")
    except ValueError:
        return H.confirmed_jobs(t.spark, path)


_ROWS = f"SELECT row_no, {S.safe_str('c2')} AS article, {S.safe_str('c3')} AS name, {S.safe_float('c6')} AS rrts FROM {{v_sheet_rows}}"
_KNOWN = "concat(p_type, '-', CAST(p_partkey % 900 AS STRING))"


@query("cdc_catalog_upsert", f"""
WITH base AS (SELECT c.* REPLACE (concat(split_part(article, '-', 1), '-', (id % 900)::VARCHAR) AS article) FROM {{v_catalog}} c),
new AS (SELECT article, arg_max(name, row_no) AS name, arg_max(rrts, row_no) AS rrts, max(row_no) AS row_no FROM ({_ROWS}) WHERE article IS NOT NULL GROUP BY 1)
SELECT article, name, rrts, segment, NULL AS change FROM base WHERE segment <> 'ss'
UNION ALL SELECT coalesce(b.article, n.article), CASE WHEN n.article IS NULL THEN b.name ELSE n.name END, CASE WHEN n.article IS NULL THEN b.rrts ELSE n.rrts END, 'ss', CASE WHEN b.article IS NULL THEN 'added' WHEN n.article IS NOT NULL THEN 'updated' END
FROM (SELECT * FROM base WHERE segment = 'ss') b FULL JOIN new n ON n.article = b.article
""")
def cdc_catalog_upsert(t):
    base = t("v_catalog").withColumn("article", F.concat(F.split("article", "-")[0], F.lit("-"), (C("id") % 900).cast("string")))
    rows = t("v_sheet_rows").select("row_no", X.safe_str(C("c2")).alias("article"), X.safe_str(C("c3")).alias("name"), X.safe_float(C("c6")).alias("rrts"))
    return H.upsert_catalog(base, rows, "ss").select("article", "name", "rrts", "segment", "change")


_BRANDS = "SELECT row_no, " + S.safe_str("c8") + " AS brand, " + ", ".join(f"{S.safe_float(c)} AS {n}" for n, c in zip(("margin", "logistics", "rate", "currency_rate", "nds", "gp"), ("c9", "c10", "c11", "c12", "c13", "c14"))) + " FROM {v_const_rows}"


@query("cdc_constants_upsert", f"""
WITH g AS (SELECT brand, {', '.join(f'arg_max({f}, row_no) AS {f}' for f in ('margin', 'logistics', 'rate', 'currency_rate', 'nds', 'gp'))} FROM ({_BRANDS}) WHERE brand NOT IN ('Бренд', 'Brand') GROUP BY 1)
SELECT coalesce(k.brand, g.brand) AS brand, {', '.join(f'coalesce(g.{f}, CASE WHEN k.brand IS NULL THEN {d} ELSE k.{f} END)::DOUBLE AS {f}' for f, d in (('margin', 1.2), ('logistics', 1.03), ('rate', 4.0), ('currency_rate', 1.0), ('nds', 1.16), ('gp', 0.8)))} FROM (SELECT * FROM {{v_constants}} WHERE brand <> 'Brand#21') k FULL JOIN g ON g.brand = k.brand
""")
def cdc_constants_upsert(t):
    from matchloom.sources.sheets import brand_rows

    return H.upsert_constants(t("v_constants").where("brand <> 'Brand#21'"), brand_rows(t("v_const_rows")))


@query("cdc_currency_upsert", "SELECT coalesce(c22, 'KZT') AS name, coalesce(r, 1.0::DOUBLE) AS rate FROM (SELECT c22, arg_max(c23::DOUBLE, row_no) AS r FROM {v_const_rows} WHERE c22 IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, NULL)")
def cdc_currency_upsert(t):
    from matchloom.sources.sheets import currency_rows

    old = t.spark.createDataFrame([("USD", 1.0), ("KZT", 1.0)], "name string, rate double")
    return H.upsert_currencies(old, currency_rows(t("v_const_rows")))


@query("cdc_people_upsert", "SELECT coalesce(full_name, 'Old') AS full_name, email, full_name IS NOT NULL AS is_active FROM (SELECT c2 AS full_name, arg_min(c4, row_no) AS email FROM {v_const_rows} WHERE c2 NOT IN ('Фамилия, имя', 'ФИО') GROUP BY 1 UNION ALL SELECT NULL, 'old@example.org')")
def cdc_people_upsert(t):
    from matchloom.sources.sheets import people_rows

    old = t.spark.createDataFrame([("Person 1", "x", "y", "z", False), ("Old", None, "old@example.org", None, False)], "full_name string, position string, email string, phone string, is_active boolean")
    return H.upsert_people(old, people_rows(t("v_const_rows")), "row_no").select("full_name", "email", "is_active")


@query("cdc_patch", "SELECT id, CASE WHEN id % 10 = 0 THEN 'patched' ELSE name END AS name, CASE WHEN id % 20 = 0 THEN 9.5::DOUBLE ELSE rrts END AS rrts FROM {v_catalog}")
def cdc_patch(t):
    edits = t("v_catalog").where("id % 10 = 0").select("id", F.lit("patched").alias("name"), F.when(C("id") % 20 == 0, 9.5).alias("rrts"))
    return H.patch(t("v_catalog"), edits).select("id", "name", "rrts")


@query("cdc_soft_delete", "SELECT id, is_active AND segment <> 'os' AS is_active FROM {v_catalog}")
def cdc_soft_delete(t):
    return H.soft_delete(t("v_catalog"), C("segment") == "os").select("id", "is_active")


@query("cdc_versions", """
WITH v AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY id) AS version, concat(file_hash, id::VARCHAR) AS file_hash, TRUE AS is_active FROM {v_uploads}),
u AS (SELECT DISTINCT filename, CASE WHEN version % 2 = 0 THEN 'fresh' ELSE NULL END AS f FROM {v_uploads}),
new AS (SELECT filename, max(version) AS top FROM v JOIN u USING (filename) WHERE f IS NOT NULL GROUP BY 1)
SELECT filename, version, is_active AND f IS NULL AS is_active FROM v JOIN u USING (filename) UNION ALL SELECT filename, top + 1, FALSE FROM new UNION ALL SELECT filename, top + 2, TRUE FROM new
""")
def cdc_versions(t):
    from pyspark.sql import Window

    v = t("v_uploads").select("filename", F.row_number().over(Window.partitionBy("filename").orderBy("id")).cast("long").alias("version"), F.concat("file_hash", C("id").cast("string")).alias("file_hash"), F.lit(True).alias("is_active"))
    # Two new uploads of every second file in one batch, the first given again after them, and known ones.
    even = t("v_uploads").where("version % 2 = 0").select("filename").distinct()
    sent = even.select("filename", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.concat(F.lit(h), "filename").alias("file_hash")) for k, h in ((1, "z"), (2, "a"), (3, "z"))])).alias("u")).select("filename", "u.*")
    known = v.where("version = 1").select("filename", F.lit(4).alias("seq"), "file_hash")
    return H.new_version(v, sent.unionByName(known), "seq").select("filename", "version", "is_active")


@query("cdc_active_version", "SELECT filename, max(version) AS version FROM {v_uploads} WHERE is_active GROUP BY 1")
def cdc_active_version(t):
    return H.active_version(t("v_uploads"))


@query("cdc_correction_record", "SELECT e.id, selected_product_id, article AS selected_article, name AS selected_name, c.id IS NULL AS rejected FROM {v_corrections} e LEFT JOIN {v_catalog} c ON c.id = selected_product_id")
def cdc_correction_record(t):
    good, bad = H.record_corrections(t("v_corrections"), t("v_catalog"))
    cols = ["id", "selected_product_id", "selected_article", "selected_name", "rejected"]
    none = F.lit(None).cast("string")
    return good.withColumn("rejected", F.lit(False)).select(cols).unionByName(bad.withColumns({"selected_article": none, "selected_name": none, "rejected": F.lit(True)}).select(cols))


@query("cdc_supplier_dim", "SELECT supplier_code, id % 4 = 1 AS known, CASE WHEN id % 4 = 1 THEN id END AS old_id FROM {v_mapping}")
def cdc_supplier_dim(t):
    old = t("v_mapping").where("id % 4 = 1").select(C("id").cast("long").alias("id"), "supplier_code", "supplier_name")
    known = old.select("supplier_code", C("id").alias("old_id"))
    dim = H.supplier_dimension(old, t("v_mapping")).join(known, "supplier_code", "left")
    return dim.select("supplier_code", C("id").eqNullSafe(C("old_id")).alias("known"), "old_id")


@query("cdc_add_column", "SELECT id, 'ss' AS segment FROM {v_catalog}")
def cdc_add_column(t):
    once = H.add_column(t("v_catalog").drop("segment"), "segment", "ss")
    return H.add_column(once, "segment", "os").select("id", "segment")


def _known(t):
    return t("v_catalog").where("is_active and article <> ''")


@query("set_deleted", "SELECT article FROM {v_active} WHERE article NOT IN (SELECT article FROM {v_incoming})")
def set_deleted(t):
    return _known(t).join(t("v_incoming").select("article"), "article", "left_anti").select("article")


@query("set_new", "SELECT article FROM {v_incoming} WHERE article <> '' AND article NOT IN (SELECT article FROM {v_active})")
def set_new(t):
    return t("v_incoming").where("article <> ''").join(_known(t).select("article"), "article", "left_anti").select("article")


@query("set_common", "SELECT article FROM {v_incoming} WHERE article IN (SELECT article FROM {v_active})")
def set_common(t):
    return t("v_incoming").join(_known(t).select("article"), "article", "left_semi").select("article")
