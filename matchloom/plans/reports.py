"""Queries of statistics and latest-first lists."""

from pyspark.sql import functions as F

from matchloom.operators import reports as R
from matchloom.operators.stored import fresh_path
from matchloom.plans.changes import diff
from matchloom.plans.matching import matches
from matchloom.plans.pricing import lines
from matchloom.plans.registry import query
from matchloom.sources.commits import prepare
from matchloom.sources.writers import append_logs, log_rows, read_logs

C = F.col


@query("agg_match_stats", "SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'multiple') AS multiple, count(*) FILTER (status = 'fuzzy') AS fuzzy, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'ai_match') AS ai_match FROM {v_matches} GROUP BY 1")
def agg_match_stats(t):
    return R.match_stats(matches(t))


@query("agg_preview_stats", "SELECT count(*) FILTER (status <> 'heading') AS total, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status IN ('multiple', 'fuzzy')) AS warn, count(*) FILTER (status = 'ai_match') AS ai_match, 0::BIGINT AS low_confidence, count(*) FILTER (status = 'not_found') AS not_found, 0::BIGINT AS downgraded, count(*) FILTER (status = 'manager_match') AS history, count(*) FILTER (item_id % 9 = 0) AS corrected, count(*) FILTER (product_id IS NOT NULL AND status <> 'not_found' AND coalesce(nullif(kaznisa, 0), nullif(rrts, 0), nullif(mrc, 0), nullif(opt, 0), nullif(partner, 0)) IS NULL) AS no_price FROM {v_lines}")
def agg_preview_stats(t):
    return R.preview_stats(lines(t).withColumn("corrected", C("item_id") % 9 == 0))


@query("agg_corrections", "SELECT count(*) AS total, count(*) FILTER (indexed) AS indexed, count(DISTINCT selected_product_id) AS products FROM {v_corrections}")
def agg_corrections(t):
    return t("v_corrections").agg(F.count("*").alias("total"), F.count_if("indexed").alias("indexed"), F.count_distinct("selected_product_id").alias("products"))


@query("agg_price_coverage", "SELECT count(*) FILTER (rrts IS NOT NULL OR kaznisa IS NOT NULL OR mrc IS NOT NULL) AS with_prices, count(*) AS total FROM {v_catalog}")
def agg_price_coverage(t):
    return t("v_catalog").agg(F.count_if(F.coalesce("rrts", "kaznisa", "mrc").isNotNull()).alias("with_prices"), F.count("*").alias("total"))


@query("agg_diff_summary", "SELECT count(*) AS total, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (kind = 'updated') AS n_updated, count(*) FILTER (kind = 'deleted') AS n_deleted, count(*) FILTER (kind = 'skipped') AS n_skipped FROM {v_diff}")
def agg_diff_summary(t):
    of = lambda k: F.count_if(C("kind") == k).alias(f"n_{k}")
    return diff(t).agg(F.count("*").alias("total"), of("new"), of("updated"), of("deleted"), of("skipped"))


@query("agg_import_guard", "SELECT segment, coalesce(n, 0) AS n, segment = 'ss' AND coalesce(n, 0) > 0 AS allowed FROM (VALUES ('ss'), ('os'), ('sil')) s(segment) LEFT JOIN (SELECT segment, count(*) AS n FROM {v_import_logs} WHERE status = 'success' AND created_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14' GROUP BY 1) USING (segment)")
def agg_import_guard(t):
    return R.import_guard(t("v_import_logs"), "2024-01-15")


@query("agg_param_coverage", "SELECT count(*) AS total, count(*) FILTER (json_extract_string(props, '$.k')::INT > 5) AS with_params FROM {events}")
def agg_param_coverage(t):
    params = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: v.cast("int") > 5)
    return t("events").agg(F.count("*").alias("total"), F.count_if(F.size(params) > 0).alias("with_params"))


@query("agg_unique_people", "SELECT c2 AS full_name, min(row_no) AS row_no, arg_min(c4, row_no) AS email FROM {v_const_rows} WHERE c2 NOT IN ('Фамилия, имя', 'ФИО') GROUP BY 1")
def agg_unique_people(t):
    from matchloom.sources.sheets import people

    return people(t("v_const_rows")).select("full_name", "row_no", "email")


@query("top_import_logs", "SELECT id, filename, segment, rows_added, status FROM {v_import_logs} ORDER BY created_at DESC, id DESC LIMIT 20")
def top_import_logs(t):
    return R.latest(t("v_import_logs"), "created_at", 20).select("id", "filename", "segment", "rows_added", "status")


@query("top_uploads", "SELECT id, coalesce(full_name, username, '—') AS who, filename FROM {v_uploads} ORDER BY uploaded_at DESC, id DESC LIMIT 100")
def top_uploads(t):
    return R.latest(t("v_uploads"), "uploaded_at", 100).select("id", F.coalesce("full_name", "username", F.lit("—")).alias("who"), "filename")


@query("top_supplier_logs", "SELECT id, filename, rows_added FROM {v_import_logs} WHERE segment = 'os' ORDER BY created_at DESC, id DESC LIMIT 50")
def top_supplier_logs(t):
    return R.latest(t("v_import_logs").where("segment = 'os'"), "created_at", 50).select("id", "filename", "rows_added")


@query("top_price_history", "SELECT article, field, old_value, new_value FROM {v_price_history} WHERE article LIKE 'PROMO-%' ORDER BY article DESC, field DESC LIMIT 50")
def top_price_history(t):
    from matchloom.plans.changes import history

    return R.latest(history(t).where("article like 'PROMO-%'"), "article", 50, "field").select("article", "field", "old_value", "new_value")


@query("top_preview", "SELECT article, kind FROM {v_diff} WHERE kind <> 'skipped' ORDER BY article, kind LIMIT 20")
def top_preview(t):
    return diff(t).where("kind <> 'skipped'").orderBy("article", "kind").limit(20).select("article", "kind")


@query("top_suppliers", "SELECT DISTINCT supplier_code, supplier_name FROM {v_mapping} WHERE nds_included")
def top_suppliers(t):
    return t("v_mapping").where("nds_included").select("supplier_code", "supplier_name").distinct()


@query("src_logs", """
SELECT kind, subject, status, count(*) AS n, sum(rows_added)::BIGINT AS rows_added FROM (
  SELECT 'import' AS kind, segment AS subject, status, rows_added FROM {v_import_logs} UNION ALL SELECT 'upload', filename, is_active::VARCHAR, NULL FROM {v_uploads}
  UNION ALL SELECT 'correction', selected_product_id::VARCHAR, original_status, NULL FROM {v_corrections}) GROUP BY 1, 2, 3
""")
def src_logs(t):
    """Imports, uploads and corrections appended batch by batch; a batch that comes twice and one that was not committed change nothing."""
    path = fresh_path(t.spark, "logs")
    imports = log_rows(t("v_import_logs"), "import", "segment", "status", "created_at", "rows_added")
    uploads = log_rows(t("v_uploads"), "upload", "filename", "is_active", "uploaded_at")
    fixed = log_rows(t("v_corrections"), "correction", "selected_product_id", "original_status", "created_at")
    for batch, rows in (("imports-0", imports.where("id % 2 = 0")), ("imports-1", imports.where("id % 2 <> 0")), ("imports-0", imports.where("id % 2 = 0")), ("uploads", uploads), ("corrections", fixed)):
        append_logs(rows, path, batch)
    prepare(uploads, path, "lost")
    return read_logs(t.spark, path).groupBy("kind", "subject", "status").agg(F.count("*").alias("n"), F.sum("rows_added").alias("rows_added"))
