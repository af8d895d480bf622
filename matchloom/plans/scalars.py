"""Queries of the cleaning and scalar functions, on rows with an id to tell them apart."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X
from matchloom.plans import sql as S
from matchloom.plans.registry import query

C = F.col


@query("fn_safe_float", f"SELECT row_no, {S.safe_float('c5')} AS v5, {S.safe_float('c7')} AS v7 FROM {{v_sheet_rows}}")
def fn_safe_float(t):
    return t("v_sheet_rows").select("row_no", X.safe_float(C("c5")).alias("v5"), X.safe_float(C("c7")).alias("v7"))


@query("fn_safe_int", f"SELECT row_no, {S.safe_int('c1')} AS v1, {S.safe_int('c11')} AS v11 FROM {{v_sheet_rows}}")
def fn_safe_int(t):
    return t("v_sheet_rows").select("row_no", X.safe_int(C("c1")).alias("v1"), X.safe_int(C("c11")).alias("v11"))


@query("fn_safe_str", f"SELECT row_no, {S.safe_str('c2')} AS v2, {S.safe_str('c4')} AS v4 FROM {{v_sheet_rows}}")
def fn_safe_str(t):
    return t("v_sheet_rows").select("row_no", X.safe_str(C("c2")).alias("v2"), X.safe_str(C("c4")).alias("v4"))


@query("fn_price_parse", f"SELECT file, row_no, {S.price('c5')} AS v5, {S.price('c6')} AS v6 FROM {{v_pricelist_rows}}")
def fn_price_parse(t):
    return t("v_pricelist_rows").select("file", "row_no", X.price_parse(C("c5")).alias("v5"), X.price_parse(C("c6")).alias("v6"))


@query("fn_clean_str", f"SELECT row_no, {S.clean('c2')} AS v2, {S.clean('c8')} AS v8 FROM {{v_sheet_rows}}")
def fn_clean_str(t):
    return t("v_sheet_rows").select("row_no", X.clean_str(C("c2")).alias("v2"), X.clean_str(C("c8")).alias("v8"))


@query("fn_normalize", f"SELECT item_id, {S.norm('article_raw')} AS article, {S.norm('name_raw')} AS name FROM {{v_spec_items}}")
def fn_normalize(t):
    return t("v_spec_items").select("item_id", X.normalize(C("article_raw")).alias("article"), X.normalize(C("name_raw")).alias("name"))


@query("fn_strip_brand", f"SELECT item_id, {S.brand('a')} AS article FROM (SELECT item_id, {S.norm('article_raw')} AS a FROM {{v_spec_items}})")
def fn_strip_brand(t):
    return t("v_spec_items").select("item_id", X.strip_brand(X.normalize(C("article_raw"))).alias("article"))


@query("fn_strip_subitem", f"SELECT item_id, regexp_replace({S.strip('name_raw')}, '^[0-9]+\\s*/\\s*', '') AS name FROM {{v_spec_items}}")
def fn_strip_subitem(t):
    return t("v_spec_items").select("item_id", X.strip_subitem(C("name_raw")).alias("name"))


@query("fn_strip_cyrillic", f"SELECT doc_id, table_no, row_no, {S.nocyr('upper(cells[3])')} AS article FROM {{v_table_cells}}")
def fn_strip_cyrillic(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.strip_cyrillic(F.upper(C("cells")[2])).alias("article"))


@query("fn_article_clean", f"SELECT doc_id, table_no, row_no, {S.article_clean('cells[3]')} AS article FROM {{v_table_cells}}")
def fn_article_clean(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.article_clean(C("cells")[2]).alias("article"))


@query("fn_qty", f"SELECT doc_id, table_no, row_no, {S.qty('cells[6]')} AS qty FROM {{v_table_cells}}")
def fn_qty(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.quantity(C("cells")[5]).alias("qty"))


_REF = f"lower({S.strip('cells[3]')})"


@query("fn_standard_ref", f"SELECT doc_id, table_no, row_no, CASE WHEN regexp_matches({_REF}, '^({'|'.join(L.STANDARD_PREFIXES)})') OR {S.any_in(_REF, L.STANDARD_PARTS)} THEN '' ELSE cells[3] END AS article FROM {{v_table_cells}}")
def fn_standard_ref(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.standard_ref(C("cells")[2]).alias("article"))


@query("fn_code_repair", f"SELECT doc_id, table_no, row_no, {S.code('cells[4]', 'cells[5]')} AS code FROM {{v_table_cells}}")
def fn_code_repair(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.code_repair(C("cells"), 3).alias("code"))


@query("fn_code_digits", f"SELECT id, {S.digits('kaznisa_code')} AS digits, length({S.digits('kaznisa_code')}) = 10 AS valid FROM {{v_catalog}}")
def fn_code_digits(t):
    return t("v_catalog").select("id", X.code_digits(C("kaznisa_code")).alias("digits"), X.valid_code(C("kaznisa_code")).alias("valid"))


_HEAD = "lower(" + S.strip("regexp_replace(coalesce(cells[3], ''), '[\\s\\x{00A0}]+', ' ', 'g')") + ")"


@query("fn_header_norm", f"SELECT doc_id, table_no, row_no, {_HEAD} AS head, regexp_replace({_HEAD}, '[-\\s\\x{{00A0}}]+', '', 'g') AS head_key FROM {{v_table_cells}}")
def fn_header_norm(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.header_norm(C("cells")[2]).alias("head"), X.header_key(C("cells")[2]).alias("head_key"))


@query("fn_pos_value", f"SELECT doc_id, table_no, row_no, {S.pos('cells[1]')} AS pos FROM {{v_table_cells}}")
def fn_pos_value(t):
    return t("v_table_cells").select("doc_id", "table_no", "row_no", X.pos_value(C("cells")[0]).alias("pos"))


@query("fn_embed_text", "SELECT id, concat_ws(' | ', nullif(trim(article), ''), nullif(trim(name), '')) AS embed_text, lower(concat_ws(' | ', nullif(trim(article), ''), nullif(trim(name), ''))) AS embed_key FROM {v_catalog}")
def fn_embed_text(t):
    return t("v_catalog").select("id", X.embed_text(C("article"), C("name")).alias("embed_text"), X.embed_key(C("article"), C("name")).alias("embed_key"))


_WRAPPED = "CASE item_id % 3 WHEN 0 THEN 'На вводе ' || name_raw WHEN 1 THEN name_raw || ', в том числе:' ELSE 'на линий' END"
_PRE = S.strip(f"regexp_replace({_WRAPPED}, '(?i)^\\.*\\s*на\\s+(?:вводе?|линий?|ответвлении?|отходящих?)\\s*', '')")
_CUT = S.strip(f"regexp_replace({_PRE}, '(?i),?\\s*в\\s+том\\s+числе\\s*[:.]?\\s*$', '')")


@query("fn_query_context", f"SELECT item_id, CASE WHEN {_CUT} <> '' THEN {_CUT} ELSE {_WRAPPED} END AS name FROM {{v_spec_items}}")
def fn_query_context(t):
    return t("v_spec_items").select("item_id", X.query_context(F.expr(_WRAPPED)).alias("name"))


@query("fn_params_text", "SELECT event_id, 'k ' || json_extract_string(props, '$.k') AS params FROM {events}")
def fn_params_text(t):
    return t("events").select("event_id", X.params_text(F.from_json("props", "map<string,string>")).alias("params"))


_SEGS = "CASE event_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'SS, sil' WHEN 2 THEN event_type WHEN 3 THEN '' ELSE 'os,' || event_type END"


@query("fn_segments", f"SELECT event_id, array_to_string(CASE WHEN s = 'all' THEN ['ss', 'os', 'sil'] WHEN len(l) = 0 THEN ['ss'] ELSE l END, ',') AS segments FROM (SELECT event_id, s, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x IN ('ss', 'os', 'sil')) AS l FROM (SELECT event_id, lower({_SEGS}) AS s FROM {{events}}))")
def fn_segments(t):
    return t("events").select("event_id", F.array_join(X.segments(F.expr(_SEGS)), ",").alias("segments"))


@query("fn_catalog_defaults", "SELECT id, trim(coalesce(article, '')) AS article, trim(coalesce(name, '')) AS name, trim(coalesce(nullif(unit, 'm'), 'шт.')) AS unit, trim(coalesce(brand, '')) AS brand, trim(coalesce(segment, 'ss')) AS segment, trim(coalesce(kaznisa_code, '')) AS kaznisa_code FROM {v_catalog}")
def fn_catalog_defaults(t):
    from matchloom.operators.catalog import with_defaults

    return with_defaults(t("v_catalog").withColumn("unit", F.expr("nullif(unit, 'm')"))).select("id", "article", "name", "unit", "brand", "segment", "kaznisa_code")


@query("fn_pad_article", f"SELECT file, row_no, CASE WHEN regexp_matches({S.clean('c2')}, '^[0-9]+$') THEN CASE WHEN length({S.clean('c2')}) < 6 THEN lpad({S.clean('c2')}, 6, '0') ELSE {S.clean('c2')} END ELSE {S.clean('c2')} END AS article FROM {{v_pricelist_rows}}")
def fn_pad_article(t):
    return t("v_pricelist_rows").select("file", "row_no", X.pad_article(C("c2")).alias("article"))


@query("fn_vat_exclude", f"SELECT file, row_no, round({S.price('c5')} / CASE WHEN file = 'a.csv' THEN 1 + 0.25::DOUBLE ELSE 1.0::DOUBLE END, 2) AS price FROM {{v_pricelist_rows}}")
def fn_vat_exclude(t):
    return t("v_pricelist_rows").select("file", "row_no", X.vat_exclude(X.price_parse(C("c5")), F.lit(0.25), C("file") == "a.csv").alias("price"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.METHOD_LABELS.items())


@query("fn_method_label", f"SELECT item_id, CASE m {_LABELS} ELSE CASE WHEN m LIKE 'ai%' THEN 'ИИ' ELSE m END END AS label FROM (SELECT item_id, CASE item_id % 7 WHEN 0 THEN 'ai_vector' WHEN 1 THEN 'correction_history' WHEN 2 THEN 'other' ELSE coalesce(match_method, '') END AS m FROM {{v_matches}})")
def fn_method_label(t):
    from matchloom.plans.matching import matches

    m = F.expr("CASE item_id % 7 WHEN 0 THEN 'ai_vector' WHEN 1 THEN 'correction_history' WHEN 2 THEN 'other' ELSE match_method END")
    return matches(t).select("item_id", X.method_label(m).alias("label"))


_JSON = "CASE id % 3 WHEN 1 THEN '{\"supplier_code\":\"a\",\"supplier_name\":\"A\",\"sheet\":\"s\",\"header_row\":1,\"data_start_row\":2,\"columns\":{\"article\":2}}' WHEN 2 THEN '{\"supplier_code\":\"a\",\"columns\":{\"article\":2}}' ELSE '{\"supplier_code\":\"a\",\"supplier_name\":\"A\",\"sheet\":\"s\",\"header_row\":1,\"data_start_row\":2,\"columns\":{\"name\":2}}' END"


@query("fn_mapping_validate", "SELECT id, id % 3 = 1 AS valid, CASE id % 3 WHEN 1 THEN NULL WHEN 2 THEN 'missing: supplier_name' ELSE 'no article column' END AS error FROM {v_mapping}")
def fn_mapping_validate(t):
    from matchloom.sources.pricelists import validate_mapping

    return validate_mapping(t("v_mapping").withColumn("mapping", F.expr(_JSON)), "mapping").select("id", "valid", "error")
