"""Fixture views over the driver's tables, in the shape of the data model.

Each view has a Spark form and a DuckDB form; most share one text.  ``{name}``
refers to a table or another view.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SHARED: dict[str, str] = {}
DUCK: dict[str, str] = {}
SPARK: dict[str, str] = {}

SHARED["v_catalog"] = """
SELECT p_partkey AS id, p_partkey AS num,
  concat(p_type, '-', CAST(p_size AS STRING), '-', CAST(p_partkey AS STRING)) AS article,
  concat(p_name, ' ', lower(p_type), ' size ', CAST(p_size AS STRING)) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'm' ELSE 'pcs' END AS unit,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice * 1.25E0 END AS kaznisa,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS rrts,
  CASE WHEN p_partkey % 9 = 0 THEN p_retailprice * 1.125E0 END AS mrc,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice * 0.5E0 END AS opt,
  CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 0.75E0 END AS partner,
  p_brand AS brand,
  CASE WHEN p_partkey % 8 = 0 THEN 10 END AS multiplicity,
  concat(lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(p_size AS STRING), 3, '0'), '-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) AS kaznisa_code,
  CASE p_partkey % 3 WHEN 0 THEN 'ss' WHEN 1 THEN 'os' ELSE 'sil' END AS segment,
  p_partkey % 11 <> 0 AS is_active
FROM {part}
"""

_SPEC_COLUMNS = """
  l_orderkey AS doc_id, l_linenumber AS seq, CAST(l_linenumber AS STRING) AS pos,
  CASE WHEN (l_orderkey + l_linenumber) % 8 IN (4, 7) THEN 'unknown'
       WHEN (l_orderkey + l_linenumber) % 8 = 5 THEN concat('1 / ', name) ELSE name END AS name_raw,
  CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN article
    WHEN 1 THEN concat(lower(article), ' IEK')
    WHEN 2 THEN replace(article, '-', '–')
    WHEN 3 THEN substring(article, 1, length(article) - 1)
    WHEN 6 THEN concat(substring(article, 1, 4), 'X', substring(article, 5, 100))
    WHEN 7 THEN concat('ZZ', CAST(l_suppkey AS STRING))
    ELSE '' END AS article_raw,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 4 THEN kaznisa_code ELSE '' END AS kaznisa_code_raw,
  CASE WHEN l_linenumber = 3 THEN 'kg' ELSE 'pcs' END AS unit,
  l_quantity AS qty,
  l_linenumber = 1 AND l_returnflag = 'R' AS is_heading
"""
_SPEC_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
DUCK["v_spec_items"] = f"SELECT row_number() OVER (ORDER BY {', '.join(_SPEC_ORDER)}) AS item_id, {_SPEC_COLUMNS} FROM {{lineitem}} JOIN {{v_catalog}} ON id = l_partkey"
#: Orders that one window of the row numbering spans.
_NUMBER_BLOCK = 4096

SHARED["v_incoming"] = """
SELECT p_partkey AS row_no, concat(p_type, '-', CAST(p_size AS STRING), '-', CAST(p_partkey AS STRING)) AS article,
  p_name AS name, p_brand AS brand, p_retailprice * 0.5E0 AS price_base,
  p_retailprice + (p_partkey % 4) AS price_rrts,
  CASE WHEN p_partkey % 10 = 0 THEN p_retailprice * 0.625E0 END AS price_opt,
  CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 0.75E0 END AS price_partner
FROM {part} WHERE p_partkey % 5 <> 1
UNION ALL
SELECT 1000000000 + s_suppkey, concat('NEW-', CAST(s_suppkey AS STRING)), s_name, NULL, s_acctbal, NULL, NULL, NULL FROM {supplier}
UNION ALL
SELECT 2000000000 + s_suppkey, '', s_name, NULL, NULL, NULL, NULL, NULL FROM {supplier} WHERE s_suppkey % 10 = 0
"""
SHARED["v_constants"] = """
SELECT p_brand AS brand, 1.25E0 + (n % 4) * 0.125E0 AS margin, 1.0625E0 AS logistics, 1 + n % 8 AS rate,
  CASE WHEN n % 5 = 0 THEN NULL ELSE 1E0 + (n % 3) * 0.5E0 END AS currency_rate, 1.125E0 AS nds, 0.75E0 AS gp
FROM (SELECT DISTINCT p_brand, CAST(substring(p_brand, 7, 5) AS INT) AS n FROM {part}) b WHERE n <> 13
"""
SHARED["v_import_logs"] = """
SELECT event_id AS id, concat('file_', CAST(user_id AS STRING)) AS filename,
  CASE user_id % 3 WHEN 0 THEN 'ss' WHEN 1 THEN 'os' ELSE 'sil' END AS segment,
  CAST(floor(value) AS INT) AS rows_added,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, ts AS created_at
FROM {events}
"""
SHARED["v_uploads"] = """
SELECT event_id AS id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('user_', CAST(user_id AS STRING)) END AS full_name,
  concat('user_', CAST(user_id AS STRING)) AS username, concat('file_', CAST(user_id AS STRING)) AS filename,
  user_id AS version, md5(concat('file_', CAST(user_id AS STRING))) AS file_hash,
  event_type = 'purchase' AS is_active, ts AS uploaded_at
FROM {events}
"""
SHARED["v_corrections"] = """
SELECT event_id AS id, user_id * 20 AS selected_product_id, event_type AS original_status, event_id % 3 = 0 AS indexed, ts AS created_at
FROM {events} WHERE event_type IN ('click', 'view')
"""
SHARED["v_vectors"] = """
SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'ss' WHEN 1 THEN 'os' ELSE 'sil' END AS segment, embedding FROM {embeddings}
"""
SHARED["v_pages"] = "SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc_id, doc_id % 10 AS page, text FROM {documents}"
SHARED["v_sheet_rows"] = """
SELECT 'BD' AS sheet, p_partkey + 2 AS row_no, CAST(p_partkey AS STRING) AS c1,
  CASE WHEN p_partkey % 13 = 0 THEN '-' ELSE concat(' ', p_type, '-', CAST(p_partkey % 900 AS STRING), ' ') END AS c2,
  p_name AS c3, CASE WHEN p_partkey % 5 = 0 THEN 'None' ELSE 'm' END AS c4,
  CASE p_partkey % 4 WHEN 0 THEN '1 250,5' WHEN 1 THEN '-3' WHEN 2 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS c5,
  CAST(p_size * 2 AS STRING) AS c6, CASE WHEN p_partkey % 6 = 0 THEN '0' ELSE '12.75' END AS c7,
  CAST(NULL AS STRING) AS c8, CAST(p_size + 1 AS STRING) AS c9, p_brand AS c10,
  CASE WHEN p_partkey % 8 = 0 THEN '10.0' ELSE '' END AS c11,
  concat('247-201-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) AS c12
FROM {part}
"""
SHARED["v_const_rows"] = """
SELECT s_suppkey + 2 AS row_no,
  CASE WHEN s_suppkey % 9 = 0 THEN 'ФИО' ELSE concat('Person ', CAST(s_suppkey % 40 AS STRING)) END AS c2,
  CASE WHEN s_suppkey % 3 = 0 THEN '—' ELSE 'engineer' END AS c3,
  concat('p', CAST(s_suppkey AS STRING), '@example.org') AS c4,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(1000 + s_suppkey AS STRING) END AS c5,
  CASE WHEN s_suppkey = 0 THEN 'Brand' ELSE concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING)) END AS c8,
  CASE WHEN s_suppkey % 2 = 0 THEN '1,25' ELSE NULL END AS c9, '1.0625' AS c10,
  CAST(1 + s_suppkey % 8 AS STRING) AS c11, CAST(NULL AS STRING) AS c12, '1.125' AS c13, '0,75' AS c14,
  CASE s_suppkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE NULL END AS c22, CAST(400 + s_suppkey AS STRING) AS c23
FROM {supplier}
"""
SHARED["v_pricelist_rows"] = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a.csv' ELSE 'b.csv' END AS file, 'Price' AS sheet, p_partkey + 1 AS row_no,
  CASE WHEN p_partkey % 20 = 0 THEN p_type ELSE NULL END AS c1,
  CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 700 AS STRING) ELSE concat('A', CAST(p_partkey AS STRING)) END AS c2,
  p_name AS c3, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'pcs' END AS c4,
  CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE concat(CAST(p_size AS STRING), ',5') END AS c5,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('1 ', lpad(CAST(p_size AS STRING), 3, '0')) END AS c6,
  p_type AS c7, p_brand AS c8,
  CASE p_partkey % 3 WHEN 0 THEN '10.0' WHEN 1 THEN 'x' ELSE '' END AS c9, concat(CAST(p_size AS STRING), '.25') AS c10,
  CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(p_size * 2 AS STRING) END AS c11, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE concat('N', CAST(p_partkey AS STRING)) END AS c12,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'stock' END AS c13, concat(' ', p_name, chr(10)) AS c14
FROM {part}
"""
#: Rows of six vendors' files, each laid out as that vendor does it; a part belongs to one vendor.
_VENDOR_ROWS = {
    "himel": ("'Тариф'", 4, {1: "{article}", 2: "{name}", 3: "{unit}", 4: "{pack}", 5: "{price}", 6: "{note}", 7: "{code}"}),
    "ekf": ("CASE WHEN p_partkey % 5 = 0 THEN 'Новинки' ELSE 'Продукция EKF' END", 13, {1: "concat('E', CAST(p_partkey % 300 AS STRING))", 2: "{name}", 6: "{unit}", 7: "{price}", 8: "{price2}", 9: "{price3}", 10: "{price4}", 11: "{pack}"}),
    "iek": ("'Прайс'", 9, {1: "{article}", 2: "{name}", 4: "{group}", 8: "{unit}", 9: "{code}", 10: "{note}", 13: "{pack}", 15: "{price}", 16: "{price2}", 17: "{price3}", 20: "{price4}"}),
    "dkc": ("'Прайс ДКС'", 17, {2: "CASE WHEN p_partkey % 29 < 3 THEN p_type END", 6: "CASE WHEN p_partkey % 29 >= 3 THEN {article} END", 8: "{name}", 9: "{unit}", 10: "{pack}", 11: "{price2}", 12: "{price}"}),
    "legrand": ("'Тариф'", 5, {2: "CAST(p_size AS STRING)", 3: "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE {article} END", 4: "{name}", 6: "{group}", 7: "CASE WHEN p_partkey % 5 = 0 THEN p_brand END", 15: "{unit}", 16: "{price}"}),
    "schneider": ("'Тариф 2026'", 8, {1: "{article}", 2: "{name}", 3: "{price}", 4: "{price2}", 5: "{unit}", 6: "{group}"}),
}
_VENDOR_CELLS = {
    "article": "CASE WHEN p_partkey % 29 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN concat('00', CAST(p_partkey % 700 AS STRING)) ELSE concat('V', CAST(p_partkey AS STRING)) END",
    "name": "CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_name END",
    "unit": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE ' pcs' END",
    "pack": "CASE p_partkey % 5 WHEN 0 THEN '12.0' WHEN 1 THEN 'x' ELSE CAST(p_size AS STRING) END",
    "price": "CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE concat(CAST(p_size AS STRING), ' 025,5') END",
    "price2": "CASE WHEN p_partkey % 11 < 6 THEN NULL ELSE concat(CAST(p_size AS STRING), '.75') END",
    "price3": "CAST(p_size * 3 AS STRING)",
    "price4": "CASE WHEN p_partkey % 13 = 0 THEN '-' ELSE CAST(p_size * 4 AS STRING) END",
    "group": "concat('G', CAST(p_partkey % 7 AS STRING))",
    "code": "CASE WHEN p_partkey % 5 = 1 THEN '' ELSE concat('N', CAST(p_size AS STRING)) END",
    "note": "CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE concat(p_type, chr(10), 'x') END",
}


def _vendor_rows() -> str:
    wide = lambda cols: ", ".join(f"{cols.get(k, 'CAST(NULL AS STRING)')} AS c{k}" for k in range(1, 21))
    parts = [
        f"SELECT '{vendor}' AS file, {sheet} AS sheet, CAST({start - 1} + floor(p_partkey / 6) AS BIGINT) AS row_no, {wide({k: c.format(**_VENDOR_CELLS) for k, c in cols.items()})} FROM {{part}} WHERE p_partkey % 6 = {k}"
        for k, (vendor, (sheet, start, cols)) in enumerate(_VENDOR_ROWS.items())
    ]
    group, value = "concat('G', CAST(r_regionkey AS STRING))", "CASE r_regionkey WHEN 0 THEN '0' WHEN 1 THEN 'none' ELSE CAST(r_regionkey * 0.125E0 AS STRING) END"
    parts.append(f"SELECT 'legrand', 'Заказ', CAST(r_regionkey + 1 AS BIGINT), {wide({4: group, 5: value})} FROM {{region}}")
    parts.append(f"SELECT 'schneider', 'Тариф 2026', CAST(r_regionkey + 2 AS BIGINT), {wide({1: group, 2: value})} FROM {{region}}")
    return " UNION ALL ".join(parts)


SHARED["v_vendor_rows"] = _vendor_rows()
#: A layout a supplier; five files, so that several layouts compete for one.
SHARED["v_mapping"] = """
SELECT s_suppkey AS id, concat(substring('abcde', CAST(s_suppkey % 5 AS INT) + 1, 1), '.csv') AS signature,
  concat('sup_', CAST(s_suppkey AS STRING)) AS supplier_code, s_name AS supplier_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Price' ELSE 'price' END AS sheet, 2 AS data_start_row, 2 AS col_article, 3 AS col_name, 4 AS col_unit,
  CASE WHEN s_suppkey % 5 = 1 THEN 6 ELSE 5 END AS col_price_base, CASE WHEN s_suppkey % 5 = 1 THEN 5 ELSE 6 END AS col_price_rrts,
  CASE WHEN s_suppkey % 5 <> 1 THEN 8 END AS brand_column, s_suppkey % 5 <> 1 AS nds_included, 0.25E0 AS nds_rate,
  9 AS col_multiplicity, 10 AS col_price_opt, CASE WHEN s_suppkey % 5 <> 1 THEN 11 END AS col_price_partner, 12 AS col_ntin, 13 AS col_status, CASE WHEN s_suppkey % 5 = 1 THEN 14 END AS col_comment,
  7 AS category_col, 'House' AS brand, CASE WHEN s_suppkey % 5 = 1 THEN 6 END AS skip_row_if_empty_col,
  concat('2024-', lpad(CAST(1 + s_suppkey % 12 AS STRING), 2, '0'), '-01') AS created_at
FROM {supplier}
"""

SPARK["v_word_boxes"] = """
SELECT doc, page, text, (word * 37) % 101 AS conf, word * 120 + 30 * (word DIV 4) AS left, 40 * line + (word % 3) * 4 AS top, 10 * least(length(text), 11) AS width
FROM (SELECT doc, page, line, posexplode(filter(split(body, ' '), x -> x <> '')) AS (word, text)
  FROM (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc, doc_id % 10 AS page, posexplode(split(text, '\n')) AS (line, body) FROM {documents}))
"""
DUCK["v_word_boxes"] = """
SELECT doc, page, text, ((word * 37) % 101)::INT AS conf, (word * 120 + 30 * (word // 4))::BIGINT AS left, (40 * line + (word % 3) * 4)::INT AS top, (10 * least(length(text), 11))::INT AS width
FROM (SELECT doc, page, line, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word
  FROM (SELECT doc, page, line, list_filter(string_split(body, ' '), lambda x: x <> '') AS ws
    FROM (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc, doc_id % 10 AS page, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM {documents})))
"""

#: One table an order: a header and a numbering row in every third, then a row a line.
_CELL_ROWS = """
SELECT CAST(floor(l_orderkey / 3) AS BIGINT) AS doc_id, l_orderkey % 3 AS table_no, r + 1 AS row_no,
  CASE WHEN k IN (0, 2, 4, 6) THEN '' WHEN k = 1 THEN '-' WHEN k = 3 THEN concat('PNL-', CAST(r AS STRING)) ELSE CAST(r AS STRING) END AS c1,
  CASE k WHEN 0 THEN '' WHEN 2 THEN concat(CAST(r AS STRING), '. Section') WHEN 4 THEN 'Corrugated pipes DIN 7777' WHEN 5 THEN '20 mm' WHEN 7 THEN 'mounting equipment' ELSE concat('part ', CAST(l_partkey AS STRING)) END AS c2,
  CASE WHEN k IN (0, 2, 3, 4) THEN '' WHEN k = 7 THEN 'гост 17' WHEN k = 9 THEN 'ОЙСТВО)' ELSE concat('sku–', CAST(l_partkey AS STRING)) END AS c3,
  CASE WHEN k IN (1, 3, 8) THEN concat('247-201-', lpad(CAST(l_partkey % 10000 AS STRING), 4, '0')) WHEN k = 9 THEN '2 4 7-201' ELSE '' END AS c4,
  CASE WHEN k IN (2, 4) THEN '' WHEN l_linenumber = 2 THEN 'м' ELSE 'шт' END AS c5,
  CASE WHEN k IN (2, 4) THEN '' WHEN k = 5 THEN concat(CAST(l_suppkey % 9 AS STRING), ',5') ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS c6
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST((l_orderkey + l_linenumber) % 10 AS INT) AS k,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS r FROM {lineitem}) x
UNION ALL
SELECT CAST(floor(o_orderkey / 3) AS BIGINT), o_orderkey % 3, 0, 'Поз.', 'Наименование', 'Тип, марка', 'Код оборудования', 'Ед. изм.', 'Кол-во' FROM {orders} WHERE o_orderkey % 3 = 0
UNION ALL
SELECT CAST(floor(o_orderkey / 3) AS BIGINT), o_orderkey % 3, 1, '1', '2', '3', '4', '5', '6' FROM {orders} WHERE o_orderkey % 3 = 0
"""
SPARK["v_table_cells"] = f"SELECT doc_id, CAST(1 AS BIGINT) AS page, table_no, CAST(row_no AS BIGINT) AS row_no, array(c1, c2, c3, c4, c5, c6) AS cells FROM ({_CELL_ROWS})"
DUCK["v_table_cells"] = f"SELECT doc_id, 1::BIGINT AS page, table_no, row_no::BIGINT AS row_no, [c1, c2, c3, c4, c5, c6] AS cells FROM ({_CELL_ROWS})"

SPARK["v_events_params"] = """
SELECT CAST(floor(event_id / 15) AS BIGINT) AS batch, to_json(named_struct('results', collect_list(named_struct('idx', idx, 'params', params)))) AS reply
FROM (SELECT event_id, CAST(event_id % 15 AS INT) AS idx, from_json(props, 'map<string,string>') AS params FROM {events} ORDER BY event_id) GROUP BY 1
"""

for _name, _text in SHARED.items():
    SPARK[_name] = DUCK[_name] = _text


class Tables:
    """Tables and views of one folder: ``t("v_catalog")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "v_spec_items":
                self._held[name] = self._spec_items()
            else:
                self._held[name] = self.sql(SPARK[name])
        return self._held[name]

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: self(n) for n in names})

    def _spec_items(self) -> DataFrame:
        """The view with its global row numbers counted in parallel: rows are numbered within
        blocks of orders, and each block starts after the rows of the blocks before it."""
        joined = self("lineitem").join(self("v_catalog"), F.col("id") == F.col("l_partkey")).withColumn("block", F.floor(F.col("l_orderkey") / _NUMBER_BLOCK))
        counts = self("lineitem").join(self("v_catalog"), F.col("id") == F.col("l_partkey"), "left_semi").groupBy(F.floor(F.col("l_orderkey") / _NUMBER_BLOCK).alias("block")).count()
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        rank = F.row_number().over(Window.partitionBy("block").orderBy(*_SPEC_ORDER))
        numbered = joined.withColumn("rank", rank).join(starts, "block").withColumn("item_id", (F.col("rank") + F.col("start")).cast("long"))
        return numbered.selectExpr("item_id", *_split_columns(_SPEC_COLUMNS))


@lru_cache
def _split_columns(text: str) -> tuple[str, ...]:
    """Top-level comma split of a select list."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    out.append(text[at:])
    return tuple(x.strip() for x in out)
