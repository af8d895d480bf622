"""Queries over page texts, word boxes and cell tables, with words of the fixture languages."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.operators import pages as G
from matchloom.operators import tables as B
from matchloom.plans import sql as S
from matchloom.plans.registry import query
from matchloom.plans.views import DUCK

C = F.col

WORDS = {"title": ("ering the", "heit die"), "index": ("thble",), "suffix": (".re",), "position": ("and ", "und "), "name": ("the ", "der "), "quantity": ("ing", "keit"), "type": ("tion o", "ung e")}
TITLE_WORDS = ("tion", "ung")


def _w(key: str) -> str:
    return S.any_in("lower(text)", WORDS[key])


_THREE = f"({_w('position')} AND {_w('name')} AND {_w('quantity')})"
_SPEC = f"CASE WHEN {_w('title')} THEN NOT ({_w('index')} AND NOT {_w('position')}) ELSE {_THREE} AND ({_w('suffix')} OR regexp_matches(lower(text), '\\.co([^\\w]|$)') OR {_w('type')}) END"
DUCK["v_spec_pages"] = f"SELECT *, {_SPEC} AS is_spec FROM {{v_pages}}"
_TITLE = "title"
_OTHER = "length(regexp_replace(title, '[а-яёА-ЯЁ\\s]', '', 'g'))"
_SCORE = f"greatest(0.0::DOUBLE, least(CASE WHEN {S.any_in('lower(title)', TITLE_WORDS)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + least(length(title) / 200.0::DOUBLE, 0.3::DOUBLE) - CASE WHEN regexp_matches(title, '[A-Z]{{2,}}-[0-9]{{2,}}') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN {_OTHER} > length(title) * 0.6::DOUBLE THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE))".replace("{{", "{").replace("}}", "}")
_LINES = f"SELECT doc_id, page, line, {S.strip('raw')} AS title FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {{v_pages}})"


@query("doc_page_classify", "SELECT doc_id, page, is_spec FROM {v_spec_pages}")
def doc_page_classify(t):
    return t("v_pages").select("doc_id", "page", G.is_spec(C("text"), WORDS).alias("is_spec"))


@query("doc_page_select", "SELECT doc_id, page, is_spec FROM (SELECT *, bool_or(is_spec) OVER (PARTITION BY doc_id) AS any_spec FROM {v_spec_pages}) WHERE is_spec OR NOT any_spec")
def doc_page_select(t):
    return G.selected_pages(t("v_pages"), WORDS).select("doc_id", "page", "is_spec")


@query("doc_title_pages", "SELECT doc_id, page FROM (SELECT *, bool_or(NOT is_spec) OVER (PARTITION BY doc_id) AS any_spec, row_number() OVER (PARTITION BY doc_id ORDER BY is_spec, page) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS p FROM {v_spec_pages} WHERE page < 10) WHERE (any_spec AND NOT is_spec AND r <= 5) OR (NOT any_spec AND p <= 5)")
def doc_title_pages(t):
    return G.title_pages(t("v_pages"), WORDS).select("doc_id", "page")


@query("doc_title_score", f"SELECT doc_id, page, line::INT - 1 AS line, round({_SCORE}, 9) AS score FROM ({_LINES}) WHERE length(title) > 0")
def doc_title_score(t):
    from matchloom.functions.text import strip

    rows = t("v_pages").select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("title", strip(C("raw"))).where("title <> ''")
    return rows.select("doc_id", "page", "line", F.round(G.title_score(C("title"), TITLE_WORDS), 9).alias("score"))


@query("top_project_title", f"SELECT doc_id, title, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, line) AS r FROM (SELECT *, {_SCORE} AS score FROM ({_LINES}) WHERE length(title) BETWEEN 10 AND 300)) WHERE r = 1 AND score >= 0.1")
def top_project_title(t):
    return G.project_titles(t("v_pages"), TITLE_WORDS, 0.1).select("doc_id", "title", F.round("score", 9).alias("score"))


@query("doc_title_fallback", "SELECT id, coalesce(full_name, trim(regexp_replace(concat(filename, '.x.pdf'), '\\.[^.]*$', ''))) AS title FROM {v_uploads}")
def doc_title_fallback(t):
    return t("v_uploads").select("id", G.title_or_file(C("full_name"), F.concat("filename", F.lit(".x.pdf"))).alias("title"))


@query("doc_scanned", "SELECT doc_id, coalesce(max(CASE WHEN page < 5 THEN length(trim(coalesce(CASE WHEN doc_id % 3 <> 0 THEN text END, ''))) END), 0) <= 30 AS scanned FROM {v_pages} GROUP BY 1")
def doc_scanned(t):
    return G.scanned(t("v_pages").withColumn("text", F.when(C("doc_id") % 3 != 0, C("text"))))


@query("tbl_non_spec", "SELECT doc_id, page, table_no, row_no FROM {v_table_cells} ANTI JOIN (SELECT DISTINCT doc_id, page, table_no FROM {v_table_cells} WHERE row_no < 4 AND (contains(lower(array_to_string(cells, ' ')), 'section') OR contains(lower(array_to_string(cells, ' ')), 'pnl-'))) USING (doc_id, page, table_no)")
def tbl_non_spec(t):
    return B.spec_tables(t("v_table_cells"), ("section", "pnl-")).select("doc_id", "page", "table_no", "row_no")


def _key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[-\\s]+', '', 'g')"


def _find(key: str) -> str:
    words = "|".join(w.replace("-", "").replace(" ", "").replace(".", "\\.") for w in L.HEADER_PATTERNS[key])
    return f"list_position(list_transform(cells, lambda c: regexp_matches({_key('c')}, '{words}')), TRUE)::INT - 1"


DUCK["v_heads"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, table_no ORDER BY header_row) AS r FROM (SELECT doc_id, page, table_no, row_no AS header_row, {', '.join(f'{_find(k)} AS {k}' for k in B.KEYS)} FROM {{v_table_cells}} WHERE row_no < 6)
  WHERE pos >= 0 AND article >= 0 AND qty >= 0) WHERE r = 1
"""


@query("tbl_header_detect", "SELECT doc_id, page, table_no, header_row, pos, name, article, code, unit, qty FROM {v_heads}")
def tbl_header_detect(t):
    return B.header_layouts(t("v_table_cells"))


_UNIT_LIST = ", ".join(f"'{u}'" for u in L.UNITS)
DUCK["v_votes"] = f"""
SELECT doc_id, page, table_no, arg_max(CASE WHEN codes > 0 THEN col END, codes * 1000 - col) FILTER (codes > 0) AS code_col, arg_max(col, units * 1000 - col) FILTER (units > 0) AS unit_col FROM (
  SELECT doc_id, page, table_no, col, count(*) FILTER (regexp_matches(c, '^[0-9]{{3}}-[0-9]{{3}}')) AS codes, count(*) FILTER (lower(c) IN ({_UNIT_LIST}) OR regexp_replace(lower(c), '\\.+$', '') IN ({_UNIT_LIST})) AS units
  FROM (SELECT doc_id, page, table_no, trim(unnest(cells)) AS c, generate_subscripts(cells, 1)::INT - 1 AS col FROM {{v_table_cells}} WHERE row_no < 20) GROUP BY ALL) GROUP BY ALL
""".replace("{{3}}", "{3}")
DUCK["v_bare"] = f"""
SELECT v.*, code_col - 3 AS pos_col, coalesce(has, FALSE) AS has FROM {{v_votes}} v LEFT JOIN (SELECT doc_id, page, table_no, bool_or(({S.pos('cells[code_col - 2]')}) IS NOT NULL) AS has FROM {{v_table_cells}} JOIN {{v_votes}} USING (doc_id, page, table_no) WHERE row_no < 15 AND code_col >= 3 GROUP BY ALL) USING (doc_id, page, table_no) WHERE code_col IS NOT NULL
"""


@query("agg_column_votes", "SELECT doc_id, page, table_no, code_col, unit_col FROM {v_votes}")
def agg_column_votes(t):
    return B.column_votes(t("v_table_cells"))


@query("tbl_headerless", "SELECT doc_id, page, table_no, CASE WHEN has THEN pos_col END AS pos, CASE WHEN code_col >= 2 THEN code_col - 2 END AS name, CASE WHEN code_col >= 1 THEN code_col - 1 END AS article, code_col AS code, unit_col AS unit, unit_col + 1 AS qty FROM {v_bare}")
def tbl_headerless(t):
    return B.headerless_layouts(t("v_table_cells"))


DUCK["v_layouts"] = """
WITH own AS (SELECT t.doc_id, t.page, t.table_no, h.header_row AS hr, CASE WHEN h.doc_id IS NOT NULL THEN h.pos WHEN b.doc_id IS NOT NULL AND b.has THEN b.pos_col END AS p, CASE WHEN h.doc_id IS NOT NULL THEN h.code ELSE b.code_col END AS c, h.doc_id IS NOT NULL OR b.doc_id IS NOT NULL AS known
  FROM (SELECT DISTINCT doc_id, page, table_no FROM {v_table_cells}) t LEFT JOIN {v_heads} h USING (doc_id, page, table_no) LEFT JOIN {v_bare} b USING (doc_id, page, table_no)),
carry AS (SELECT *, last_value(CASE WHEN known THEN struct_pack(p := p, c := c) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, table_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own)
SELECT doc_id, page, table_no, NOT known AS carried, CASE WHEN known THEN p ELSE before.p END AS pos, CASE WHEN known THEN c ELSE before.c END AS code, CASE WHEN known THEN coalesce(hr, -1) ELSE -1 END AS header_row FROM carry WHERE known OR before IS NOT NULL
"""


@query("win_header_carry", "SELECT doc_id, page, table_no, carried, pos, code FROM {v_layouts}")
def win_header_carry(t):
    return B.table_layouts(t("v_table_cells")).select("doc_id", "page", "table_no", "carried", "pos", "code")


def fields(t):
    if "v_fields" not in t._held:
        cells = t("v_table_cells")
        t._held["v_fields"] = B.row_fields(cells, B.table_layouts(cells), (*L.SKIP_KEYWORDS, "equipment"))
    return t._held["v_fields"]


def items(t):
    if "v_table_items" not in t._held:
        t._held["v_table_items"] = B.table_items(fields(t))
    return t._held["v_table_items"]


@query("tbl_numbering_row", "SELECT doc_id, page, table_no, row_no FROM {v_table_cells} JOIN {v_layouts} USING (doc_id, page, table_no) WHERE row_no > header_row AND NOT (row_no = header_row + 1 AND regexp_matches(cells[3], '^[0-9]{1,2}$') AND regexp_matches(cells[2], '^[0-9]{1,2}$') AND regexp_matches(cells[6], '^[0-9]{1,2}$'))")
def tbl_numbering_row(t):
    cells = t("v_table_cells")
    return B.data_rows(cells, B.table_layouts(cells)).select("doc_id", "page", "table_no", "row_no")


_T = "doc_id, page, table_no"
_REF_CELL = f"lower({S.strip('cells[3]')})"
_REF = f"CASE WHEN regexp_matches({_REF_CELL}, '^({'|'.join(L.STANDARD_PREFIXES)})') OR {S.any_in(_REF_CELL, L.STANDARD_PARTS)} THEN '' ELSE cells[3] END"
DUCK["v_walk_rows"] = f"""
WITH r AS (SELECT {_T}, row_no, cells, l.carried, l.pos IS NOT NULL AS has_pos FROM {{v_table_cells}} JOIN {{v_layouts}} l USING ({_T})
  WHERE row_no > header_row AND NOT (row_no = header_row + 1 AND regexp_matches(cells[3], '^[0-9]{{1,2}}$') AND regexp_matches(cells[2], '^[0-9]{{1,2}}$') AND regexp_matches(cells[6], '^[0-9]{{1,2}}$'))),
f AS (SELECT *, CASE WHEN has_pos THEN {S.pos('cells[1]')} END AS place, cells[2] AS name, {S.article_clean('cells[3]')} AS bare_article, {_REF} AS ref, {S.code('cells[4]', 'cells[5]')} AS code, {S.qty('cells[6]')} AS qty FROM r)
SELECT {_T}, row_no, carried, has_pos, place, has_pos AND cells[1] = '-' AS dash, name, cells[3] AS cell, bare_article, ref, {S.article_clean('ref')} AS article, code, cells[5] AS unit, cells[6] AS qty_cell, qty,
  regexp_matches(name, '^[0-9]+\\s*[/)]\\s') AS numbered, regexp_matches(name, '^[0-9]+\\.\\s*\\S') AND bare_article = '' AND code = '' AS section, {S.any_in("lower(concat(name, ' ', cells[3]))", (*L.SKIP_KEYWORDS, 'equipment'))} AS skip,
  row_number() OVER (PARTITION BY {_T} ORDER BY row_no) AS n FROM f
""".replace("{{1,2}}", "{1,2}")
_ITEM = "{'row_no': row_no, 'kind': kind, 'pos': p, 'name': NAME, 'article': article, 'code': code, 'unit': UNIT, 'qty': QTY, 'heading': HEAD}"
_GIVEN = "coalesce(nullif(unit, ''), 'шт.')"


def _new(**fields: str) -> str:
    text = _ITEM
    for k, v in fields.items():
        text = text.replace(k, v)
    return text


#: All tables walk one row a step, with the last item as their state.
DUCK["v_walk"] = f"""
WITH RECURSIVE w AS (
  SELECT DISTINCT {_T}, 0::BIGINT AS n, NULL::BIGINT AS row_no, carried, NULL::VARCHAR AS kind, 0 AS auto, '' AS title, 0 AS items, NULL::STRUCT(row_no BIGINT, kind VARCHAR, pos VARCHAR, name VARCHAR, article VARCHAR, code VARCHAR, unit VARCHAR, qty DOUBLE, heading BOOLEAN) AS i,
    NULL::STRUCT(row_no BIGINT, kind VARCHAR, pos VARCHAR, name VARCHAR, article VARCHAR, code VARCHAR, unit VARCHAR, qty DOUBLE, heading BOOLEAN) AS above FROM {{v_walk_rows}}
  UNION ALL
  SELECT {_T}, n, row_no, carried, CASE WHEN own AND filled AND NOT gives THEN 'skipped' ELSE kind END, auto + (gives AND panel AND code <> '')::INT,
    CASE WHEN kind = 'bare' AND length(name) > 8 AND cell = '' AND code = '' AND qty_cell = '' THEN name ELSE title END, items + gives::INT + (gives AND panel AND code <> '')::INT,
    CASE WHEN gives AND panel AND code <> '' THEN {_new(NAME='full_name', UNIT=_GIVEN, QTY='qty', HEAD='FALSE').replace("'kind': kind, 'pos': p", "'kind': 'panel_part', 'pos': concat('-', (auto + 1)::VARCHAR)")}
      WHEN gives THEN {_new(NAME="CASE WHEN panel THEN trim(concat(p, '  ', full_name)) ELSE full_name END", UNIT=f"CASE WHEN head THEN '' ELSE {_GIVEN} END", QTY='CASE WHEN head THEN 0::DOUBLE ELSE qty END', HEAD='head')}
      WHEN i IS NULL OR own THEN i
      ELSE {{'row_no': i.row_no, 'kind': i.kind, 'pos': i.pos, 'name': i.name, 'article': CASE WHEN i.article = '' AND kind <> 'bare' THEN bare_article ELSE i.article END, 'code': CASE WHEN i.code = '' THEN code ELSE i.code END,
        'unit': CASE WHEN kind = 'bare' THEN CASE WHEN unit <> '' AND qty_cell <> '' AND i.unit = 'шт.' THEN unit ELSE i.unit END WHEN unit <> '' THEN unit ELSE i.unit END,
        'qty': CASE WHEN qty_cell <> '' AND (kind <> 'bare' OR i.qty = 1) THEN qty ELSE i.qty END, 'heading': i.heading}} END,
    CASE WHEN gives AND panel AND code <> '' THEN {_new(NAME="trim(concat(p, '  ', full_name))", UNIT="''", QTY='0::DOUBLE', HEAD='TRUE')} END
  FROM (SELECT *, own AND filled AND NOT (skip AND code = '' AND NOT head) AS gives, CASE WHEN title <> '' AND length(name) <= 20 AND (ref <> '' OR code <> '') THEN trim(concat(trim(regexp_replace(title, '{L.NORM_SUFFIX}', '')), ' ', name)) ELSE name END AS full_name
    FROM (SELECT *, CASE kind WHEN 'auto' THEN auto::VARCHAR WHEN 'item' THEN place ELSE concat('-', auto::VARCHAR) END AS p, kind = 'item' AND NOT regexp_matches(place, '^[0-9]') AS panel, kind = 'section' OR (kind = 'item' AND NOT regexp_matches(place, '^[0-9]')) AS head,
      name <> '' OR cell <> '' OR code <> '' AS filled
      FROM (SELECT * REPLACE (auto + (own AND kind <> 'item')::INT AS auto) FROM (SELECT *, kind NOT IN ('bare', 'content_merge') AS own
        FROM (SELECT f.*, w.auto, w.title, w.items, w.i, CASE WHEN NOT has_pos THEN 'auto' WHEN place IS NOT NULL THEN 'item' WHEN dash THEN 'dash' WHEN numbered THEN 'numbered' WHEN section THEN 'section' WHEN f.name = '' OR (bare_article = '' AND f.code = '') THEN 'bare'
          WHEN w.i IS NULL THEN 'content_first' WHEN f.code <> '' AND w.i.code <> '' THEN 'content_complete' WHEN f.code <> '' AND w.i.heading THEN 'content_part' ELSE 'content_merge' END AS kind
          FROM w JOIN {{v_walk_rows}} f ON f.doc_id = w.doc_id AND f.page = w.page AND f.table_no = w.table_no AND f.n = w.n + 1)))))
) SELECT * FROM w WHERE n > 0
"""


@query("tbl_row_class", f"SELECT {_T}, row_no, kind FROM {{v_walk}}")
def tbl_row_class(t):
    return B.row_classes(fields(t))


@query("tbl_continuation_merge", f"""
WITH every AS (SELECT {_T}, items - 1 AS seq, carried, arg_max(i, n) AS i FROM {{v_walk}} WHERE i IS NOT NULL GROUP BY ALL UNION ALL SELECT {_T}, items - 2, carried, above FROM {{v_walk}} WHERE above IS NOT NULL)
SELECT {_T}, i.row_no AS row_no, seq::INT AS seq, i.kind AS kind, i.pos AS pos, i.name AS name_raw, i.article AS article_raw, i.code AS kaznisa_code_raw, i.unit AS unit, i.qty AS qty, i.heading AS is_heading, carried FROM every
""")
def tbl_continuation_merge(t):
    return items(t)


_ONLY = "{v_table_cells} WHERE row_no > 1"


@query("tbl_extract_cells", f"SELECT doc_id, page, table_no, row_no, cells[2] AS name, {S.code('cells[4]', 'cells[5]')} AS code, coalesce(nullif(cells[5], ''), 'шт.') AS unit FROM {_ONLY} AND (cells[2] <> '' OR cells[3] <> '' OR {S.code('cells[4]', 'cells[5]')} <> '')")
def tbl_extract_cells(t):
    return B.extracted(_plain(t)).select("doc_id", "page", "table_no", "row_no", "name", "code", "unit")


def _plain(t):
    """Fields by one fixed layout, as the views of single operators have it."""
    cells = t("v_table_cells")
    lay = cells.select("doc_id", "page", "table_no").distinct().select("*", F.lit(1).alias("header_row"), *[F.lit(k).alias(n) for k, n in enumerate(B.KEYS) if n not in ("article", "name", "code")], F.lit(1).alias("name"), F.lit(2).alias("article"), F.lit(3).alias("code"), F.lit(False).alias("carried"))
    lay = lay.select("doc_id", "page", "table_no", "header_row", F.lit(0).alias("pos"), "name", "article", "code", F.lit(4).alias("unit"), F.lit(5).alias("qty"), "carried")
    return B.row_fields(cells, lay, (*L.SKIP_KEYWORDS, "equipment"))


@query("tbl_panel_split", f"""
WITH p AS (SELECT doc_id, page, table_no, row_no, {S.pos('cells[1]')} AS pos, cells[2] AS name, {S.code('cells[4]', 'cells[5]')} AS code, cells[5] AS unit, {S.qty('cells[6]')} AS qty FROM {_ONLY})
SELECT doc_id, page, table_no, row_no, code, concat(pos, '  ', name) AS name_raw, '' AS unit, 0.0::DOUBLE AS qty, TRUE AS is_heading FROM p WHERE regexp_matches(pos, '^[^0-9-]')
UNION ALL SELECT doc_id, page, table_no, row_no, code, name, coalesce(nullif(unit, ''), 'шт.'), qty, FALSE FROM p WHERE regexp_matches(pos, '^[^0-9-]') AND code <> ''
""")
def tbl_panel_split(t):
    return B.panel_rows(_plain(t))


@query("win_auto_pos", f"SELECT doc_id, page, table_no, row_no, coalesce(pos, concat('-', n::VARCHAR)) AS pos FROM (SELECT *, sum(CASE WHEN pos IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, table_no ORDER BY row_no)::INT AS n FROM (SELECT doc_id, page, table_no, row_no, {S.pos('cells[1]')} AS pos FROM {_ONLY}))")
def win_auto_pos(t):
    return B.auto_positions(_plain(t)).select("doc_id", "page", "table_no", "row_no", "pos")


@query("win_section_carry", f"""
WITH f AS (SELECT doc_id, page, table_no, row_no, cells[2] AS name, {S.pos('cells[1]')} AS pos, cells[1] = '-' AS dash, cells[3] AS raw, {S.code('cells[4]', 'cells[5]')} AS code, cells[6] AS q FROM {_ONLY}),
g AS (SELECT *, last_value(CASE WHEN length(name) > 8 AND raw = '' AND code = '' AND q = '' AND pos IS NULL AND NOT dash AND NOT regexp_matches(name, '^[0-9]+\\s*[/)]\\s') AND NOT regexp_matches(name, '^[0-9]+\\.\\s*\\S') THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id, page, table_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM f)
SELECT doc_id, page, table_no, row_no, CASE WHEN length(name) <= 20 AND ((raw <> '' AND NOT regexp_matches(lower(raw), '^гост')) OR code <> '') AND title IS NOT NULL THEN concat(title, ' ', name) ELSE name END AS full_name FROM g
""")
def win_section_carry(t):
    return B.carried_sections(_plain(t)).select("doc_id", "page", "table_no", "row_no", "full_name")


@query("flt_skip_keywords", f"SELECT doc_id, page, table_no, row_no FROM {_ONLY} AND NOT ({S.any_in('lower(concat(cells[2], chr(32), cells[3]))', (*L.SKIP_KEYWORDS, 'equipment'))} AND {S.code('cells[4]', 'cells[5]')} = '')")
def flt_skip_keywords(t):
    return _plain(t).where(~(C("skip") & (C("code") == ""))).select("doc_id", "page", "table_no", "row_no")


#: The lines of specifications as items of two tables a document; some have a carried layout, some no text.
_BLANK = "CASE WHEN doc_id % 7 = 0 AND qty > 5 THEN '' ELSE {c} END AS {c}"
_TABLE_ITEMS = f"""SELECT doc_id, 1 AS page, CAST(seq % 2 AS BIGINT) AS table_no, item_id AS seq, pos, {', '.join(_BLANK.format(c=c) for c in ('name_raw', 'article_raw', 'kaznisa_code_raw'))},
  CASE WHEN is_heading THEN 0E0 ELSE qty END AS qty, is_heading, doc_id % 3 <> 0 AS carried FROM {{v_spec_items}}"""
_NO_TEXT = " AND ".join(f"coalesce({c}, '') = ''" for c in ("name_raw", "article_raw", "kaznisa_code_raw"))


@query("agg_quality_gate", f"""
WITH i AS ({_TABLE_ITEMS}), bad AS (SELECT doc_id, table_no FROM i WHERE carried GROUP BY 1, 2 HAVING count(*) FILTER (qty > 45) > count(*) * 0.3::DOUBLE OR count(*) FILTER ({_NO_TEXT}) > count(*) * 0.8::DOUBLE)
SELECT doc_id, table_no, seq, carried FROM i ANTI JOIN bad USING (doc_id, table_no)
""")
def agg_quality_gate(t):
    return B.quality_gate(t.sql(_TABLE_ITEMS), huge=45.0).select("doc_id", "table_no", "seq", "carried")


@query("win_renumber", f"""
SELECT doc_id, table_no, seq, CASE WHEN is_heading THEN pos ELSE (count(*) FILTER (NOT is_heading) OVER (PARTITION BY doc_id ORDER BY table_no, seq))::VARCHAR END AS pos, is_heading FROM ({_TABLE_ITEMS})
""")
def win_renumber(t):
    return B.renumbered(t.sql(_TABLE_ITEMS)).select("doc_id", "table_no", "seq", "pos", "is_heading")


def _lined(t):
    return t("v_word_boxes").withColumn("line", F.floor(C("top") / 40).cast("int"))


@query("win_cell_split", """
WITH b AS (SELECT *, top // 40 AS line FROM {v_word_boxes}),
e AS (SELECT *, CASE WHEN "left" - max("left" + width) OVER (PARTITION BY doc, page, line ORDER BY "left", text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 22 THEN 1 ELSE 0 END AS n FROM b),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc, page, line ORDER BY "left", text ROWS UNBOUNDED PRECEDING)::BIGINT AS cell FROM e)
SELECT doc, page, line, cell, string_agg(text, ' ' ORDER BY "left", text) AS text FROM c GROUP BY 1, 2, 3, 4
""")
def win_cell_split(t):
    return B.split_cells(_lined(t))


@query("win_line_group", """
WITH w AS (SELECT doc, page, list({'anchor': top::BIGINT, 'all': [top::BIGINT]} ORDER BY top, "left") AS words FROM {v_word_boxes} GROUP BY 1, 2),
g AS (SELECT doc, page, list_reduce(words, lambda a, x: CASE WHEN x.anchor - a.anchor > 15 THEN {'anchor': x.anchor, 'all': list_append(a.all, x.anchor)} ELSE {'anchor': a.anchor, 'all': list_append(a.all, a.anchor)} END) AS r FROM w),
o AS (SELECT doc, page, unnest(r.all) AS top FROM g)
SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY top) - 1)::INT AS line, count(*) AS n_words, top::INT AS top FROM o GROUP BY doc, page, top
""")
def win_line_group(t):
    return B.line_groups(t("v_word_boxes")).groupBy("doc", "page", "line").agg(F.count("*").alias("n_words"), F.min("top").alias("top"))


@query("enr_batch", """
WITH n AS (SELECT doc_id, is_heading, name_raw, article_raw, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) - 1 AS k FROM {v_spec_items})
SELECT doc_id, k // 15 AS batch, coalesce(string_agg(CASE WHEN NOT is_heading THEN concat((k % 15)::VARCHAR, '. ', CASE WHEN substring(trim(article_raw), 1, 60) <> '' THEN concat('[', substring(trim(article_raw), 1, 60), '] ') ELSE '' END, substring(trim(name_raw), 1, 250)) END, chr(10) ORDER BY k % 15), '') AS prompt FROM n GROUP BY 1, 2
""")
def enr_batch(t):
    return B.prompt_batches(t("v_spec_items"))


@query("enr_response_merge", "SELECT CAST(floor(event_id / 15) AS BIGINT) AS batch, (event_id % 15)::INT AS idx, concat('k ', json_extract_string(props, '$.k')) AS params FROM {events} WHERE json_extract_string(props, '$.k') <> '0'")
def enr_response_merge(t):
    from matchloom.functions.text import params_text

    return B.merged_replies(t("v_events_params")).select("batch", "idx", params_text(C("params")).alias("params"))
