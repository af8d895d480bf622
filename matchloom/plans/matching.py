"""Queries of the matching family and the views that come out of it."""

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X
from matchloom.operators import catalog as K
from matchloom.operators import matching as M
from matchloom.operators import review as R
from matchloom.operators.stored import stored
from matchloom.plans import sql as S
from matchloom.plans.registry import query
from matchloom.plans.views import DUCK

C = F.col

DUCK["v_keyed"] = f"SELECT *, {S.nocyr('norm_art')} AS norm_nocyr FROM (SELECT *, {S.norm('article')} AS norm_art, {S.norm('name')} AS norm_name, {S.norm('kaznisa_code')} AS norm_code FROM {{v_catalog}} WHERE is_active)"
_SUBITEM = f"regexp_replace({S.strip('name_raw')}, '^[0-9]+\\s*/\\s*', '')"
DUCK["v_queries"] = f"SELECT *, {S.brand('q')} AS q_brandless, {S.nocyr('q')} AS q_nocyr FROM (SELECT *, {S.norm('article_raw')} AS q, {S.norm(_SUBITEM)} AS q_name, {S.norm('kaznisa_code_raw')} AS q_code FROM {{v_spec_items}} WHERE NOT is_heading)"


def _equal(key: str, product_key: str, score: int, method: str, where: str = "TRUE") -> str:
    return f"SELECT item_id, product_id, {score}::DOUBLE AS score, '{method}' AS method FROM (SELECT item_id, {key} AS k FROM {{v_queries}} WHERE {where}) JOIN (SELECT {product_key} AS k, min(id) AS product_id FROM {{v_keyed}} WHERE {product_key} <> '' GROUP BY 1) USING (k)"


_CODE = "length(regexp_replace(q_code, '[^0-9]', '', 'g')) = 10"
_NAME = "length(q_name) >= 20"
_ART, _BARE, _COD, _NAM = _equal("q", "norm_art", 100, "exact"), _equal("q_brandless", "norm_art", 100, "exact"), _equal("q_code", "norm_code", 100, "code_exact", _CODE), _equal("q_name", "norm_name", 99, "name_exact", _NAME)
DUCK["v_equal"] = f"""
SELECT item_id, coalesce(a.product_id, b.product_id, c.product_id, n.product_id) AS product_id, coalesce(a.score, b.score, c.score, n.score) AS score, coalesce(a.method, b.method, c.method, n.method) AS method
FROM {{v_queries}} LEFT JOIN ({_ART}) a USING (item_id) LEFT JOIN ({_BARE}) b USING (item_id) LEFT JOIN ({_COD}) c USING (item_id) LEFT JOIN ({_NAM}) n USING (item_id)
WHERE coalesce(a.score, b.score, c.score, n.score) IS NOT NULL
"""
DUCK["v_matches"] = """
SELECT i.* EXCLUDE (qty), CASE WHEN is_heading THEN 0.0::DOUBLE ELSE qty END AS qty,
  CASE WHEN is_heading THEN 'heading' WHEN score IS NULL THEN 'not_found' WHEN score >= 100 THEN 'exact' ELSE 'fuzzy' END AS status, method AS match_method, score, product_id
FROM {v_spec_items} i LEFT JOIN {v_equal} USING (item_id)
"""


def _ready(t):
    return M.prepared(t("v_spec_items")), K.keyed(K.active(t("v_catalog")))


def _lines(t):
    """What matching takes of the lines, written once."""
    if "v_lines" not in t._held:
        t._held["v_lines"] = stored(t("v_spec_items").select("item_id", "article_raw", "name_raw", "kaznisa_code_raw", "is_heading", "qty"), "lines")
    return t._held["v_lines"]


def _by_cells(t, stage):
    """Candidates of a stage that reads its lines and products several times."""
    products = stored(K.keyed(K.active(t("v_catalog"))).select("id", "norm_art", "norm_name", "norm_nocyr"), "products")
    return M.by_cells(_lines(t), lambda alike: stage(stored(M.prepared(alike), "prepared"), products))


def matches(t):
    """The view of statuses over the equality stages; the lines, which candidates and statuses both read, are written once."""
    if "v_matches" not in t._held:
        items, cat = stored(t("v_spec_items"), "lines"), t("v_catalog")
        t._held["v_matches"] = M.statuses(items, M.equality_candidates(items, cat), cat)
    return t._held["v_matches"]


@query("mat_article_exact", _ART)
def mat_article_exact(t):
    return M.article_exact(*_ready(t))


@query("mat_article_debrand", _BARE)
def mat_article_debrand(t):
    return M.article_debrand(*_ready(t))


@query("mat_code_exact", _COD)
def mat_code_exact(t):
    return M.code_exact(*_ready(t))


@query("mat_code_digits", f"SELECT item_id, product_id, 100::DOUBLE AS score, 'code_exact_preai' AS method FROM (SELECT item_id, {S.digits('kaznisa_code_raw')} AS k FROM {{v_queries}}) JOIN (SELECT {S.digits('kaznisa_code')} AS k, min(id) AS product_id FROM {{v_keyed}} GROUP BY 1) USING (k) WHERE length(k) = 10")
def mat_code_digits(t):
    return M.code_digits(*_ready(t))


def _contains(key: str, product_key: str, score: int, method: str, also: str | None = None, where: str = "TRUE") -> str:
    """All pairs of distinct texts; the reference for the blocked join."""
    keys = f"SELECT item_id, {key} AS k FROM {{v_queries}} WHERE {where}" + (f" UNION SELECT item_id, {also} FROM {{v_queries}} WHERE {where}" if also else "")
    return f"""
    SELECT DISTINCT item_id, id AS product_id, {score}::DOUBLE AS score, '{method}' AS method FROM ({keys}) i JOIN (
      SELECT k, p FROM (SELECT DISTINCT k FROM ({keys}) WHERE k <> '') CROSS JOIN (SELECT DISTINCT {product_key} AS p FROM {{v_keyed}} WHERE {product_key} <> '')
      WHERE (contains(p, k) OR contains(k, p)) AND least(length(k), length(p)) / greatest(length(k), length(p)) >= 0.7) USING (k) JOIN {{v_keyed}} ON {product_key} = p
    """


@query("mat_article_contains", _contains("q", "norm_art", 95, "contains", "q_brandless"))
def mat_article_contains(t):
    return _by_cells(t, M.article_contains)


_NOCYR, _NOCYR_BARE = _equal("q_nocyr", "norm_nocyr", 100, "exact_nocyr"), _equal(S.brand("q_nocyr"), "norm_nocyr", 100, "exact_nocyr")


@query("mat_nocyr_exact", f"WITH whole AS ({_NOCYR}) SELECT * FROM whole UNION ALL SELECT * FROM ({_NOCYR_BARE}) WHERE item_id NOT IN (SELECT item_id FROM whole)")
def mat_nocyr_exact(t):
    return _by_cells(t, M.nocyr_exact)


@query("mat_nocyr_contains", _contains("q_nocyr", "norm_nocyr", 95, "contains_nocyr"))
def mat_nocyr_contains(t):
    return _by_cells(t, M.nocyr_contains)


@query("mat_name_exact", _NAM)
def mat_name_exact(t):
    return M.name_exact(*_ready(t))


def _few(t):
    """Lines that no equality stage finds, written once, and their products."""
    rows, products = M.with_equal(_lines(t), t("v_catalog"))
    return stored(rows.where("method is null and name_product_id is null").drop("product_id", "score", "method"), "lines-left"), products


DUCK["v_few"] = "SELECT * FROM {v_queries} WHERE item_id NOT IN (SELECT item_id FROM {v_equal})"


def _bits(text: str, of: str) -> str:
    """Distinct texts of ``of`` with the places of their characters as bits, for common subsequences (up to 120 characters)."""
    return f"""SELECT t, k, n, cs, ds, list_transform(ds, lambda d: list_sum(list_transform(list_filter(range(n), lambda i: cs[i + 1] = d), lambda i: 1::HUGEINT << i::INT))::HUGEINT) AS ms, (1::HUGEINT << n::INT) - 1 AS whole
      FROM (SELECT t, k, length(t) AS n, string_split(t, '') AS cs, list_distinct(string_split(t, '')) AS ds FROM (SELECT {text} AS t, k FROM (SELECT DISTINCT {of}) WHERE k <> '') WHERE t <> '')"""


_SORTED = "array_to_string(list_sort(list_filter(string_split(k, ' '), lambda w: w <> '')), ' ')"
_LCS = "list_reduce(list_prepend({a}.whole, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {a}.whole)"


def _best(score: str, key: str, product_key: str, limit: int, method: str, where: str, items: str, also: str = "TRUE") -> str:
    """The products of each text's pairs (q, p, score), the first ``limit`` a text, by line."""
    return f"""best AS (SELECT q, product_id, score FROM (SELECT q, id AS product_id, score FROM ({score}) JOIN {{v_keyed}} ON {product_key} = p) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, product_id) <= {limit})
    SELECT f.item_id, product_id, round(score, 6) AS score, '{method}' AS method FROM {items} f JOIN best ON best.q = f.{key} AND {where} JOIN {{v_keyed}} ON id = product_id WHERE {also}"""


def _token_sort(key: str, product_key: str, cutoff: int, method: str, where: str = "TRUE", items: str = "{v_few}") -> str:
    """Every text against every other by sorted tokens."""
    masks = "list_transform(b.cs, lambda c: coalesce(a.ms[list_position(a.ds, c)], 0::HUGEINT))"
    return f"""
    WITH asked AS ({_bits(_SORTED, f"{key} AS k FROM {items} WHERE {where}")}), names AS ({_bits(_SORTED, f"{product_key} AS k FROM {{v_keyed}}")}),
    pairs AS (SELECT a.k AS q, b.k AS p, a.n + b.n AS total, a.n - bit_count({_LCS.format(a="a", masks=masks)}) AS lcs FROM asked a, names b WHERE 200 * least(a.n, b.n) >= {cutoff} * (a.n + b.n)),
    {_best(f"SELECT q, p, 200.0::DOUBLE * lcs / total AS score FROM pairs WHERE 200 * lcs >= {cutoff} * total", key, product_key, 10, method, where, items)}
    """


def _partial(key: str, product_key: str, cutoff: int, limit: int, method: str, where: str = "TRUE", items: str = "{v_few}", also: str = "TRUE") -> str:
    """Every window of the longer text against the shorter one, where the whole text has enough of it."""
    masks = "list_transform(l.cs, lambda c: coalesce(s.ms[list_position(s.ds, c)], 0::HUGEINT))"
    side = lambda s, l, cmp: f"SELECT a.k AS q, b.k AS p, {s}.n AS m, {l}.n AS n, {s}.whole AS whole, {masks.replace('s.', s + '.').replace('l.', l + '.')} AS ms FROM asked a, names b WHERE a.n {cmp} b.n"  # noqa: E731,E741
    return f"""
    WITH asked AS ({_bits("k", f"{key} AS k FROM {items} WHERE {where}")}), names AS ({_bits("k", f"{product_key} AS k FROM {{v_keyed}}")}),
    pairs AS ({side("a", "b", "<=")} UNION ALL {side("b", "a", ">")}),
    near AS (SELECT * FROM (SELECT *, m - bit_count({_LCS.format(a="x", masks="ms")}) AS lcs FROM pairs x) WHERE 200 * lcs >= {cutoff} * (m + lcs)),
    wins AS (SELECT q, p, m, whole, ms[greatest(i, 0) + 1 : least(i + m, n)] AS ms FROM (SELECT *, unnest(range(1 - m, n)) AS i FROM near)),
    {_best(f"SELECT q, p, max(200.0::DOUBLE * (m - bit_count({_LCS.format(a='w', masks='ms')})) / (m + len(ms))) AS score FROM wins w GROUP BY q, p HAVING score >= {cutoff}", key, product_key, limit, method, where, items, also)}
    """


def _scored(found):
    return found.withColumn("score", F.round("score", 6))


@query("mat_name_contains", _contains("q_name", "norm_name", 93, "name_contains", where="length(q_name) >= 20 AND item_id NOT IN (SELECT item_id FROM {v_equal})"))
def mat_name_contains(t):
    items, products = _few(t)
    return M.name_contains(items, products)


@query("mat_article_fuzzy", _token_sort("q", "norm_art", 80, "fuzzy_article"))
def mat_article_fuzzy(t):
    return _scored(M.article_fuzzy(*_few(t)))


@query("mat_nocyr_fuzzy", _token_sort("q_nocyr", "norm_nocyr", 80, "fuzzy_nocyr"))
def mat_nocyr_fuzzy(t):
    return _scored(M.nocyr_fuzzy(*_few(t)))


def _named_articles(t):
    """Lines whose article cell holds a part of a name, as a mislabelled column gives it."""
    items, products = _few(t)
    words = F.split("q_name", " ")
    cut = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 3, F.lit(1))), " ")
    return items.withColumn("q", F.when((C("item_id") % 3 == 0) & (C("q_name") != ""), F.concat(cut, F.lit("X"))).otherwise(C("q"))), products


_CUT = "array_to_string(list_slice(string_split(q_name, ' '), 2, 1 + greatest(len(string_split(q_name, ' ')) - 3, 1)), ' ')"
DUCK["v_named_articles"] = f"SELECT * REPLACE (CASE WHEN item_id % 3 = 0 AND q_name <> '' THEN {_CUT} || 'X' ELSE q END AS q) FROM {{v_few}}"


@query("mat_name_from_article", _partial("q", "norm_name", 90, 5, "fuzzy_name_from_article", items="{v_named_articles}"))
def mat_name_from_article(t):
    return _scored(M.name_from_article(*_named_articles(t)))


@query("mat_name_fuzzy", _token_sort("q_name", "norm_name", 93, "name_fuzzy", "length(q_name) >= 20"))
def mat_name_fuzzy(t):
    return _scored(M.name_fuzzy(*_few(t)))


_SHARE = "len(list_intersect(string_split(f.q_name, ' '), string_split(norm_name, ' '))) / len(list_distinct(string_split(f.q_name, ' '))) >= 0.4"


@query("mat_name_partial", _partial("q_name", "norm_name", 96, 10, "name_partial", "length(q_name) >= 20", also=_SHARE))
def mat_name_partial(t):
    return _scored(M.name_partial(*_few(t)))


DUCK["v_contains"] = _contains("q", "norm_art", 95, "contains", "q_brandless", "item_id NOT IN (SELECT item_id FROM ({v_equal_first}))".replace("({v_equal_first})", "v_equal WHERE method <> 'name_exact'"))
DUCK["v_cascade"] = """
SELECT item_id, product_id, score, method, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY product_id) AS rank FROM (
    SELECT * FROM {v_equal} WHERE method <> 'name_exact' UNION ALL SELECT * FROM {v_contains}
    UNION ALL SELECT * FROM {v_equal} WHERE method = 'name_exact' AND item_id NOT IN (SELECT item_id FROM {v_contains})))
WHERE rank <= CASE WHEN score >= 100 THEN 1 ELSE 5 END
"""


def _left(name: str, before: str, *stages: str) -> None:
    """View ``name``: the lines of ``before`` without a candidate of ``stages``."""
    DUCK[name] = f"SELECT * FROM {{{before}}} WHERE item_id NOT IN ({' UNION ALL '.join(f'SELECT item_id FROM {{{s}}}' for s in stages)})"


def _stage(name: str, sql: str, *before: str) -> None:
    """View ``name``: candidates that are in none of the stages before."""
    seen = " UNION ALL ".join(f"SELECT item_id, product_id FROM {{{b}}}" for b in before)
    DUCK[name] = f"SELECT item_id, product_id, score, method FROM ({sql})" + (f" ANTI JOIN ({seen}) USING (item_id, product_id)" if before else "")


def _of(view: str) -> str:
    return f"item_id IN (SELECT item_id FROM {{{view}}})"


_stage("v_stage_0", "SELECT * FROM {v_equal} WHERE method <> 'name_exact'")
_left("v_stage_lines1", "v_queries", "v_stage_0")
_stage("v_stage_1", _contains("q", "norm_art", 95, "contains", where=_of("v_stage_lines1")))
_stage("v_stage_2", _token_sort("q", "norm_art", 80, "fuzzy_article", items="{v_stage_lines1}"), "v_stage_1")
_stage("v_stage_3", _contains("q_brandless", "norm_art", 95, "contains", where=_of("v_stage_lines1")), "v_stage_1", "v_stage_2")
_stage("v_stage_4", _token_sort("q_brandless", "norm_art", 80, "fuzzy_article", items="{v_stage_lines1}"), "v_stage_1", "v_stage_2", "v_stage_3")
_stage("v_stage_5", _partial("q", "norm_name", 90, 5, "fuzzy_name_from_article", items="{v_stage_lines1}"), "v_stage_1", "v_stage_2", "v_stage_3", "v_stage_4")
_left("v_stage_lines2", "v_stage_lines1", *[f"v_stage_{k}" for k in range(1, 6)])
_stage("v_stage_6", f"WITH whole AS ({_NOCYR}), both_ AS (SELECT * FROM whole UNION ALL SELECT * FROM ({_NOCYR_BARE}) WHERE item_id NOT IN (SELECT item_id FROM whole)) SELECT * FROM both_ WHERE {_of('v_stage_lines2')}")
_left("v_stage_lines3", "v_stage_lines2", "v_stage_6")
_stage("v_stage_7", _contains("q_nocyr", "norm_nocyr", 95, "contains_nocyr", where=_of("v_stage_lines3")))
_stage("v_stage_8", _token_sort("q_nocyr", "norm_nocyr", 80, "fuzzy_nocyr", items="{v_stage_lines3}"), "v_stage_7")
_left("v_stage_lines4", "v_stage_lines3", "v_stage_7", "v_stage_8")
_stage("v_stage_9", f"SELECT * FROM ({_NAM}) WHERE {_of('v_stage_lines4')}")
_left("v_stage_lines5", "v_stage_lines4", "v_stage_9")
_LONG = f"{_NAME} AND {_of('v_stage_lines5')}"
_stage("v_stage_seen", _contains("q_name", "norm_name", 93, "name_contains", where=_LONG).replace(">= 0.7", ">= 0"))
_stage("v_stage_10", _contains("q_name", "norm_name", 93, "name_contains", where=_LONG))
_stage("v_stage_11", _token_sort("q_name", "norm_name", 93, "name_fuzzy", _NAME, "{v_stage_lines5}"), "v_stage_seen")
_stage("v_stage_12", _partial("q_name", "norm_name", 96, 10, "name_partial", _NAME, "{v_stage_lines5}", _SHARE), "v_stage_seen", "v_stage_11")
DUCK["v_stage_all"] = f"""
SELECT item_id, product_id, score, method, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, step, product_id)::INT AS rank, max(score) OVER (PARTITION BY item_id) AS top
  FROM ({' UNION ALL '.join(f'SELECT *, {k} AS step FROM {{v_stage_{k}}}' for k in range(13))}))
WHERE rank <= CASE WHEN top >= 100 THEN 1 ELSE 5 END
"""


def _whole(t):
    """Candidates of all stages."""
    return M.cascade(_lines(t), t("v_catalog"), nocyr=True)


def _cascade(t):
    """Equality and containment stages of articles, then equal names."""
    return M.cascade(_lines(t), t("v_catalog"), similar=False, names=False)


@query("mat_cascade", "SELECT * FROM {v_stage_all}")
def mat_cascade(t):
    """All stages of the cascade over all lines."""
    return _scored(_whole(t))


@query("mat_cascade_equal", "SELECT item_id, product_id, score, method, rank::INT AS rank FROM {v_cascade}")
def mat_cascade_equal(t):
    """The stages that SQL can express."""
    return _cascade(t)


def _products(candidates):
    return candidates.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"].cast("string")), ",").alias("products"), F.count("*").alias("n"))


@query("mat_rank", "SELECT item_id, string_agg(product_id::VARCHAR, ',' ORDER BY rank) AS products, count(*) AS n FROM {v_stage_all} GROUP BY item_id")
def mat_rank(t):
    return _products(_whole(t))


@query("win_candidate_rank", "SELECT item_id, product_id, rank FROM {v_stage_all}")
def win_candidate_rank(t):
    return _whole(t).select("item_id", "product_id", "rank")


@query("mat_rank_equal", "SELECT item_id, string_agg(product_id::VARCHAR, ',' ORDER BY rank) AS products, count(*) AS n FROM {v_cascade} GROUP BY item_id")
def mat_rank_equal(t):
    """Of the stages that SQL can express; so are the other two."""
    return _products(_cascade(t))


@query("win_candidate_rank_equal", "SELECT item_id, product_id, rank::INT AS rank FROM {v_cascade}")
def win_candidate_rank_equal(t):
    return _cascade(t).select("item_id", "product_id", "rank")


@query("mat_segment_filter", "SELECT e.item_id, e.product_id, e.score, e.method FROM {v_equal} e JOIN {v_catalog} c ON c.id = e.product_id WHERE c.segment IN ('ss', 'sil')")
def mat_segment_filter(t):
    return M.segment_filter(M.equality_candidates(t("v_spec_items"), t("v_catalog")), t("v_catalog"), ["ss", "sil"])


STATUS_SQL = """
WITH per AS (SELECT s.*, segment, max(score) OVER (PARTITION BY item_id) AS top FROM {v_stage_all} s JOIN {v_catalog} c ON c.id = s.product_id),
best AS (SELECT item_id, max(top) AS top, count(*) FILTER (top - score <= 5) AS n, count(DISTINCT segment) FILTER (top - score <= 5 AND score >= 100) AS segments, arg_min(method, rank) AS method, arg_min(product_id, rank) AS product_id FROM per GROUP BY 1)
SELECT i.item_id, CASE WHEN is_heading THEN 'heading' WHEN top IS NULL THEN 'not_found' WHEN top >= 100 THEN CASE WHEN segments > 1 THEN 'multiple' ELSE 'exact' END WHEN n > 1 THEN 'multiple' ELSE 'fuzzy' END AS status,
  method AS match_method, product_id, CASE WHEN is_heading THEN 0.0::DOUBLE ELSE qty END AS qty
FROM {v_spec_items} i LEFT JOIN best USING (item_id)
"""


@query("mat_status", STATUS_SQL)
def mat_status(t):
    return M.statuses(_lines(t), _whole(t), t("v_catalog")).select("item_id", "status", "match_method", "product_id", "qty")


@query("mat_status_equal", """
WITH best AS (SELECT item_id, max(score) AS top FROM {v_cascade} GROUP BY 1),
near AS (SELECT item_id, any_value(top) AS top, count(*) FILTER (top - score <= 5) AS n FROM {v_cascade} JOIN best USING (item_id) GROUP BY 1)
SELECT i.item_id, CASE WHEN is_heading THEN 'heading' WHEN top IS NULL THEN 'not_found' WHEN top >= 100 THEN 'exact' WHEN n > 1 THEN 'multiple' ELSE 'fuzzy' END AS status, CASE WHEN is_heading THEN 0.0::DOUBLE ELSE qty END AS qty
FROM {v_spec_items} i LEFT JOIN near USING (item_id)
""")
def mat_status_equal(t):
    return M.statuses(_lines(t), _cascade(t), t("v_catalog")).select("item_id", "status", "qty")


@query("mat_heading_pass", "SELECT item_id, pos, name_raw, 0.0::DOUBLE AS qty, 'heading' AS status, NULL::VARCHAR AS match_method FROM {v_spec_items} WHERE is_heading")
def mat_heading_pass(t):
    return matches(t).where("status = 'heading'").select("item_id", "pos", "name_raw", "qty", "status", "match_method")


@query("mat_dup_keys", f"SELECT key, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n FROM (SELECT {S.norm('name')} AS key, id FROM {{v_catalog}}) WHERE key <> '' GROUP BY 1")
def mat_dup_keys(t):
    return K.duplicate_keys(t("v_catalog"), "norm_name").select("key", F.array_join(C("ids").cast("array<string>"), ",").alias("ids"), "n")


@query("mat_cross_segment_dup", f"SELECT k AS norm_art, count(DISTINCT segment) AS n_segments FROM (SELECT {S.norm('name')} AS k, segment FROM {{v_catalog}}) GROUP BY 1 HAVING count(DISTINCT segment) > 1")
def mat_cross_segment_dup(t):
    return K.cross_segment_duplicates(t("v_catalog").withColumn("article", C("name")))


@query("mat_rematch_apply", """
SELECT m.item_id, CASE WHEN n.item_id IS NULL THEN m.status ELSE 'ai_match' END AS status, CASE WHEN n.item_id IS NULL THEN m.match_method ELSE 'ai_vector' END AS match_method, CASE WHEN n.item_id IS NULL THEN m.product_id ELSE m.item_id END AS product_id
FROM {v_matches} m LEFT JOIN (SELECT item_id FROM {v_matches} WHERE status IN ('multiple', 'fuzzy', 'not_found') AND item_id % 3 = 0) n USING (item_id)
""")
def mat_rematch_apply(t):
    matched = stored(matches(t).select("item_id", "status", "match_method", "product_id"), "matched")
    new = R.rematch_targets(matched).where("item_id % 3 = 0").select("item_id", F.lit("ai_match").alias("status"), F.lit("ai_vector").alias("match_method"), C("item_id").alias("product_id"))
    return R.apply_rematch(matched, new).select("item_id", "status", "match_method", "product_id")


@query("mat_reset", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'not_found' ELSE status END AS status, CASE WHEN item_id % 5 <> 0 THEN match_method END AS match_method, CASE WHEN item_id % 5 <> 0 THEN product_id END AS product_id FROM {v_matches}")
def mat_reset(t):
    return R.reset(matches(t), C("item_id") % 5 == 0).select("item_id", "status", "match_method", "product_id")


@query("mat_apply_choice", """
SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'exact' ELSE status END AS status,
  CASE WHEN item_id % 7 = 0 THEN 1 + item_id % 50 ELSE product_id END AS product_id,
  CASE WHEN item_id % 7 = 1 THEN 'confirmed' ELSE match_method END AS match_method, item_id % 7 IN (0, 1) AS corrected
FROM {v_matches}
""")
def mat_apply_choice(t):
    choices = t("v_spec_items").where("item_id % 7 in (0, 1)").select("item_id", F.when(C("item_id") % 7 == 0, 1 + C("item_id") % 50).alias("chosen_id"), (C("item_id") % 7 == 1).alias("confirm_only"))
    return R.apply_choices(matches(t), choices).select("item_id", "status", "product_id", "match_method", "corrected")


@query("mat_search_merge", """
WITH db AS (SELECT id, 0 AS part FROM {v_catalog} WHERE is_active AND contains(lower(article), '-7-1')),
sem AS (SELECT id, 1 AS part FROM {v_vectors} WHERE id % 20 = 0 AND id NOT IN (SELECT id FROM db))
SELECT id, part FROM db UNION ALL SELECT id, part FROM sem WHERE (SELECT count(*) FROM db) < 5
""")
def mat_search_merge(t):
    db = K.active(t("v_catalog")).where(F.contains(F.lower("article"), F.lit("-7-1"))).select("id")
    return R.merge_search(db, t("v_vectors").where("id % 20 = 0").select("id"))


@query("mat_lookup_macro", """
WITH q AS (SELECT DISTINCT lower(name) AS w FROM {v_catalog} WHERE id % 20 = 0 UNION SELECT lower(substring(article, 1, length(article) - 1)) FROM {v_catalog} WHERE id % 20 = 1),
eq AS (SELECT w, min(num) AS num FROM q JOIN {v_catalog} ON lower(article) = w OR lower(name) = w GROUP BY 1),
part AS (SELECT w, num FROM q JOIN {v_catalog} ON contains(lower(article), w) OR contains(lower(name), w) WHERE w NOT IN (SELECT w FROM eq))
SELECT w AS query, num, TRUE AS whole FROM eq UNION ALL SELECT w, num, FALSE FROM part
""")
def mat_lookup_macro(t):
    cat = t("v_catalog")
    queries = cat.where("id % 20 = 0").select(F.lower("name").alias("query")).union(cat.where("id % 20 = 1").select(F.lower(F.expr("substring(article, 1, length(article) - 1)")))).distinct()
    return R.workbook_lookup(queries, cat)


@query("mat_macro_vlookup", "SELECT item_id, kaznisa, rrts FROM {v_spec_items} LEFT JOIN (SELECT article AS article_raw, min_by(kaznisa, num) FILTER (TRUE) AS kaznisa, min_by(rrts, num) AS rrts FROM {v_catalog} GROUP BY 1) USING (article_raw)")
def mat_macro_vlookup(t):
    return R.first_prices(t("v_spec_items"), t("v_catalog"), "article_raw").select("item_id", "kaznisa", "rrts")
