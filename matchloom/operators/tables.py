"""Items from ragged tables: word boxes to cells, column layouts, and the row pass.

Tables are rows (doc_id, page, table_no, row_no, cells array<string>), both numbers
from 0.  Layouts are one row a table with a column index for each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.functions import text as X

KEYS = ("pos", "name", "article", "code", "unit", "qty")
TABLE = ("doc_id", "page", "table_no")


def confident_words(boxes: DataFrame, minimum: int = 25) -> DataFrame:
    return boxes.where((F.trim("text") != "") & (F.col("conf") >= minimum))


def line_groups(boxes: DataFrame, tolerance: int = 15) -> DataFrame:
    """Adds ``line``: words by top join a line while they are near the top of its first word.

    Where a line starts depends on the line before, so the tops of a page, each once, are
    folded into an array of starts; a word's line is the number of starts down to its top.
    Words without a top are in line 0.
    """
    far = lambda a, x: F.coalesce(x - F.try_element_at(a, F.lit(-1)) > tolerance, F.lit(True))
    tops = boxes.groupBy(F.col("doc").alias("_doc"), F.col("page").alias("_page")).agg(F.sort_array(F.collect_set("top")).alias("_tops"))
    starts = tops.withColumn("_starts", F.aggregate("_tops", F.slice("_tops", 1, 0), lambda a, x: F.when(far(a, x), F.concat(a, F.array(x))).otherwise(a)))
    joined = boxes.join(starts, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
    line = F.size(F.filter("_starts", lambda s: s <= F.col("top"))) - 1
    return joined.select(*[F.col(f"`{c}`") for c in boxes.columns], F.greatest(line, F.lit(0)).alias("line"))


def split_cells(boxes: DataFrame, gap: int = 22) -> DataFrame:
    """(doc, page, line, cell, text): a new cell where the gap to the running right edge is wide."""
    w = Window.partitionBy("doc", "page", "line").orderBy("left", "text")
    edge = F.max(F.col("left") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("_new", F.coalesce((F.col("left") - edge >= gap).cast("int"), F.lit(0)))
    celled = starts.withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"])
    return celled.groupBy("doc", "page", "line", "cell").agg(F.array_join(words, " ").alias("text"))


def _row_text() -> Column:
    return F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))


def spec_tables(rows: DataFrame, markers: Sequence[str] = L.NON_SPEC_MARKERS, first: int = 4) -> DataFrame:
    """The rows of tables without a marker in their first rows."""
    marked = rows.where((F.col("row_no") < first) & _row_text().rlike(X.any_of(markers))).select(*TABLE).distinct()
    return rows.join(marked, list(TABLE), "left_anti")


def _at(cells: str, hit) -> Column:
    """Indexes of the elements that ``hit`` holds for, in order."""
    return F.array_compact(F.transform(cells, lambda c, i: F.when(hit(c), i)))


def _signs(rows: DataFrame, patterns: dict[str, Sequence[str]] = L.HEADER_PATTERNS, excluded: Sequence[str] = L.HEADER_EXCLUDED, units: Sequence[str] = L.UNITS, other: Sequence[str] = L.HEADERLESS_EXCLUDED, first: int = 6, votes: int = 20) -> DataFrame:
    """All that layouts are made of, one row a table: ``head`` (its header with column indexes),
    ``codes`` and ``units`` (the columns of code-like and unit cells of the first rows, one entry a
    cell), ``places`` (columns with a position value), ``other`` (a phrase of other tables), ``width``.

    Texts are looked at row by row and only indexes are shuffled; what a caller does not select
    is not computed.  Each step's texts are columns, so that none is cleaned twice.
    """
    top = lambda n, v: F.when(F.col("row_no") < n, v)
    texts = rows.select(*TABLE, "row_no", "cells", top(first, F.transform("cells", X.header_norm)).alias("heads"), top(votes, F.transform("cells", lambda c: X.strip(F.coalesce(c, F.lit(""))))).alias("plain"))
    short = texts.withColumns({"keys": F.transform("heads", X.head_key), "low": F.transform("plain", F.lower), "bare": F.transform("plain", lambda c: F.regexp_replace(c, r"\.+$", ""))})
    words = {k: X.any_of([w.lower().replace("-", "").replace(" ", "") for w in patterns[k]]) for k in KEYS}
    column = lambda k: F.array_min(_at("keys", lambda c: c.rlike(words[k])))
    has = lambda k: F.exists("keys", lambda c: c.rlike(words[k]))
    good = has("pos") & has("article") & has("qty") & ~F.array_join("heads", " ").rlike(X.any_of(excluded))
    unit = lambda c: c.isin(*units) | F.regexp_replace(c, r"\.+$", "").isin(*units)
    all_of = lambda v: F.flatten(F.collect_list(v))
    return short.groupBy(*TABLE).agg(
        F.min_by(F.when(good, F.struct(F.col("row_no").alias("header_row"), *[column(k).alias(k) for k in KEYS])), F.when(good, F.col("row_no"))).alias("head"),
        all_of(_at("plain", lambda c: c.rlike(r"^\d{3}-\d{3}"))).alias("codes"), all_of(_at("low", unit)).alias("units"), all_of(top(15, _at("bare", X.pos_token))).alias("places"),
        F.max(top(3, _row_text().rlike(X.any_of(other)))).alias("other"), F.max(F.size("plain")).alias("cells"), F.max_by(F.size("cells"), -F.col("row_no")).alias("width"),
    )


def _most(columns: str) -> Column:
    """The most frequent entry (ties: the least), null if there is none."""
    counted = F.transform(F.array_distinct(columns), lambda c: F.struct(F.size(F.filter(columns, lambda x: x == c)).alias("n"), (-c).alias("c")))
    return -F.array_max(counted)["c"]


def _bare_layout() -> Column:
    """The layout by votes, or null."""
    left = lambda k: F.when(F.col("code_col") >= k, F.col("code_col") - k)
    pos = F.when(F.array_contains("places", left(3)), left(3))
    lay = F.struct(F.lit(-1).cast("long").alias("header_row"), pos.alias("pos"), left(2).alias("name"), left(1).alias("article"), F.col("code_col").alias("code"), F.col("unit_col").alias("unit"), (F.col("unit_col") + 1).alias("qty"))
    return F.when(F.col("code_col").isNotNull() & ~F.coalesce("other", F.lit(False)), lay)


def _voted(signs: DataFrame) -> DataFrame:
    return signs.withColumns({"code_col": _most("codes"), "unit_col": _most("units")})


def header_layouts(rows: DataFrame, patterns: dict[str, Sequence[str]] = L.HEADER_PATTERNS, excluded: Sequence[str] = L.HEADER_EXCLUDED, first: int = 6) -> DataFrame:
    """(table, header_row, column indexes): the first row with position, article and quantity
    columns and no phrase of other tables."""
    return _signs(rows, patterns, excluded, first=first).where("head is not null").select(*TABLE, "head.*")


def column_votes(rows: DataFrame, units: Sequence[str] = L.UNITS, first: int = 20) -> DataFrame:
    """(table, code_col, unit_col): the columns with most code-like and unit cells (ties: left)."""
    return _voted(_signs(rows, units=units, votes=first).where("cells > 0")).select(*TABLE, "code_col", "unit_col")


def headerless_layouts(rows: DataFrame, units: Sequence[str] = L.UNITS, excluded: Sequence[str] = L.HEADERLESS_EXCLUDED) -> DataFrame:
    """Layouts from votes: position, name and article are left of the code, quantity right of
    the unit; no position column if none of the first rows has a position value there."""
    found = _voted(_signs(rows, units=units, other=excluded)).select(*TABLE, _bare_layout().alias("lay"))
    return found.where("lay is not null").select(*TABLE, *[F.col(f"lay.{k}").alias(k) for k in KEYS])


def table_layouts(rows: DataFrame, patterns: dict[str, Sequence[str]] = L.HEADER_PATTERNS, units: Sequence[str] = L.UNITS) -> DataFrame:
    """One layout a table: by its header, else by votes, else carried from the last table of the
    document that had one, if the first row is wide enough.  Adds header_row (-1 without) and
    ``carried``.  One aggregation of the rows, then a window over the tables of a document."""
    tables = _voted(_signs(rows, patterns, units=units)).select(*TABLE, "width", F.coalesce("head", _bare_layout()).alias("own"))
    w = Window.partitionBy("doc_id").orderBy("page", "table_no").rowsBetween(Window.unboundedPreceding, -1)
    carried = tables.withColumn("before", F.last("own", ignorenulls=True).over(w))
    fits = F.col("width") > F.greatest(*[F.coalesce(F.col(f"before.{k}"), F.lit(0)) for k in KEYS])
    both = carried.withColumns({"lay": F.coalesce("own", F.when(fits, F.col("before"))), "carried": F.col("own").isNull()})
    return both.where("lay is not null").select(*TABLE, F.when(F.col("carried"), -1).otherwise(F.col("lay.header_row")).alias("header_row"), *[F.col(f"lay.{k}").alias(k) for k in KEYS], "carried")


def data_rows(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows below the header with their fields; a numbering row right below it is left out."""
    joined = rows.join(layouts.withColumnsRenamed({k: f"at_{k}" for k in KEYS}), list(TABLE)).where(F.col("row_no") > F.col("header_row"))
    raw = {k: X.cell(F.col("cells"), F.coalesce(F.col(f"at_{k}"), F.lit(-2))) for k in KEYS if k != "code"}
    fields = joined.withColumns({**{f"{k}_raw": v for k, v in raw.items()}, "code": F.when(F.col("at_code").isNull(), F.lit("")).otherwise(X.code_repair(F.col("cells"), F.col("at_code")))})
    numbers = [F.when(F.col(f"at_{k}").isNotNull(), F.col(f"{k}_raw").rlike(r"^\d{1,2}$")) for k in ("article", "name", "qty")]
    numbering = (F.col("row_no") == F.col("header_row") + 1) & (F.size(F.array_compact(F.array(*numbers))) >= 2) & F.forall(F.array_compact(F.array(*numbers)), lambda x: x)
    return fields.where(~numbering)


def row_fields(rows: DataFrame, layouts: DataFrame, skip: Sequence[str] = L.SKIP_KEYWORDS) -> DataFrame:
    """What the row pass looks at, as columns."""
    d = data_rows(rows, layouts)
    article = X.article_clean(F.col("article_raw"))
    return d.select(
        *TABLE, "row_no", "carried", F.col("at_pos").isNotNull().alias("has_pos"), (F.col("pos_raw") == "-").alias("dash"), X.pos_value(F.col("pos_raw")).alias("pos"), F.col("name_raw").alias("name"), F.col("article_raw").alias("article_cell"),
        article.alias("article_clean"), X.article_clean(X.standard_ref(F.col("article_raw"))).alias("article"), (X.standard_ref(F.col("article_raw")) != "").alias("has_article"), "code", F.col("unit_raw").alias("unit"), F.col("qty_raw").alias("qty_cell"), X.quantity(F.col("qty_raw")).alias("qty"),
        F.col("name_raw").rlike(r"^\d+\s*[/)]\s").alias("numbered"), (F.col("name_raw").rlike(r"^\d+\.\s*\S") & (article == "") & (F.col("code") == "")).alias("section"),
        F.lower(F.concat("name_raw", F.lit(" "), "article_raw")).rlike(X.any_of(skip)).alias("skip"),
    )


ITEM_SCHEMA = "doc_id long, page long, table_no long, row_no long, seq int, kind string, pos string, name_raw string, article_raw string, kaznisa_code_raw string, unit string, qty double, is_heading boolean, carried boolean"

#: Kinds of rows that give an item whatever stands above them.
_OWN = ("auto", "item", "dash", "numbered", "section")


def _classed(fields: DataFrame) -> DataFrame:
    """Adds ``kind``, ``emits``, ``heading``, ``panel`` (a heading with an item of its own) and ``title``.

    What a row with a name and an article or code is depends on the last item, of which only three
    things count: that there is one, that it has a code by now, and that it heads a group.  All
    three are known from the last *anchor*, a row that gives an item by itself or is the first that
    can: later rows give items only with a code, and every code since then is in the last item.  So
    running windows over the rows of a table do, with one shuffle and one sort.  Row numbers are
    unique in a table.
    """
    above = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    coded, some = F.col("code") != "", (F.col("name") != "") | (F.col("article_cell") != "") | (F.col("code") != "")
    content = (F.col("name") != "") & ((F.col("article_clean") != "") | coded)
    own = F.when(~F.col("has_pos"), "auto").when(F.col("pos").isNotNull(), "item").when(F.col("dash"), "dash").when(F.col("numbered"), "numbered").when(F.col("section"), "section")
    named = (F.col("_own") == "item") & ~F.col("pos").rlike(r"(?U)^[\d-]")
    first = fields.withColumn("_own", F.coalesce(own, F.when(content, "content"), F.lit("bare"))).withColumn("heading", (F.col("_own") == "section") | named)
    gives = F.col("_own").isin("content", *_OWN) & some & ~(F.col("skip") & ~F.col("heading") & ~coded)
    heads = F.when((F.col("_own") == "bare") & (F.length("name") > 8) & (F.col("article_cell") == "") & (F.col("qty_cell") == "") & ~coded, F.col("name"))
    seen = first.withColumn("_gives", gives).withColumns({"_any": F.coalesce(F.max("_gives").over(above), F.lit(False)), "title": F.last(heads, ignorenulls=True).over(above), "_coded": F.max(F.when(coded, F.col("row_no"))).over(above)})
    anchor = F.col("_gives") & ((F.col("_own") != "content") | ~F.col("_any"))
    last = F.last(F.when(anchor, F.struct("row_no", "heading")), ignorenulls=True).over(above)
    known = seen.withColumn("_last", last)
    later = F.when(coded & (F.col("_coded") >= F.col("_last.row_no")), "content_complete").when(coded & F.col("_last.heading"), "content_part").otherwise("content_merge")
    kind = F.when(F.col("_own") != "content", F.col("_own")).when(F.col("_any"), later).otherwise("content_first")
    classed = known.withColumn("kind", kind).withColumn("emits", F.col("_gives") & (F.col("kind") != "content_merge"))
    return classed.withColumn("panel", F.col("emits") & named & coded).drop("_any", "_coded", "_last")


def row_classes(fields: DataFrame) -> DataFrame:
    """(table, row_no, kind) of every data row."""
    left_out = F.col("kind").isin("content_first", *_OWN) & ~F.col("_gives") & F.col("skip") & ((F.col("name") != "") | (F.col("article_cell") != ""))
    return _classed(fields).select(*TABLE, "row_no", F.when(left_out, "skipped").otherwise(F.col("kind")).alias("kind"))


def table_items(fields: DataFrame, unit: str = L.CATALOG_UNIT) -> DataFrame:
    """Items of every table after the row pass, continuation rows merged, before renumbering.

    Rows up to the next one that gives an item are one group.  Its code and article are the
    first that are not empty.  Content rows set quantity and unit, bare ones replace what was
    left at the default after that; so the last content value and the first bare one after it count.
    """
    ordered = Window.partitionBy(*TABLE).orderBy("row_no")
    above, here = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    given = F.coalesce(F.nullif("unit", F.lit("")), F.lit(unit))
    grows = F.col("kind").isin("auto", "dash", "numbered", "section", "content_first", "content_complete", "content_part").cast("int") + F.col("panel").cast("int")
    merges, alone = F.col("kind") == "content_merge", F.col("heading") & ~F.col("panel")
    running = lambda c: F.last(F.when(c, F.col("row_no")), ignorenulls=True).over(here)
    placed = _classed(fields).withColumns({
        "_n": (F.coalesce(F.sum(grows).over(above), F.lit(0)) + 1).cast("string"), "_seq": F.coalesce(F.sum(F.col("emits").cast("int") + F.col("panel").cast("int")).over(above), F.lit(0)),
        "_item": running(F.col("emits")), "_qty_at": running(F.col("emits") | (merges & (F.col("qty_cell") != ""))), "_unit_at": running(F.col("emits") | (merges & (F.col("unit") != ""))),
    }).where("_item is not null")
    pos = F.when(F.col("kind") == "auto", F.col("_n")).when(F.col("kind") == "item", F.col("pos")).otherwise(F.concat(F.lit("-"), "_n"))
    cut = X.strip(F.regexp_replace("title", L.NORM_SUFFIX.replace("(?i)", "(?iuU)"), ""))
    name = F.when(F.col("title").isNotNull() & (F.length("name") <= 20) & (F.col("has_article") | (F.col("code") != "")), X.strip(F.concat(cut, F.lit(" "), "name"))).otherwise(F.col("name"))
    row = F.struct("_seq", "_n", "kind", pos.alias("pos"), name.alias("name"), "article", "code", "heading", "panel", "carried")
    first = lambda v, when: F.coalesce(F.min_by(v, F.when(when & (v != ""), F.col("row_no"))), F.lit(""))
    set_by = lambda at, v: F.max_by(v, F.when(F.col(at) == F.col("row_no"), F.col("row_no")))
    after = lambda at, v, when: F.max(F.when((F.col("kind") == "bare") & (F.col("qty_cell") != "") & when, F.struct(F.col(at).alias("at"), (-F.col("row_no")).alias("no"), F.col(v).alias("v"))))
    merged = placed.groupBy(*TABLE, F.col("_item").alias("row_no")).agg(
        F.max(F.when(F.col("emits"), row)).alias("r"), first(F.col("code"), F.lit(True)).alias("code"), first(F.when(F.col("emits"), F.col("article")).otherwise(F.col("article_clean")), F.col("emits") | merges).alias("article"),
        F.max("_qty_at").alias("qa"), set_by("_qty_at", F.when(F.col("emits") & alone, F.lit(0.0)).otherwise(F.col("qty"))).alias("qty"), after("_qty_at", "qty", F.col("qty") != 1).alias("q"),
        F.max("_unit_at").alias("ua"), set_by("_unit_at", F.when(F.col("emits") & alone, F.lit("")).when(F.col("emits"), given).otherwise(F.col("unit"))).alias("unit"), after("_unit_at", "unit", ~F.col("unit").isin("", unit)).alias("u"),
    )
    qty = F.when((F.col("qty") == 1) & (F.col("q.at") == F.col("qa")), F.col("q.v")).otherwise(F.col("qty"))
    units = F.when((F.col("unit") == unit) & (F.col("u.at") == F.col("ua")), F.col("u.v")).otherwise(F.col("unit"))
    item = lambda seq, kind, pos, name, article, code, unit, qty, heading: F.struct(*[v.alias(k) for k, v in {"seq": seq.cast("int"), "kind": kind, "pos": pos, "name_raw": name, "article_raw": article, "kaznisa_code_raw": code, "unit": unit, "qty": qty, "is_heading": heading}.items()])
    r, full = (lambda k: F.col(f"r.{k}")), X.strip(F.concat("r.pos", F.lit("  "), "r.name"))
    named = r("heading") & (r("kind") == "item")
    head = item(r("_seq"), r("kind"), r("pos"), full, r("article"), r("code"), F.lit(""), F.lit(0.0), F.lit(True))
    part = item(r("_seq") + 1, F.lit("panel_part"), F.concat(F.lit("-"), r("_n")), r("name"), F.col("article"), F.col("code"), units, qty, F.lit(False))
    only = item(r("_seq"), r("kind"), r("pos"), F.when(named, full).otherwise(r("name")), F.col("article"), F.col("code"), units, qty, r("heading"))
    out = merged.select(*TABLE, "row_no", F.explode(F.when(r("panel"), F.array(head, part)).otherwise(F.array(only))).alias("i"), r("carried").alias("carried"))
    return out.select(*TABLE, "row_no", "i.*", "carried")


def quality_gate(items: DataFrame, huge: float = 99_999, most_huge: float = 0.3, most_empty: float = 0.8) -> DataFrame:
    """Without the items of carried-layout tables whose quantities or rows look wrong."""
    n = F.count("*")
    empty = (F.coalesce("name_raw", F.lit("")) == "") & (F.coalesce("article_raw", F.lit("")) == "") & (F.coalesce("kaznisa_code_raw", F.lit("")) == "")
    bad = items.where("carried").groupBy(*TABLE).agg((F.count_if(F.col("qty") > huge) > n * most_huge).alias("h"), (F.count_if(empty) > n * most_empty).alias("e")).where("h or e")
    return items.join(bad.select(*TABLE), list(TABLE), "left_anti")


def renumbered(items: DataFrame) -> DataFrame:
    """Positions 1..n over the items of a document; headings keep theirs."""
    w = Window.partitionBy("doc_id").orderBy("page", "table_no", "seq").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(~F.col("is_heading"), 1).otherwise(0)).over(w)
    return items.withColumn("pos", F.when(F.col("is_heading"), F.col("pos")).otherwise(number.cast("string")))


def auto_positions(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """A running ``-n`` for the rows of a table without a position."""
    w = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.col(pos).isNull().cast("int")).over(w)
    return rows.withColumn(pos, F.coalesce(F.col(pos), F.concat(F.lit("-"), n.cast("string"))))


def carried_sections(fields: DataFrame) -> DataFrame:
    """Short names get the last section title above them, without its norm suffix."""
    title = F.when((F.length("name") > 8) & (F.col("article_cell") == "") & (F.col("code") == "") & (F.col("qty_cell") == "") & F.col("pos").isNull() & ~F.col("dash") & ~F.col("numbered") & ~F.col("section"), F.col("name"))
    w = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = X.strip(F.regexp_replace(F.last(title, ignorenulls=True).over(w), L.NORM_SUFFIX.replace("(?i)", "(?iuU)"), ""))
    short = (F.length("name") <= 20) & (F.col("has_article") | (F.col("code") != "")) & (F.coalesce(cut, F.lit("")) != "")
    return fields.withColumn("full_name", F.when(short, F.concat(cut, F.lit(" "), "name")).otherwise(F.col("name")))


def panel_rows(fields: DataFrame, unit: str = L.CATALOG_UNIT) -> DataFrame:
    """Rows with a named position: a heading, and an item of its own if it has a code."""
    panel = fields.where(F.col("pos").isNotNull() & ~F.col("pos").rlike(r"^[\d-]"))
    name = F.concat("pos", F.lit("  "), "name")
    heading = F.struct(X.strip(name).alias("name_raw"), F.lit("").alias("unit"), F.lit(0.0).alias("qty"), F.lit(True).alias("is_heading"))
    item = F.struct(F.col("name").alias("name_raw"), F.coalesce(F.nullif("unit", F.lit("")), F.lit(unit)).alias("unit"), "qty", F.lit(False).alias("is_heading"))
    return panel.withColumn("part", F.explode(F.when(F.col("code") != "", F.array(heading, item)).otherwise(F.array(heading)))).select(*TABLE, "row_no", "code", "part.*")


def extracted(fields: DataFrame, unit: str = L.CATALOG_UNIT) -> DataFrame:
    """Fields of rows with a name, article or code, with the default unit."""
    some = fields.where((F.col("name") != "") | (F.col("article_cell") != "") | (F.col("code") != ""))
    return some.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.lit(unit)))


def prompt_batches(items: DataFrame, size: int = 15, order: str = "item_id") -> DataFrame:
    """(doc_id, batch, prompt): numbered lines of ``size`` items each; headings count but have no line."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    rows = items.withColumns({"_n": n}).withColumns({"batch": F.floor(F.col("_n") / size), "idx": F.col("_n") % size})
    name, art = F.substring(F.trim(F.coalesce("name_raw", F.lit(""))), 1, 250), F.substring(F.trim(F.coalesce("article_raw", F.lit(""))), 1, 60)
    line = F.concat(F.col("idx").cast("string"), F.lit(". "), F.when(art != "", F.concat(F.lit("["), art, F.lit("] "))).otherwise(""), name)
    lines = F.transform(F.sort_array(F.collect_list(F.when(~F.coalesce("is_heading", F.lit(False)), F.struct("idx", line.alias("line"))))), lambda x: x["line"])
    return rows.groupBy("doc_id", "batch").agg(F.array_join(lines, "\n").alias("prompt"))


_ENTRY = "array<struct<idx:string,params:map<string,string>>>"


def merged_replies(replies: DataFrame, size: int = 15) -> DataFrame:
    """(batch, idx, params): entries of replies, a list or an object with one under a known
    key; bad indexes and empty values are dropped."""
    wrapped = F.from_json("reply", f"results {_ENTRY}, items {_ENTRY}, positions {_ENTRY}, data {_ENTRY}")
    entries = F.coalesce(*[wrapped[k] for k in ("results", "items", "positions", "data")], F.from_json("reply", _ENTRY))
    rows = replies.select("batch", F.explode(entries).alias("e")).select("batch", F.expr("try_cast(e.idx as int)").alias("idx"), F.map_filter("e.params", lambda k, v: (k != "") & (F.trim(v) != "") & ~v.isin("0", "false")).alias("params"))
    return rows.where(F.col("idx").between(0, size - 1) & (F.size("params") > 0))
