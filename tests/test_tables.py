"""The row pass and line grouping on small tables."""

import random
import re

from pyspark.sql import functions as F

from matchloom.functions import lexicons as L
from matchloom.operators import tables as B


def table(spark, rows, doc=1, no=0):
    head = [["Поз.", "Наименование", "Тип, марка", "Код оборудования", "Ед. изм.", "Кол-во"], ["1", "2", "3", "4", "5", "6"]]
    return spark.createDataFrame([(doc, 1, no, k, r) for k, r in enumerate(head + rows)], "doc_id long, page long, table_no long, row_no long, cells array<string>")


def row_fields(spark, rows):
    cells = table(spark, rows)
    return B.row_fields(cells, B.table_layouts(cells))


def items(spark, rows):
    return [(r.pos, r.name_raw, r.article_raw, r.kaznisa_code_raw, r.unit, r.qty, r.is_heading) for r in B.table_items(row_fields(spark, rows)).orderBy("seq").collect()]


def test_row_classes(spark):
    fields = row_fields(spark, [
        ["", "Before all", "B1", "", "", "1"],
        ["1", "Pump", "", "", "", ""],
        ["", "more", "ab", "", "", "4"],
        ["", "", "", "247-201-0001", "", ""],
        ["", "Other", "X1", "247-201-0002", "шт", "2"],
        ["-", "Seal", "S1", "", "", "5"],
        ["", "2 / Nut", "N1", "", "", "6"],
        ["", "3. Section", "", "", "", ""],
        ["ВРУ-1", "Panel", "", "", "", "1"],
        ["", "Part", "P9", "247-201-0109", "", "2"],
        ["5", "кабели", "гост 5", "", "", "1"],
        ["", None, "", "", "", ""],
    ])
    got = [r.kind for r in B.row_classes(fields).orderBy("row_no").collect()]
    assert got == ["content_first", "item", "content_merge", "bare", "content_complete", "dash", "numbered", "section", "item", "content_part", "skipped", "bare"]
    assert B.row_classes(fields.limit(0)).collect() == []


def test_row_pass(spark):
    got = items(spark, [
        ["1", "Pump", "", "", "", ""],
        ["", "more text", "ab–12", "", "м", "4"],  # content: fills the item before
        ["", "", "", "247-201-0001", "", ""],  # bare: its code
        ["", "Other", "X1", "247-201-0002", "шт", "2"],  # complete before: an item of its own
        ["2", "Valve", "V1", "247-201-0003", "", "3"],
        ["-", "Seal", "S1", "", "", "5"],
        ["", "2 / Nut", "N1", "", "", "6"],
        ["", "3. Section", "", "", "", ""],
        ["", "Гофрированные трубы ГОСТ 12", "", "", "", ""],
        ["4", "20 мм", "T20", "", "м", "7,5"],
        ["ВРУ-1", "Panel", "", "247-201-0108", "", "1"],
        ["", "Part", "P9", "247-201-0109", "", "2"],
        ["5", "кабели", "гост 5", "", "", "1"],  # a category without a code
        ["6", "Box", "ТРОЙСТВО)", "1 2 3", "", ""],
        ["7", "", "", "", "", ""],
    ])
    assert got == [
        ("1", "Pump", "AB-12", "247-201-0001", "м", 4.0, False),
        ("-1", "Other", "X1", "247-201-0002", "шт", 2.0, False),
        ("2", "Valve", "V1", "247-201-0003", "шт.", 3.0, False),
        ("-2", "Seal", "S1", "", "шт.", 5.0, False),
        ("-3", "2 / Nut", "N1", "", "шт.", 6.0, False),
        ("-4", "3. Section", "", "", "", 0.0, True),
        ("4", "Гофрированные трубы 20 мм", "T20", "", "м", 7.5, False),
        ("ВРУ-1", "ВРУ-1  Гофрированные трубы Panel", "", "247-201-0108", "", 0.0, True),
        ("-5", "Гофрированные трубы Panel", "", "247-201-0108", "шт.", 1.0, False),
        ("-6", "Гофрированные трубы Part", "P9", "247-201-0109", "шт.", 2.0, False),
        ("6", "Гофрированные трубы Box", "", "123", "шт.", 1.0, False),
    ]


def test_renumber_and_quality_gate(spark):
    rows = [(1, 1, 0, 0, 0, "i", "9", "a", "", "", "", q, h, c) for q, h, c in ((1.0, False, False),)]
    rows += [(1, 1, 0, 1, 1, "i", "H", "a", "", "", "", 0.0, True, False), (1, 1, 1, 2, 0, "i", "8", "a", "", "", "", 100_000.0, False, True), (1, 1, 2, 3, 0, "i", "7", "a", "", "", "", 5.0, False, True)]
    df = spark.createDataFrame(rows, B.ITEM_SCHEMA)
    kept = B.renumbered(B.quality_gate(df)).orderBy("table_no", "seq").collect()
    assert [r.pos for r in kept] == ["1", "H", "2"]


def test_layouts(spark):
    bare = spark.createDataFrame([(2, 1, 0, 0, ["1", "n", "a", "247-201-0001", "шт", "3"])], "doc_id long, page long, table_no long, row_no long, cells array<string>")
    carried = spark.createDataFrame([(2, 1, 1, 0, ["1", "n", "a", "x", "y", "3"]), (2, 1, 2, 0, ["short"])], bare.schema)
    lay = {r.table_no: (r.pos, r.code, r.qty, r.carried) for r in B.table_layouts(bare.union(carried)).collect()}
    assert lay == {0: (0, 3, 5, False), 1: (0, 3, 5, True)}


def test_line_groups(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 99, 0, 0, 5), (1, 1, "b", 99, 10, 14, 5), (1, 1, "c", 99, 20, 16, 5), (1, 1, "d", 99, 0, 40, 5)], "doc long, page long, text string, conf int, left int, top int, width int")
    assert {r.text: r.line for r in B.line_groups(boxes).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_line_groups_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(d, p, str(k), 99, rng.randrange(900), rng.randrange(400), 5) for d in (1, 2, None) for p in (1, None) for k in range(rng.randrange(5, 90))]
    boxes = spark.createDataFrame([*rows, (1, 1, "none", 99, 0, None, 5)], "doc long, page long, text string, conf int, left int, top int, width int")
    got, want, last = {(r.doc, r.page, r.text): r.line for r in B.line_groups(boxes).collect()}, {(1, 1, "none"): 0}, {}
    for d, p, text, _, _, top, _ in sorted(rows, key=lambda r: r[5]):
        anchor, line = last.get((d, p), (None, -1))
        last[d, p] = anchor, line = (top, line + 1) if anchor is None or top - anchor > 15 else (anchor, line)
        want[d, p, text] = line
    assert got == want
    assert B.line_groups(boxes.limit(0)).collect() == []


def test_replies(spark):
    replies = spark.createDataFrame([(1, '{"items":[{"idx":0,"params":{"a":"1","b":""}},{"idx":99,"params":{"a":"1"}}]}'), (2, '[{"idx":1,"params":{"c":"x"}}]'), (3, "oops")], "batch long, reply string")
    assert sorted((r.batch, r.idx, r.params) for r in B.merged_replies(replies).collect()) == [(1, 0, {"a": "1"}), (2, 1, {"c": "x"})]


class _Walk:
    """The rows of one table one after another, as a plain loop with the last item at hand."""

    def __init__(self):
        self.items, self.auto, self.title, self.kinds = [], 0, "", []

    def step(self, r):
        kind = self.kind(r)
        self.kinds.append(kind)
        if kind in ("bare", "content_merge"):
            if kind == "bare" and len(r.name) > 8 and not (r.article_cell or r.code or r.qty_cell):
                self.title = r.name
            if self.items:
                self.merge(r, kind)
            return
        pos = r.pos
        if kind != "item":
            self.auto += 1
            pos = str(self.auto) if kind == "auto" else f"-{self.auto}"
        if not (r.name or r.article_cell or r.code):
            return
        panel = kind == "item" and not pos[0].isdigit()
        if r.skip and not r.code and not panel and kind != "section":
            self.kinds[-1] = "skipped"
            return
        name = r.name
        if self.title and len(name) <= 20 and (r.has_article or r.code):
            name = (re.sub(L.NORM_SUFFIX, "", self.title).strip() + " " + name).strip()
        heading = panel or kind == "section"
        self.give(r, kind, pos, f"{pos}  {name}".strip() if panel else name, heading)
        if panel and r.code:
            self.auto += 1
            self.give(r, "panel_part", f"-{self.auto}", name, False)

    def kind(self, r):
        if not r.has_pos:
            return "auto"
        if r.pos is not None:
            return "item"
        for k in ("dash", "numbered", "section"):
            if r[k]:
                return k
        if not r.name or not (r.article_clean or r.code):
            return "bare"
        if not self.items:
            return "content_first"
        if r.code and self.items[-1]["code"]:
            return "content_complete"
        return "content_part" if r.code and self.items[-1]["heading"] else "content_merge"

    def give(self, r, kind, pos, name, heading):
        self.items.append({"row": r.row_no, "kind": kind, "pos": pos, "name": name, "article": r.article, "code": r.code, "unit": "" if heading else r.unit or L.CATALOG_UNIT, "qty": 0.0 if heading else r.qty, "heading": heading})

    def merge(self, r, kind):
        i = self.items[-1]
        i["code"] = i["code"] or r.code
        if kind == "content_merge":
            i["article"] = i["article"] or r.article_clean
            i["qty"], i["unit"] = (r.qty if r.qty_cell else i["qty"]), (r.unit or i["unit"])
        elif r.qty_cell:
            i["qty"] = r.qty if i["qty"] == 1 else i["qty"]
            i["unit"] = r.unit if r.unit and i["unit"] == L.CATALOG_UNIT else i["unit"]


def walked(fields):
    """(kinds, items) of every table by the plain loop, and the same by the library."""
    walks = {}
    for r in fields.orderBy(*B.TABLE, "row_no").collect():
        walks.setdefault(tuple(r[k] for k in B.TABLE), _Walk()).step(r)
    plain = [(*t, k) for t, w in walks.items() for k in w.kinds], [(*t, n, *i.values()) for t, w in walks.items() for n, i in enumerate(w.items)]
    kinds = [tuple(r) for r in B.row_classes(fields).orderBy(*B.TABLE, "row_no").drop("row_no").collect()]
    items = [tuple(r) for r in B.table_items(fields).orderBy(*B.TABLE, "seq").select(*B.TABLE, "seq", "row_no", "kind", "pos", "name_raw", "article_raw", "kaznisa_code_raw", "unit", "qty", "is_heading").collect()]
    return plain, (kinds, items)


def test_row_pass_equals_a_loop_on_random_tables(spark):
    """Every order of kinds of rows, with and without a position column, empty cells, repeated units and quantities of one."""
    rng = random.Random(5)
    cells = (["", "", "1", "2.", "-", "ВРУ-1", "ЩС2"], ["", "Насос", "Кабель", "2 / Гайка", "3. Раздел", "Гофрированные трубы ГОСТ 12", "Длинное название", "equipment box"], ["", "", "X1", "AB-12", "ГОСТ 5", "ТРОЙСТВО)"], ["", "", "247-201-0001", "247-201-0002"], ["", "", "м", "шт."], ["", "", "1", "4", "1,5"])
    rows = [(d, 1, t, k, [rng.choice(c) for c in cells]) for d in range(60) for t in range(2) for k in range(rng.randint(1, 40))]
    table = spark.createDataFrame(rows, "doc_id long, page long, table_no long, row_no long, cells array<string>")
    lay = table.select(*B.TABLE).distinct().select("*", F.lit(-1).alias("header_row"), F.when(F.col("doc_id") % 5 != 0, 0).alias("pos"), *[F.lit(n).alias(k) for n, k in enumerate(B.KEYS) if n], (F.col("table_no") == 1).alias("carried"))
    plain, ours = walked(B.row_fields(table, lay, ("equipment",)))
    assert ours == plain
    assert {k for *_, k in plain[0]} == {"auto", "item", "dash", "numbered", "section", "bare", "content_first", "content_complete", "content_part", "content_merge", "skipped"}
    assert len(plain[1]) > 1000


def test_row_pass_equals_a_loop_on_all_given_tables(spark, sf):
    from matchloom.plans import documents
    from matchloom.plans.views import Tables

    plain, ours = walked(documents.fields(Tables(spark, sf)))
    assert ours == plain and plain[1]


def test_row_pass_stays_in_the_engine(spark):
    plan = B.table_items(row_fields(spark, [["1", "Pump", "", "", "", ""]]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
