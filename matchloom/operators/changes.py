"""Catalog change data: upserts, price diffs, history, versions, corrections.

Parquet has no merge, so an upsert is a full outer join that gives a new snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from matchloom.functions import lexicons as L
from matchloom.functions import text as X
from matchloom.sources.commits import commit, commits, committed, is_committed, prepare

TRACKED = ("rrts", "opt", "partner")
TOLERANCE = 0.01


def numbered(rows: DataFrame, key: str, name: str, after: DataFrame, buckets: int = 256) -> DataFrame:
    """``rows`` with numbers ``name`` that go on from the one row and column of ``after``.

    Rows are numbered within hashed buckets of ``key`` in parallel; each bucket starts
    after the rows of the ones before, of which one task sees the counts only.
    """
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    top = after.select(F.col(after.columns[0]).alias("_top"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    out = dealt.withColumn("_r", place).join(starts, "_b").crossJoin(F.broadcast(top))
    return out.withColumn(name, (F.col("_top") + F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_r", "_start", "_top")


def _last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_catalog(catalog: DataFrame, rows: DataFrame, segment: str, order: str = "row_no") -> DataFrame:
    """The catalog after an import into one segment: known articles take all fields of their
    last row, new ones are inserted once with ids after the largest; other segments stay.

    Adds ``change``: added, updated or null.
    """
    new = _last_wins(rows.where(F.col("article").isNotNull()), ["article"], order)
    fields = [c for c in new.columns if c in catalog.columns and c not in ("article", "id", "segment")]
    own, others = catalog.where(F.col("segment") == segment), catalog.where(F.coalesce(F.col("segment") != segment, F.lit(True)))
    joined = own.join(new.select("article", F.struct(*fields).alias("_new")), "article", "full_outer")
    given = F.col("_new").isNotNull()
    change = F.when(given & F.col("id").isNull(), "added").when(given, "updated")
    merged = joined.select(*[F.when(given, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.coalesce(F.col(c), F.lit(segment)).alias(c) if c == "segment" else F.when(given, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c) for c in catalog.columns], change.alias("change"))
    fresh = numbered(merged.where("change = 'added'").drop("id"), "article", "id", catalog.agg(F.coalesce(F.max("id"), F.lit(0)))).select(*merged.columns)
    kept = merged.where("change is null or change <> 'added'")
    return others.withColumn("change", F.lit(None).cast("string")).unionByName(kept.unionByName(fresh))


def upsert_constants(constants: DataFrame, rows: DataFrame, defaults: dict[str, float] = L.BRAND_DEFAULTS, order: str = "row_no") -> DataFrame:
    """By brand: a given value replaces, a missing one keeps, a new brand gets defaults.
    Several rows of a brand apply in order, so the last given value of each field counts."""
    given = rows.groupBy("brand").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in defaults])
    joined = constants.join(given, "brand", "full_outer")
    return joined.select("brand", *[F.coalesce(f"_{f}", F.when(F.col("margin").isNull() & F.col("logistics").isNull(), F.lit(d)).otherwise(F.col(f))).cast("double").alias(f) for f, d in defaults.items()])


def upsert_currencies(currencies: DataFrame, rows: DataFrame, order: str = "row_no") -> DataFrame:
    """By name; the last value of the file wins."""
    last = rows.where("name is not null and rate is not null").groupBy("name").agg(F.max_by("rate", order).alias("_rate"))
    return currencies.join(last, "name", "full_outer").select("name", F.coalesce("_rate", "rate").alias("rate"))


def one_of(rows: DataFrame, key: str, fields: Sequence[str], order: str | None, last: bool) -> DataFrame:
    """(key, _e): of rows that repeat a key the first or last by ``order`` (ties and no order: the
    least or greatest fields), so that a join by the key does not fan out."""
    struct = F.struct(*[F.col(f).alias(f) for f in fields])
    place = F.struct(*([F.col(order).alias("_o")] if order else []), struct.alias("_f"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg((F.max if last else F.min)(place).alias("_p")).select(key, F.col("_p._f").alias("_e"))


def upsert_people(people: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """By name: given fields replace, and the person is active again.  Of a name that rows repeat the
    first (by ``order``) counts; rows without a name are left out."""
    joined = people.join(one_of(rows, "full_name", ("position", "email", "phone"), order, last=False).withColumnRenamed("_e", "_n"), "full_name", "full_outer")
    return joined.select("full_name", *[F.coalesce(F.col("_n")[c], F.col(c)).alias(c) for c in ("position", "email", "phone")], (F.col("_n").isNotNull() | F.coalesce("is_active", F.lit(False))).alias("is_active"))


def patch(table: DataFrame, edits: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows with an edit take the fields that it gives; of several edits the last (by ``order``) that gives a field."""
    fields = [c for c in edits.columns if c not in (key, order)]
    given = edits.where(F.col(key).isNotNull()).groupBy(key)
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(order, f))) if order else F.max(f)
    joined = table.join(given.agg(*[last(f).alias(f"_{f}") for f in fields]).select(key, F.struct(*[F.col(f"_{f}").alias(f) for f in fields]).alias("_e")), key, "left")
    return joined.select(*[F.coalesce(F.col("_e")[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def soft_delete(table: DataFrame, which: Column) -> DataFrame:
    return table.withColumn("is_active", F.col("is_active") & ~F.coalesce(which, F.lit(False)))


def price_diff(catalog: DataFrame, incoming: DataFrame, mark_missing: bool = False) -> DataFrame:
    """(article, row_no, kind, name, brand, changes): new, updated, deleted and skipped records.

    Only active products with an article count as known.  ``changes`` maps a tracked
    field to its old and new value, where the new one is given and the old one is
    missing or more than a cent away.  Each incoming row gives a record with its row
    number (null where ``incoming`` has none), also those of one article; a missing
    article gives one deleted record.
    """
    row_no = F.col("row_no").cast("long") if "row_no" in incoming.columns else F.lit(None).cast("long").alias("row_no")
    inc = incoming.select("article", row_no, F.col("name").alias("_name"), F.col("brand").alias("_brand"), F.col("price_rrts").alias("_rrts"), F.coalesce(X.falsy(F.col("price_opt")), F.col("price_base")).alias("_opt"), F.col("price_partner").alias("_partner"))
    old = catalog.where("is_active and article <> ''").groupBy("article").agg(F.max_by(F.struct("name", "brand", *TRACKED), "id").alias("p"))
    joined = inc.join(old, "article", "left")
    entry = lambda f: F.struct(F.col(f"p.{f}").alias("old"), F.col(f"_{f}").alias("new"))
    changed = lambda f: F.col(f"_{f}").isNotNull() & (F.col(f"p.{f}").isNull() | (F.abs(F.col(f"p.{f}") - F.col(f"_{f}")) > TOLERANCE))
    pairs = F.filter(F.array(*[F.when(changed(f), F.struct(F.lit(f).alias("key"), entry(f).alias("value"))) for f in TRACKED]), lambda x: x.isNotNull())
    there = F.col("p").isNotNull()
    kind = F.when(F.coalesce("article", F.lit("")) == "", "skipped").when(~there, "new").when(F.size("changes") > 0, "updated").otherwise("skipped")
    records = joined.withColumn("changes", F.map_from_entries(pairs)).select(
        "article", "row_no", kind.alias("kind"), F.coalesce(F.nullif(F.col("_name"), F.lit("")), "p.name").alias("name"), F.coalesce(F.nullif(F.col("_brand"), F.lit("")), "p.brand", F.lit("")).alias("brand"), "changes"
    )
    if not mark_missing:
        return records
    gone = old.join(incoming.select("article"), "article", "left_anti").select("article", F.lit(None).cast("long").alias("row_no"), F.lit("deleted").alias("kind"), "p.name", F.coalesce("p.brand", F.lit("")).alias("brand"), F.create_map().cast("map<string,struct<old:double,new:double>>").alias("changes"))
    return records.unionByName(gone)


def long_changes(diff: DataFrame) -> DataFrame:
    """One row a changed field: (article, kind, field, old_value, new_value)."""
    rows = diff.select("article", "kind", F.explode(F.map_entries("changes")).alias("e"))
    return rows.select("article", "kind", F.col("e.key").alias("field"), F.col("e.value.old").alias("old_value"), F.col("e.value.new").alias("new_value"))


def price_history(diff: DataFrame, supplier: str, log_id: int) -> DataFrame:
    """History rows of the updated articles."""
    return long_changes(diff.where("kind = 'updated'")).select(F.lit(supplier).alias("supplier_code"), "article", "field", "old_value", "new_value", F.lit(log_id).cast("long").alias("import_log_id"))


def store_diff(diff: DataFrame, job_id: int, supplier: str, filename: str) -> DataFrame:
    """Pending records with their changes as JSON: written by job, so a lookup reads one folder."""
    return diff.where("kind <> 'skipped'").select(F.lit(job_id).cast("long").alias("job_id"), F.lit(supplier).alias("supplier_code"), F.lit(filename).alias("filename"), F.lit("pending").alias("status"), "article", "row_no", "kind", "name", "brand", F.to_json("changes").alias("changes_json"))


def load_diff(stored: DataFrame, job_id: int) -> DataFrame:
    changes = F.from_json("changes_json", "map<string,struct<old:double,new:double>>")
    return stored.where(F.col("job_id") == job_id).select("article", "row_no", "kind", "name", "brand", "status", changes.alias("changes"))


def apply_diff(catalog: DataFrame, diff: DataFrame, status: str = "pending") -> DataFrame:
    """The catalog after a confirmed diff; refused unless it is pending.

    New articles are inserted once (default segment and unit, their last record),
    changed prices set, deleted articles deactivated.  Several records of an article
    apply in the order of their row numbers (ties: by their values), so the last one
    that changes a field sets it.  Adds ``change``.
    """
    if status != "pending":
        raise ValueError(f"diff is {status}, not pending")
    order = F.struct("row_no", "kind", "name", "brand", F.to_json("changes"))
    new = lambda f: F.try_element_at(F.col("changes"), F.lit(f))["new"]
    fields = [F.max_by(new(f), F.when(new(f).isNotNull(), order)).alias(f"_{f}") for f in TRACKED]
    once = diff.where("kind <> 'skipped'").groupBy("article").agg(F.max_by(F.struct("kind", "name", "brand"), order).alias("d"), *fields)
    value = lambda f: F.col(f"_{f}")
    joined = catalog.join(once.where("d.kind <> 'new'"), "article", "left")
    kept = joined.select(*[F.coalesce(value(c), F.col(c)).alias(c) if c in TRACKED else (F.col(c) & ~F.coalesce(F.col("d.kind") == "deleted", F.lit(False))).alias(c) if c == "is_active" else F.col(c) for c in catalog.columns], F.col("d.kind").alias("change"))
    fresh = numbered(once.where("d.kind = 'new'"), "article", "_id", catalog.agg(F.coalesce(F.max("id"), F.lit(0))))
    known = {"id": F.col("_id"), "article": F.col("article"), "name": F.col("d.name"), "brand": F.col("d.brand"), "segment": F.lit(L.DEFAULT_SEGMENT), "is_active": F.lit(True), **{f: value(f) for f in TRACKED}}
    types = dict(catalog.dtypes)
    added = fresh.select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in catalog.columns], F.lit("added").alias("change"))
    return kept.unionByName(added)


JOB_FIELDS = "job_id long, status string, rows_new long, rows_updated long, rows_deleted long, rows_history long"


HISTORY = "supplier_code string, article string, field string, old_value double, new_value double, import_log_id long"


def confirm_import(catalog: DataFrame, diff: DataFrame, path: str, job_id: int, supplier: str) -> DataFrame:
    """Applies a pending diff once: the catalog after it and its price history are written, then the
    job's record with its counts.  The stored record refuses a second confirmation, and a job
    that died before its record is done anew.  The catalog as committed."""
    spark, batch = catalog.sparkSession, f"job-{job_id}"
    if is_committed(spark, f"{path}/catalog", batch):
        raise ValueError(f"import {job_id} was confirmed already")
    after = apply_diff(catalog, diff)
    attempt = prepare(after, f"{path}/catalog", batch)
    history = price_history(diff, supplier, job_id)
    prepare(history, f"{path}/history", batch, attempt=attempt)
    n = {r["kind"]: r["n"] for r in diff.where("kind <> 'skipped'").groupBy("kind").agg(F.count_distinct("article").alias("n")).collect()}
    counts = {"rows_new": n.get("new", 0), "rows_updated": n.get("updated", 0), "rows_deleted": n.get("deleted", 0), "rows_history": history.count()}
    if not commit(spark, f"{path}/catalog", batch, attempt, job_id=job_id, status="confirmed", **counts):
        raise ValueError(f"import {job_id} was confirmed already")
    return committed(spark, f"{path}/catalog", after.schema).where(F.col("batch") == batch).drop("batch")


def confirmed_history(spark, path: str) -> DataFrame:
    """Price history of all confirmed imports."""
    return committed(spark, f"{path}/history", _parse_datatype_string(HISTORY), records=f"{path}/catalog").drop("batch")


def confirmed_jobs(spark, path: str) -> DataFrame:
    """(job_id, status, counts) of all confirmed imports."""
    return commits(spark, f"{path}/catalog", JOB_FIELDS).drop("batch", "attempt")


def new_version(versions: DataFrame, uploads: DataFrame, order: str | None = None) -> DataFrame:
    """Uploads (filename, file_hash) become the next versions of their file, in order, and the
    last of a file its only active one; all earlier are deactivated.  Uploads whose hash
    is known, or came before in the same batch, are rejected (left out).  ``order`` is a
    column of the uploads; without it they go by name and hash."""
    place = F.struct(*([order] if order else []), "filename", "file_hash")
    once = uploads.groupBy("file_hash").agg(F.min(F.struct(place.alias("place"), F.col("filename").alias("filename"))).alias("f")).select("file_hash", "f.filename", F.col("f.place").alias("place"))
    fresh = once.join(versions.select("file_hash").distinct(), "file_hash", "left_anti")
    top = versions.groupBy("filename").agg(F.max("version").alias("top"))
    by = Window.partitionBy("filename")
    ranked = fresh.withColumns({"n": F.row_number().over(by.orderBy("place")), "of": F.count("*").over(by)})
    added = ranked.join(top, "filename", "left").select("filename", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("version"), "file_hash", (F.col("n") == F.col("of")).alias("is_active"))
    touched = fresh.select("filename", F.lit(True).alias("_new")).distinct()
    old = versions.join(touched, "filename", "left").select("filename", "version", "file_hash", (F.col("is_active") & F.col("_new").isNull()).alias("is_active"))
    return old.unionByName(added)


def active_version(versions: DataFrame) -> DataFrame:
    return versions.where("is_active").groupBy("filename").agg(F.max("version").alias("version"))


def record_corrections(events: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with the product's article and name, rejected events without such a product)."""
    product = catalog.select(F.col("id").alias("selected_product_id"), F.col("article").alias("selected_article"), F.col("name").alias("selected_name"))
    return events.join(product, "selected_product_id"), events.join(product, "selected_product_id", "left_anti")


def supplier_dimension(suppliers: DataFrame, codes: DataFrame) -> DataFrame:
    """With ids for the codes that are new (supplier_code, supplier_name)."""
    new = codes.select("supplier_code", "supplier_name").dropDuplicates(["supplier_code"]).join(suppliers, "supplier_code", "left_anti")
    added = numbered(new, "supplier_code", "id", suppliers.agg(F.coalesce(F.max("id"), F.lit(0))))
    return suppliers.unionByName(added.select("id", "supplier_code", "supplier_name"))


def add_column(table: DataFrame, name: str, default: str) -> DataFrame:
    """Adds the column if it is missing, and fills its nulls."""
    return table.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in table.columns else F.lit(default))


def upsert_vectors(vectors: DataFrame, catalog: DataFrame, new: DataFrame, segment: str) -> DataFrame:
    """The vector table after one segment's active rows with a text took their new vectors
    (id, embedding); other segments stay."""
    rows = catalog.where(F.col("is_active") & (F.col("segment") == segment)).withColumn("text", X.embed_text(F.col("article"), F.col("name"))).where("text <> ''")
    fresh = rows.join(new, "id").select("id", "segment", "embedding", "article", "name")
    old = vectors.join(fresh.select("id"), "id", "left_anti")
    return old.unionByName(fresh.select(*vectors.columns))
