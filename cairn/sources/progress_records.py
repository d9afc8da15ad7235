"""Progress records as JSON texts: structural validation, export, and a store that a stream writes to.

A record that doesn't have the expected structure is discarded as a whole. Older records may lack the kind of a session
(it was verification), reviews and opened ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.dimensions import STATUS_RANK

NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
REVIEW = "struct<last:string,streak:double>"
ENTRY = "struct<date:string,area:string,kind:string,correct:double,total:double>"


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(kind), F.lit(False))


def _string(v: Column) -> Column:
    return _is(v, "^STRING$")


def parse_records(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, valid, states (map of node to status), reviews, opened, log, sessions of each row's text. Invalid and null texts
    have empty collections."""
    v = F.try_parse_json(F.col(text))
    parts = rows.select(F.col(key), v.alias("_v")).select(key, "_v", *(_get(F.col("_v"), c).alias(f"_{c}") for c in ("schemaVersion", "nodeStates", "nodeReviews", "openedIds", "recallLog", "sessionLog")))
    as_map = lambda c: F.try_variant_get(c, "$", "map<string,variant>")
    as_array = lambda c: F.try_variant_get(c, "$", "array<variant>")
    parts = parts.select(key, "_schemaVersion", "_nodeReviews", "_openedIds", as_map(F.col("_nodeStates")).alias("s"), as_map(F.col("_nodeReviews")).alias("r"), as_array(F.col("_openedIds")).alias("o"), as_array(F.col("_recallLog")).alias("l"), as_array(F.col("_sessionLog")).alias("d"))
    every = lambda items, test: F.coalesce(F.forall(items, test), F.lit(False))
    status = lambda x: _string(x) & F.coalesce(F.try_variant_get(x, "$", "string").isin(*STATUS_RANK), F.lit(False))
    review = lambda x: _string(_get(x, "last")) & _is(_get(x, "streak"), NUMBER)
    kind = lambda x: F.coalesce(_get(x, "kind", "string"), F.lit("verify"))
    entry = lambda x: _string(_get(x, "date")) & _string(_get(x, "area")) & _is(_get(x, "correctSlots"), NUMBER) & _is(_get(x, "totalSlots"), NUMBER) & kind(x).isin("practice", "verify")
    valid = (
        _is(F.col("_schemaVersion"), NUMBER) & F.coalesce(F.try_variant_get("_schemaVersion", "$", "double") == 1, F.lit(False)) & every(F.map_values("s"), status)
        & every("l", entry) & every("d", _string) & (F.col("_nodeReviews").isNull() | every(F.map_values("r"), review)) & (F.col("_openedIds").isNull() | every("o", _string))
    )
    texts = lambda items: F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    made = lambda x: F.struct(_get(x, "date", "string").alias("date"), _get(x, "area", "string").alias("area"), kind(x).alias("kind"), _get(x, "correctSlots", "double").alias("correct"), _get(x, "totalSlots", "double").alias("total"))
    held = lambda c, kind: F.coalesce(F.when(F.col("valid"), c), F.expr(kind))
    parts = parts.withColumn("valid", valid)
    return parts.select(
        key, "valid",
        held(F.transform_values("s", lambda _, x: F.try_variant_get(x, "$", "string")), "cast(map() AS map<string,string>)").alias("states"),
        held(F.transform_values("r", lambda _, x: F.struct(_get(x, "last", "string").alias("last"), _get(x, "streak", "double").alias("streak"))), f"cast(map() AS map<string,{REVIEW}>)").alias("reviews"),
        held(texts("o"), "cast(array() AS array<string>)").alias("opened"),
        held(F.transform("l", made), f"cast(array() AS array<{ENTRY}>)").alias("log"),
        held(texts("d"), "cast(array() AS array<string>)").alias("sessions"),
    )


def imported(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and what importing its text does: imported, or invalid (the record that was there stays)."""
    return parse_records(rows, key, text).select(key, F.when(F.col("valid"), "imported").otherwise("invalid").alias("result"))


def export_json(records: DataFrame, key: str, extras: list[str]) -> DataFrame:
    """key and the record as JSON text, with the columns in ``extras`` after it; what is null is left out."""
    log = F.transform("log", lambda e: F.struct(e["date"].alias("date"), e["area"].alias("area"), e["kind"].alias("kind"), e["correct"].alias("correctSlots"), e["total"].alias("totalSlots")))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("states").alias("nodeStates"), F.col("reviews").alias("nodeReviews"), F.col("opened").alias("openedIds"), log.alias("recallLog"), F.col("sessions").alias("sessionLog"), *extras)
    return records.select(key, F.to_json(body, {"pretty": "true"}).alias("body"))


#: Folders of batches that a store holds before they are put together.
MOST_BATCHES = 16


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The number of the last whole snapshot (-1 if there is none) and those of the batches after it, by the file system that the
    path is on. A folder counts when the marker that Spark writes last is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"snapshot": [], "batch": []}
    for status in fs.listStatus(at) if fs.exists(at) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    last = max(found["snapshot"], default=-1)
    return last, sorted(n for n in found["batch"] if n > last)


def store(batch: DataFrame, number: int, path: str, key: str, most: int = MOST_BATCHES) -> None:
    """Puts a batch of states under its number; one that is run again replaces itself. When ``most`` batches have come since the last
    snapshot, the last state of each key becomes the next one; only when that is whole does what it replaces go. So what
    is kept and read is bounded, whenever a run is killed."""
    spark = batch.sparkSession
    last, _ = _folders(spark, path)
    if number <= last:  # it is in the snapshot
        return
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    last, after = _folders(spark, path)
    if len(after) < most:
        return
    kept(spark, path, key).write.mode("overwrite").parquet(f"{path}/snapshot={after[-1]}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        kind, _, n = status.getPath().getName().partition("=")
        if (kind == "batch" and int(n) <= after[-1]) or (kind == "snapshot" and int(n) < after[-1]):
            fs.delete(status.getPath(), True)


def keep(stream: DataFrame, path: str, checkpoint: str, key: str = "node"):
    """A query that stores each batch of a stream of states."""
    return stream.writeStream.foreachBatch(lambda batch, number: store(batch, number, path, key)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, path: str, key: str, initial: DataFrame | None = None) -> DataFrame:
    """The last stored state of each key: of the snapshot and the few batches after it. Where nothing is stored yet, ``initial``."""
    last, after = _folders(spark, path)
    parts = [(last, f"{path}/snapshot={last}")] * (last >= 0) + [(n, f"{path}/batch={n}") for n in after]
    if not parts:
        if initial is None:
            raise FileNotFoundError(f"no states at {path}")
        return initial
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(p).withColumn("_batch", F.lit(n)) for n, p in parts))
    columns = [c for c in rows.columns if c not in (key, "_batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("_s"))
    return newest.select(key, *(F.col(f"_s.{c}").alias(c) for c in columns))
