"""Reading and writing the JSON documents: explicit schemas, one DataFrame per collection, closed key sets."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "struct<id:string,name:string,summary:string,sourceIds:array<string>>"
CATALOG = (
    "schemaVersion string, generatedAt string, sources array<struct<id:string,url:string,pageKind:string,title:string,retrievedAt:string>>, "
    f"productFamilies array<{ENTITY}>, products array<struct<id:string,name:string,summary:string,familyId:string,sourceIds:array<string>>>, solutions array<{ENTITY}>, useCases array<{ENTITY}>, "
    "relationships array<struct<type:string,fromId:string,toId:string,sourceIds:array<string>>>"
)
COLLECTIONS = ("sources", "productFamilies", "products", "solutions", "useCases", "relationships")


GROUNDED = "sourceUrl:string,verifiedAt:string"
CURATED = (
    f"schemaVersion string, products array<struct<productId:string,roleKo:string,placements:array<struct<lane:string,layer:string>>,{GROUNDED}>>, "
    f"compositions array<struct<solutionId:string,productIds:array<string>,{GROUNDED}>>, "
    "pricing array<struct<productId:string,tiers:array<struct<id:string,name:string,monthlyUsd:double,noteKo:string,featuresKo:array<string>,"
    "limits:array<struct<metric:string,included:double,per:string,labelKo:string,noteKo:string>>,"
    f"meters:array<struct<metric:string,included:double,per:string,overage:struct<usd:double,perUnits:double>,labelKo:string>>>>,{GROUNDED}>>, "
    "learningNotes array<struct<productId:string,whyKo:string,misconceptionKo:string,customerQuestionKo:string,analogyKo:string,se:struct<archKo:string,opsKo:string,limitsKo:string>,"
    "ae:struct<pitchKo:string,valueKo:string,objections:array<struct<q:string,a:string>>>,battlecard:array<struct<competitor:string,vsKo:string,grounding:string,sourceUrl:string>>,"
    f"{GROUNDED}>>, solutionNotes array<struct<solutionId:string,oneLinerKo:string,whyKo:string,misconceptionKo:string,customerQuestionKo:string,"
    f"boundariesKo:array<struct<solutionId:string,noteKo:string>>,seAngleKo:string,aeAngleKo:string,{GROUNDED}>>, "
    f"scenarios array<struct<id:string,titleKo:string,situationKo:string,productIds:array<string>,talkTrackKo:string,{GROUNDED}>>, narration array<struct<productId:string,captionKo:string,{GROUNDED}>>"
)


def read_document(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """One row of arrays; a document that isn't JSON has nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def collection(document: DataFrame, name: str) -> DataFrame:
    """A collection as rows, with ``ord`` for its authored order."""
    return document.select(F.posexplode(name).alias("ord", "item")).select("ord", "item.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text and problem of each document of a folder or file: a text that is no JSON has the stage at which it failed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("problem", F.when(F.try_parse_json("text").isNull(), "parse"))


def unknown_in(value: Column, kind: T.DataType, at: Column) -> Column:
    """The paths of what an object of a variant has and its type hasn't, at any depth."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(F.flatten(F.transform(items, lambda x, i: unknown_in(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if not isinstance(kind, T.StructType):
        return none
    inner = lambda name: F.when(at == "", name).otherwise(F.concat(at, F.lit("."), name))
    keys = F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), none)
    own = F.transform(F.array_except(keys, F.array(*map(F.lit, kind.fieldNames()))), inner)
    nested = [unknown_in(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType, inner(F.lit(f.name))) for f in kind if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    return F.concat(own, *nested)


def unknown_keys(texts: DataFrame, schema: str = CATALOG, text: str = "text") -> DataFrame:
    """code, path, message, ord of each key that a document (a row of JSON text) has and the schema hasn't, at any depth."""
    kind = T.StructType.fromDDL(schema)
    paths = texts.select(F.posexplode(unknown_in(F.try_parse_json(F.col(text)), kind, F.lit(""))).alias("ord", "path"))
    key = F.regexp_extract("path", r"([^.]*)$", 1)
    return paths.select(F.lit("invalid-shape").alias("code"), "path", F.concat(F.lit('Unrecognized key: "'), key, F.lit('"')).alias("message"), F.col("ord").cast("long").alias("ord"))


def load(spark: SparkSession, path: str, schema: str, check: Callable[[DataFrame], DataFrame], collections: tuple[str, ...]) -> tuple[str, DataFrame | None]:
    """What became of reading a document, and the document: fetch-error, invalid-data (no JSON, or issues), empty (all
    collections are) or success. ``check`` gives the issues of the document."""
    try:
        text = read_texts(spark, path)
        if text.isEmpty():
            return "fetch-error", None
    except AnalysisException:
        return "fetch-error", None
    document = read_document(spark, path, schema)
    if not text.where("problem IS NOT NULL").isEmpty() or not unknown_keys(text, schema).isEmpty() or not check(document).isEmpty():
        return "invalid-data", None
    return ("empty" if is_empty(document, collections).first().empty else "success"), document


def is_empty(document: DataFrame, collections: tuple[str, ...] = COLLECTIONS) -> DataFrame:
    """One row ``empty``: whether all collections are."""
    n = sum((F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)) for c in collections), F.lit(0))
    return document.select((n == 0).alias("empty"))


def serialize(document: dict) -> str:
    """Two spaces of indent, keys in construction order, a newline at the end."""
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def write_atomically(body: str, target: str) -> None:
    """A small document: staged beside the target, synced, renamed; on failure the target is as it was."""
    fd, staged = tempfile.mkstemp(prefix=".staged-", dir=os.path.dirname(os.path.abspath(target)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, target)
    except BaseException:
        os.unlink(staged)
        raise


def version_issues(document: DataFrame, version: str = "1") -> DataFrame:
    """An issue if the document's version is not the one that is read here."""
    wrong = document.where(~F.coalesce(F.col("schemaVersion") == version, F.lit(False)))
    return wrong.select(F.lit("invalid-shape").alias("code"), F.lit("schemaVersion").alias("path"), F.lit(f'Invalid input: expected "{version}"').alias("message"), F.lit(0).cast("long").alias("ord"))


def write_catalog(catalog: dict[str, DataFrame], target: str, generated_at: str, version: str = "1") -> None:
    """A catalog's collections, with ``ord``, as the one document that readers load: a file of the size of a site's
    directory. Large collections are tables; write these as Parquet."""
    body = {"schemaVersion": version, "generatedAt": generated_at}
    for name, rows in catalog.items():
        body[name] = [r.asDict(recursive=True) for r in rows.orderBy("ord").drop("ord").toLocalIterator()]
    write_atomically(serialize(body), target)
