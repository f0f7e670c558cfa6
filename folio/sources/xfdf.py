"""Form data as XML: fields and annotations to and from DataFrames with Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = ["text", "highlight", "underline", "strikeout", "freetext", "square", "circle", "ink"]


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """A row for each field of the files below ``path``: path, name, values. Nested fields have qualified names."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return fields_of(files)


def fields_of(files: DataFrame) -> DataFrame:
    """Fields of column ``xml``; a file with a document type is refused, as one without fields it has no rows."""
    safe = files.where(~F.col("xml").rlike("(?i)<!DOCTYPE"))
    parsed = safe.withColumn("x", F.from_xml("xml", "fields struct<field:array<struct<_name:string,value:array<string>,field:array<struct<_name:string,value:array<string>>>>>>"))
    top = parsed.select("path", F.explode("x.fields.field").alias("f"))
    own = top.where("f.value is not null").select("path", F.col("f._name").alias("name"), F.col("f.value").alias("values"))
    nested = top.select("path", F.col("f._name").alias("parent"), F.explode("f.field").alias("g")).select("path", F.concat_ws(".", "parent", "g._name").alias("name"), F.col("g.value").alias("values"))
    return own.unionByName(nested)


def annotations_of(files: DataFrame) -> DataFrame:
    """Annotations of column ``xml``: path, subtype, page, name, title, contents."""
    shape = "_page:int,_name:string,_title:string,contents:string"
    schema = "annots struct<" + ",".join(f"{a}:array<struct<{shape}>>" for a in ANNOTATIONS) + ">"
    parsed = files.where(~F.col("xml").rlike("(?i)<!DOCTYPE")).withColumn("x", F.from_xml("xml", schema))
    kinds = [F.transform(F.coalesce(F.col(f"x.annots.{a}"), F.expr(f"cast(array() as array<struct<{shape}>>)")), _tagged(a)) for a in ANNOTATIONS]
    return parsed.select("path", F.explode(F.concat(*kinds)).alias("a")).select("path", "a.subtype", F.col("a.page").alias("page"), F.col("a.name").alias("name"), F.col("a.title").alias("title"), F.col("a.contents").alias("contents"))


def _tagged(subtype: str):
    return lambda n: F.struct(F.lit(subtype).alias("subtype"), n["_page"].alias("page"), n["_name"].alias("name"), n["_title"].alias("title"), n["contents"].alias("contents"))


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def to_xml(fields: DataFrame, key: str) -> DataFrame:
    """One XML text for each ``key`` from rows (name, values), in the order of names."""
    values = F.array_join(F.transform("values", lambda v: F.concat(F.lit("<value>"), _escaped(v), F.lit("</value>"))), "")
    element = F.concat(F.lit('<field name="'), _escaped(F.col("name")), F.lit('">'), values, F.lit("</field>"))
    grouped = fields.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", element.alias("e")))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: x["e"]), "")
    return grouped.select(key, F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'), body, F.lit("</fields></xfdf>")).alias("xml"))
