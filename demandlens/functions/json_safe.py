"""Values of any shape as JSON: typed columns made safe, and free JSON text read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def safe(value: Column, kind: Y.DataType) -> Column:
    """The value with dates and times as ISO texts, decimals as doubles and doubles that are no numbers as null, at every depth; keys of maps are texts."""
    if isinstance(kind, Y.StructType):
        if not kind.fields:
            return value
        return F.when(value.isNotNull(), F.struct(*[safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, Y.ArrayType):
        return F.transform(value, lambda x: safe(x, kind.elementType))
    if isinstance(kind, Y.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, Y.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, Y.TimestampNTZType):
        return iso(value)
    if isinstance(kind, Y.TimestampType):
        return F.concat(iso(F.to_timestamp_ntz(F.to_utc_timestamp(value, F.current_timezone()).cast("string"))), F.lit("+00:00"))
    if isinstance(kind, Y.DecimalType):
        return value.cast("double")
    if isinstance(kind, (Y.DoubleType, Y.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, Y.BinaryType):
        return F.base64(value)
    return value


def iso(moment: Column) -> Column:
    """ISO 8601 of a time without zone; microseconds only where there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def json_text(rows: DataFrame, column: str) -> Column:
    """A struct, array or map column of ``rows`` as JSON text, whatever it holds; nulls in structs are written."""
    return F.to_json(safe(F.col(column), rows.schema[column].dataType), {"ignoreNullFields": "false"})


def leaves(rows: DataFrame, key: str, text: str, most: int = 64) -> DataFrame:
    """(key, path, kind, value) of every value of a JSON text that holds no others, and of empty objects and lists; texts that are no JSON give no rows.

    Objects and lists are opened level by level as VARIANT; a level without any ends it, and deeper than ``most`` levels is an error.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key), F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    out = None
    for _ in range(most):
        kinds = level.withColumn("kind", F.schema_of_variant("v"))
        nested = (F.startswith("kind", F.lit("OBJECT<")) & (F.col("kind") != "OBJECT<>")) | (F.startswith("kind", F.lit("ARRAY<")) & (F.expr("try_variant_get(v, '$[0]', 'variant')").isNotNull()))
        done = kinds.where(~nested).select(key, "path", F.when(F.startswith("kind", F.lit("ARRAY<")), "ARRAY<>").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "VOID", F.lit(None)).otherwise(F.col("v").cast("string")).alias("value"))
        out = done if out is None else out.unionByName(done)
        open_ = kinds.where(nested)
        if open_.isEmpty():
            return out
        step = spark.sql(f"SELECT o.{key}, concat(o.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v FROM {{rows}} o, LATERAL variant_explode(o.v) e", rows=open_)
        level = step
    raise ValueError(f"JSON deeper than {most} levels")
