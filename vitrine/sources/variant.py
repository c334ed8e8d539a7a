"""Catalog scan through VARIANT: one read, no schema given, nothing lost.

A line is parsed once into a VARIANT. Typed fields are taken from it by path, so a field that is a number in
one record and text in the next is read as what the catalog wants; fields the catalog does not know stay
beside them, and lines that are no record are kept as text. The schema that a source really has
is an aggregate over the same parsed column, not a pass before the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CATALOG_SCHEMA

RECORD, BROKEN, EXTRAS = "record", "broken", "extras"


def read_variant(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record`` (VARIANT) and ``broken`` (text) of every line that is not blank.

    A line that is no JSON object (cut short, an array, a bare value) has a NULL record and is kept whole in
    ``broken``. Nothing is inferred: the plan reads the source once, when the result is used.
    """
    # the type is asked of the parsed value, so the line is parsed once
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json("value").alias("parsed"))
    is_record = _is_object("parsed")
    return parsed.select(
        F.when(is_record, F.col("parsed")).alias(RECORD), F.when(~is_record, F.col("value")).alias(BROKEN)
    )


def _path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _is_object(value: Column | str, keys: tuple[str, ...] = ()) -> Column:
    """Whether there is an object; its fields are not looked into, as they are for the text of a schema."""
    return F.try_variant_get(value, _path(keys), "struct<>").isNotNull()


def _keys(value: Column | str, keys: tuple[str, ...] = ()) -> Column:
    """The names of an object's fields, NULL for anything else; no value is copied (what is no array is NULL as one)."""
    return F.map_keys(F.try_variant_get(value, _path(keys), "map<string,array<boolean>>"))


def typed(schema: T.DataType, value: Column) -> Column:
    """``value``, read from a record as ``schema`` at once, with a struct for every object that is missing or of the wrong type. A
    leaf that cannot be cast is NULL by itself and never its neighbours."""
    if isinstance(schema, T.StructType):
        return F.struct(*[typed(f.dataType, value[f.name]).alias(f.name) for f in schema.fields])
    return value


def _unknown(schema: T.StructType, keys: tuple[str, ...], record: str) -> tuple[Column, list[Column]]:
    """The fields of the object at ``keys`` that ``schema`` lacks, as a map, and those of the objects in it."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    fields = F.try_variant_get(record, _path(keys), "map<string,variant>")
    here = F.map_filter(fields, lambda k, _: ~F.array_contains(known, k))
    if keys:
        prefix = F.lit(".".join(keys) + ".")
        here = F.transform_keys(here, lambda k, _: F.concat(prefix, k))
    inner = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            one, more = _unknown(f.dataType, (*keys, f.name), record)
            inner += [one, *more]
    return here, inner


def variant_records(df: DataFrame, schema: T.StructType = CATALOG_SCHEMA, record: str = RECORD) -> DataFrame:
    """The typed fields of ``schema``, ``extras`` (JSON text of the fields it does not name, by dotted path; NULL without any)
    and ``broken``. Fields of a nested object that has the wrong type (text where an object belongs) are NULL;
    that value itself is then an extra, so no input is dropped silently."""
    first, inner = _unknown(schema, (), record)
    empty = F.create_map().cast("map<string,variant>")
    extras = F.map_concat(*[F.coalesce(m, empty) for m in (first, *inner, *_misplaced(schema, (), record))])
    # few records have extras: the values are copied into maps only where names or types say so
    extras = F.when(_differs(schema, (), record), F.when(F.size(extras) > 0, F.to_json(extras)))
    read = df.select(F.try_variant_get(record, "$", schema.simpleString()).alias("whole"), extras.alias(EXTRAS), BROKEN)
    return read.select(*[typed(f.dataType, F.col("whole")[f.name]).alias(f.name) for f in schema.fields], EXTRAS, BROKEN)


def _differs(schema: T.StructType, keys: tuple[str, ...], record: str) -> Column:
    """Whether the object at ``keys`` or one in it has a field that ``schema`` lacks, or is none."""
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    out = F.coalesce(F.size(F.array_except(_keys(record, keys), names)) > 0, F.lit(True))
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out = out | _differs(f.dataType, (*keys, f.name), record)
    return out


def _misplaced(schema: T.StructType, keys: tuple[str, ...], record: str) -> list[Column]:
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            at = (*keys, f.name)
            value = F.try_variant_get(record, _path(at), "variant")
            wrong = value.isNotNull() & ~F.is_variant_null(value) & ~F.schema_of_variant(value).startswith("OBJECT")
            out.append(F.when(wrong, F.create_map(F.lit(".".join(at)), value)))
            out += _misplaced(f.dataType, at, record)
    return out


def variant_schema(df: DataFrame, record: str = RECORD) -> DataFrame:
    """One row: the merged schema of all records as text (``VARIANT`` where types disagree)."""
    return df.agg(F.schema_of_variant_agg(record).alias("schema"))


def field_types(df: DataFrame, record: str = RECORD, keys: list[str] | None = None) -> DataFrame:
    """``keys, path, type, n_records``: how often each field of the records, one object deep, has each type.

    What a merged schema hides: a field that is a number in most records and text in a few has two rows. Numbers
    are told apart as ``BIGINT``, ``DECIMAL`` and ``DOUBLE`` without their digits. Partial counts per
    (path, type) are combined in the map tasks, so the shuffle is as small as the list of fields.
    """
    keys, tvf = keys or [], df.sparkSession.tvf
    own = [F.struct(*keys).alias("own")] if keys else []
    records = df.filter(_is_object(record)).select(*own, F.col(record).alias("all"))
    top = records.lateralJoin(tvf.variant_explode(F.col("all").outer())).select(
        *(["own"] if keys else []), F.col("key").alias("at"), F.col("value").alias("whole"), _is_object("value").alias("inside")
    )
    # an object counts with the first of its fields; other values have none
    below = top.lateralJoin(tvf.variant_explode_outer(F.when(F.col("inside").outer(), F.col("whole").outer())))
    itself = F.struct(F.col("at").alias("path"), F.when(F.col("inside"), F.lit("OBJECT")).otherwise(_kind("whole")).alias("type"))
    field = F.struct(F.concat("at", F.lit("."), "key").alias("path"), _kind("value").alias("type"))
    met = F.when(F.col("key").isNull(), F.array(itself)).when(F.col("pos") == 0, F.array(itself, field)).otherwise(F.array(field))
    cells = below.select(*[F.col("own")[k].alias(k) for k in keys], F.explode(met).alias("cell"))
    return cells.groupBy(*keys, F.col("cell.path").alias("path"), F.col("cell.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n_records")
    )


def _kind(value: str) -> Column:
    """The type's name without digits, fields or elements."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)


# ---------------------------------------------------------------- drift across files

# Numbers widen to the right of this list; other types that differ widen to text.
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE"]


def file_fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, path, type, n_records``: :func:`field_types` of every file, in one job over all of them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias(RECORD))
    return field_types(lines.filter(_is_object(RECORD)), keys=["file"])


def file_fingerprints(fields: DataFrame) -> DataFrame:
    """``file, fingerprint, n_fields``: files with equal fingerprints have the same fields with the same types."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "path", "type")))
    return fields.groupBy("file").agg(F.md5(F.array_join(listed, ";")).alias("fingerprint"), F.count_distinct("path").alias("n_fields"))


def merged_fields(fields: DataFrame) -> DataFrame:
    """``path, type, n_files, types``: one type for each field over all files. Null values say nothing; numbers widen to the
    widest kind met, an object or array beside anything else stays ``VARIANT``, other mixtures are text."""
    known = fields.filter(F.col("type") != "VOID")
    met = known.groupBy("path").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.count_distinct("file").alias("n_files")
    )
    numbers = F.array(*[F.lit(t) for t in NUMBERS])
    all_numbers = F.size(F.array_except("types", numbers)) == 0
    nested = F.exists("types", lambda t: t.isin("OBJECT", "ARRAY"))
    widest = F.element_at(F.filter(numbers, lambda t: F.array_contains("types", t)), -1)
    one = F.size("types") == 1
    kind = F.when(one, F.col("types")[0]).when(all_numbers, widest).when(nested, F.lit("VARIANT")).otherwise(F.lit("STRING"))
    return met.select("path", kind.alias("type"), "n_files", "types")


def files_without(fields: DataFrame, expected: list[str]) -> DataFrame:
    """``file, path``: the expected fields that no record of a file has."""
    names = F.array(*[F.lit(p) for p in expected]).cast("array<string>")
    wanted = fields.select("file").distinct().select("file", F.explode(names).alias("path"))
    return wanted.join(fields.select("file", "path").distinct(), ["file", "path"], "left_anti")
