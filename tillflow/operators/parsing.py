"""JSON text to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def parse_json(
    df: DataFrame, schema: str | T.StructType, value: str = "value", into: str = "j", broken: str | None = None
) -> DataFrame:
    """Add struct column ``into`` parsed from JSON text; bad text gives null fields.

    The struct comes out of a one-element array, which keeps later filters on it
    above the parsing; otherwise Spark would parse every text once for the
    filter and once more for the columns.
    """
    options = {"mode": "PERMISSIVE", **({"columnNameOfCorruptRecord": broken} if broken else {})}
    parsed = F.from_json(F.col(value).cast("string"), schema, options)
    return df.select("*", F.explode(F.array(parsed)).alias(into))


def _as_text(schema: T.StructType) -> T.StructType:
    """The same fields, with plain values read as text."""
    plain = lambda kind: kind if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else T.StringType()
    return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in schema])


def _typed(schema: T.StructType) -> list[Column]:
    nested = (T.StructType, T.ArrayType, T.MapType)
    return [
        F.col(f"j.{f.name}") if isinstance(f.dataType, nested)
        else F.col(f"j.{f.name}").try_cast(f.dataType).alias(f.name)
        for f in schema
    ]


def _parse_typed(df: DataFrame, ddl: str, key: str, value: str, also: str | None = None) -> tuple[DataFrame, list[Column], Column]:
    # Change records write numbers and times bare or quoted, depending on the
    # tool; both are read as text and then cast.
    schema = T.StructType.fromDDL(ddl)
    parsed = parse_json(df, _as_text(schema), value)
    usable = F.col(f"j.{key}").try_cast(schema[key].dataType).isNotNull()
    return parsed, _typed(schema), usable & F.col(f"j.{also}").isNotNull() if also else usable


def typed_rows(
    df: DataFrame,
    schema: str,
    key: str,
    value: str = "value",
    observe: str | None = None,
    keep: tuple[str, ...] = (),
    also: str | None = None,
) -> DataFrame:
    """Rows of ``schema`` parsed from JSON text, without those lacking ``key`` or field ``also``.

    ``observe`` names a metric with the counts of parsed and rejected rows.
    """
    parsed, columns, usable = _parse_typed(df, schema, key, value, also)
    if observe:
        parsed = parsed.observe(
            observe,
            F.count_if(usable).alias("parsed"),
            F.count_if(~usable).alias("rejected"),
        )
    return parsed.where(usable).select(*keep, *columns)


def rejected_rows(
    df: DataFrame, schema: str, key: str, value: str = "value", also: str | None = None
) -> DataFrame:
    """The raw text that ``typed_rows`` leaves out, for a table of its own."""
    parsed, _, usable = _parse_typed(df, schema, key, value, also)
    return parsed.where(~usable).drop("j")


BROKEN = "_broken"


def sorted_rows(df: DataFrame, schema: str, key: str, value: str = "value", also: str | None = None) -> DataFrame:
    """Every text with what it is read as: ``value, row, reason``, from one parse.

    ``row`` is null and ``reason`` says why where ``typed_rows`` would leave the text out.
    """
    fields = T.StructType.fromDDL(schema)
    # Text that is no JSON object is reported by the parser in a field of its own.
    parsed = parse_json(df.select(F.col(value).cast("string").alias("value")), T.StructType([*_as_text(fields), T.StructField(BROKEN, T.StringType())]), broken=BROKEN)
    reason = F.when(F.col("j").isNull() | F.col(f"j.{BROKEN}").isNotNull(), F.lit("no JSON object"))
    reason = reason.when(F.col(f"j.{key}").try_cast(fields[key].dataType).isNull(), F.lit(f"no {key}"))
    if also:
        reason = reason.when(F.col(f"j.{also}").isNull(), F.lit(f"no {also}"))
    marked = parsed.select("value", reason.alias("reason"), F.struct(*_typed(fields)).alias("row"))
    return marked.withColumn("row", F.when(F.col("reason").isNull(), F.col("row")))


def json_column(*columns: str | Column) -> Column:
    """Row (or the named columns) as JSON text with the column names as they are."""
    return F.to_json(F.struct(*(columns or ("*",))))
