"""Column normalisation (N1-N9) and schema handling.

All rules are native ``Column`` expressions, so a whole table is normalised
in one projection inside whole-stage codegen. Strict rules raise through
``raise_error`` (the job fails, as the reference's converters throw); the
lenient rules use ``try_*`` functions and leave the cell null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats and the rejection message of an unparseable date.
INVALID_DATETIME_MESSAGE = "Invalid datetime provided; please make sure it's a valid UTC datetime"
GUID_PATTERN = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
# yyyy-MM-ddTHH:mm:ss.fffffffZ (seven fraction digits; Spark keeps six)
TICKS_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'"
TICKS_TIMESTAMP_OUT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _canonical_text(c: Column) -> Column:
    """Lower case without the white space around, line breaks included."""
    return F.lower(F.regexp_replace(c, r"\A\s+|\s+\z", ""))


# N1 ------------------------------------------------------------------------
def norm_guid(col, name: str = "id") -> Column:
    """Text to canonical id: null/empty -> null, valid -> lower case, else error."""
    c = _c(col)
    canon = _canonical_text(c)
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(canon.rlike(GUID_PATTERN), canon)
            .otherwise(F.raise_error(F.concat(F.lit(f"invalid guid in {name}: "), c))
                       .cast("string")))


def try_norm_guid(col) -> Column:
    """Lenient N1 (N6): an unparseable id becomes null."""
    c = _c(col)
    canon = _canonical_text(c)
    return F.when(canon.rlike(GUID_PATTERN), canon)


# N2 ------------------------------------------------------------------------
def _strict_int(text: Column, what: str) -> Column:
    """``text`` as int, failing the job on text that is not an int (ANSI on or off)."""
    parsed = text.try_cast("int")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid {what}: "), text)).cast("int"))


def norm_int(col) -> Column:
    """Text to int: null/empty -> null; anything else must parse (blank is invalid)."""
    return _strict_int(_empty_to_null(_c(col)), "integer")


def try_norm_int(col) -> Column:
    return _empty_to_null(_c(col)).try_cast("int")


# N3 ------------------------------------------------------------------------
def int_to_bool(col) -> Column:
    """Int to bool as ``> 0``; null stays null."""
    return _c(col) > 0


def bool_to_int(col) -> Column:
    """Bool to int; null -> 0."""
    return F.coalesce(_c(col).cast("int"), F.lit(0))


# N4 ------------------------------------------------------------------------
def norm_timestamp(col) -> Column:
    """Exact ``yyyy-MM-ddTHH:mm:ss.fffffffZ`` text to timestamp; null/empty -> null."""
    c = _empty_to_null(_c(col))
    parsed = F.try_to_timestamp(c, F.lit(TICKS_TIMESTAMP_FORMAT))
    return (F.when(c.isNull(), F.lit(None).cast("timestamp"))
            .when(parsed.isNotNull(), parsed)
            .otherwise(F.raise_error(F.concat(F.lit("invalid timestamp: "), c))
                       .cast("timestamp")))


def format_timestamp(col) -> Column:
    """Timestamp to the seven-digit text form."""
    return F.date_format(_c(col), TICKS_TIMESTAMP_OUT_FORMAT)


# N5 ------------------------------------------------------------------------
def int_to_reference(col) -> Column:
    """Int column served as a JSON string."""
    return _c(col).cast("string")


def reference_to_int(col) -> Column:
    """Null, empty or whitespace -> null; otherwise must parse as int."""
    c = _c(col)
    text = F.when(c.isNull() | c.rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(c)
    return _strict_int(text, "reference")


# N6 ------------------------------------------------------------------------
def lenient(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Lenient variant of a strict rule, for the rules that have one."""
    mapping = {norm_guid: try_norm_guid, norm_int: try_norm_int,
               norm_timestamp: lambda c: F.try_to_timestamp(_empty_to_null(_c(c)),
                                                            F.lit(TICKS_TIMESTAMP_FORMAT))}
    return mapping[rule]


def reject_counts(df: DataFrame, pairs: Mapping[str, Column]) -> DataFrame:
    """Per column: cells that were present but did not convert (one-row aggregate)."""
    return df.agg(*[F.count_if(F.col(raw).isNotNull() & (F.col(raw) != "") & typed.isNull())
                    .alias(f"{raw}_rejects") for raw, typed in pairs.items()])


# N7 ------------------------------------------------------------------------
def sanitise_id(col) -> Column:
    """Strip CR and LF."""
    return F.translate(_c(col), "\r\n", "")


# N8 ------------------------------------------------------------------------
def decode_period(col) -> Column:
    """URL-decode a period label (``+`` is a space)."""
    return F.url_decode(_c(col))


# N9 ------------------------------------------------------------------------
def parse_utc_date(col) -> Column:
    """Parse a date text as UTC; unparseable -> null (route to rejects)."""
    return F.try_to_timestamp(_c(col))


def split_parsed(df: DataFrame, col: str, out: str,
                 message: str = INVALID_DATETIME_MESSAGE) -> tuple[DataFrame, DataFrame]:
    """Good rows with the parsed value, and rejects (a null date too) with a message."""
    parsed = df.withColumn(out, parse_utc_date(col))
    good = parsed.filter(F.col(out).isNotNull())
    bad = parsed.filter(F.col(out).isNull()) \
        .drop(out).withColumn("error", F.lit(message))
    return good, bad


# Whole-table job -------------------------------------------------------------
def normalise_table(df: DataFrame, rules: Mapping[str, Callable[[Column], Column]],
                    keep_others: bool = True) -> DataFrame:
    """Apply ``{column: rule}`` in one projection; other columns pass through."""
    exprs = []
    for name in df.columns:
        if name in rules:
            exprs.append(rules[name](F.col(name)).alias(name))
        elif keep_others:
            exprs.append(F.col(name))
    return df.select(*exprs)


# S2 ------------------------------------------------------------------------
_DEFAULTS = {
    T.BooleanType: False, T.IntegerType: 0, T.LongType: 0, T.ShortType: 0,
    T.ByteType: 0, T.DoubleType: 0.0, T.FloatType: 0.0,
}


def type_default(dtype: T.DataType) -> Column:
    for cls, value in _DEFAULTS.items():
        if isinstance(dtype, cls):
            return F.lit(value).cast(dtype)
    return F.lit(None).cast(dtype)


def _converted(df: DataFrame, target: T.StructType) -> dict[str, tuple[str, Column]]:
    """Target field -> (source column, lenient conversion), for the fields that need one."""
    by_lower = {c.lower(): c for c in df.columns}
    found = {f.name: (by_lower[f.name.lower()], f.dataType) for f in target.fields if f.name.lower() in by_lower}
    return {name: (src, F.col(f"`{src}`").try_cast(kind)) for name, (src, kind) in found.items()
            if df.schema[src].dataType != kind}


def reject_rows(df: DataFrame, target: T.StructType, keys: list[str]) -> DataFrame:
    """One row per cell that ``align_schema`` would default: ``keys``, ``column_name``, ``value``.

    One pass without a shuffle; a row without a bad cell gives none.
    """
    cells = [F.struct(F.lit(name).alias("column_name"), F.col(f"`{src}`").cast("string").alias("value"),
                      (F.col(f"`{src}`").isNotNull() & typed.isNull()).alias("bad"))
             for name, (src, typed) in _converted(df, target).items()]
    if not cells:
        return df.select(*keys, F.lit("").alias("column_name"), F.lit("").alias("value")).limit(0)
    bad = F.filter(F.array(*cells), lambda c: c["bad"])
    return df.select(*keys, F.explode(bad).alias("_c")).select(*keys, "_c.column_name", "_c.value")


def align_schema(df: DataFrame, target: T.StructType, lenient_cells: bool = True,
                 keep: tuple[str, ...] = (), rejects: Observation | None = None) -> DataFrame:
    """Select ``target``'s fields from ``df`` by case-insensitive name.

    Extra columns are dropped; a missing column, or a null cell of a
    non-nullable field, takes the type default. With ``lenient_cells`` a
    cell that cannot be converted keeps the default too (N6) instead of
    failing the job; ``rejects`` then holds, after the first action on the
    result, the number of such cells per field (fields that need no
    conversion have none) and ``rows``, counted in the same pass.
    """
    if rejects is not None:
        df = df.observe(rejects, F.count(F.lit(1)).alias("rows"), *[
            F.count_if(F.col(f"`{src}`").isNotNull() & typed.isNull()).alias(name)
            for name, (src, typed) in _converted(df, target).items()])
    by_lower = {c.lower(): c for c in df.columns}
    exprs = []
    for field in target.fields:
        src = by_lower.get(field.name.lower())
        if src is None:
            expr = type_default(field.dataType) if not field.nullable else F.lit(None).cast(field.dataType)
        else:
            col = F.col(f"`{src}`")
            same = df.schema[src].dataType == field.dataType
            expr = col if same else (col.try_cast(field.dataType) if lenient_cells
                                     else col.cast(field.dataType))
            if not field.nullable:
                expr = F.coalesce(expr, type_default(field.dataType))
        exprs.append(expr.alias(field.name))
    return df.select(*exprs, *[F.col(k) for k in keep if k in df.columns])


# S3 ------------------------------------------------------------------------
def evolve_schema(df: DataFrame, additions: Mapping[str, T.DataType]) -> DataFrame:
    """Add each column as a typed null only when it is absent (additive evolution)."""
    present = {c.lower() for c in df.columns}
    missing = {n: F.lit(None).cast(t) for n, t in additions.items() if n.lower() not in present}
    return df.withColumns(missing) if missing else df


def union_vintages(*frames: DataFrame) -> DataFrame:
    """Union tables of different schema vintages by name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
