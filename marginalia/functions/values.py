"""Small value rules shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# What counts as missing in a loosely typed record, as JSON.
NOTHING = ("null", "false", '""', "0", "0.0", "-0", "-0.0")


def truthy_or_null(column: Column, data_type: T.DataType) -> Column:
    """The value, or null where a loosely typed input counts as missing: ``''``, ``0``, ``false``.

    A variant is judged by the type its own row gives it.
    """
    if isinstance(data_type, T.VariantType):
        return F.when(~F.to_json(column).isin(*NOTHING), column)
    if isinstance(data_type, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(data_type, T.BooleanType):
        return F.when(column, column)
    if isinstance(data_type, T.NumericType):
        return F.when(column != 0, column)
    return column


def loose_text(column: Column, data_type: T.DataType) -> Column:
    """Text of a value, null where it counts as missing."""
    if isinstance(data_type, T.VariantType):
        # The same as below, but the test is written once instead of in every branch of ``as_text``.
        return F.when(truthy_or_null(column, data_type).isNotNull(), as_text(column, data_type))
    return as_text(truthy_or_null(column, data_type), data_type)


def as_text(column: Column, data_type: T.DataType) -> Column:
    """Text of a scalar; whole numbers are written without a fraction."""
    if isinstance(data_type, T.VariantType):
        decimal = F.try_variant_get(column, "$", "decimal(38,10)").cast("string")
        return F.when(
            F.schema_of_variant(column) == "DOUBLE", F.regexp_replace(decimal, r"\.?0+$", "")
        ).otherwise(F.try_variant_get(column, "$", "string"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (F.abs(column) < 1e15) & (column == F.floor(column))
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def round_half_up(column: Column) -> Column:
    """Nearest whole number; halves go up, also below zero."""
    return F.floor(column + F.lit(0.5))


def percent(column: Column) -> Column:
    return round_half_up(column * 100)


def share_of_max(count: Column, largest: Column) -> Column:
    """Whole percent of the largest count."""
    return round_half_up(count / largest * 100)


def sigmoid(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column))


def trashed(deleted_at="deleted_at") -> Column:
    """Whether a row is in the trash: any non-empty stamp counts.

    Written without ``coalesce``, so that Parquet can skip rows by it.
    """
    return F.col(deleted_at).isNotNull() & (F.col(deleted_at) != "")


def favorite(is_favorite="is_favorite") -> Column:
    return F.coalesce(F.col(is_favorite), F.lit(False))


#: More positions than an array can have.
POSITIONS = 1 << 31


def first_seen(seq, pos) -> Column:
    """(row, position in the row) as one sortable number, wide enough for any of both.

    A decimal and no struct: Spark takes its minimum in the hash map of an aggregation, a struct's only after a sort.
    """
    row = F.col(seq).cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(10,0)")
    return row + F.col(pos).cast("decimal(10,0)")


def deleted_at_label(deleted_at: Column, unknown="unknown", zone="UTC") -> Column:
    """Readable time of a trash stamp in a time zone; unreadable stamps are shown as they are."""
    utc = F.to_utc_timestamp(F.try_to_timestamp(deleted_at), F.current_timezone())
    shown = F.date_format(F.from_utc_timestamp(utc, zone), "yyyy/M/d HH:mm:ss")
    return F.when(F.coalesce(deleted_at, F.lit("")) == "", F.lit(unknown)).otherwise(F.coalesce(shown, deleted_at))


def node_radius(degree: Column) -> Column:
    return F.greatest(F.lit(8.0), F.lit(4.0) + F.sqrt(degree) * 4)


def node_label_offset(degree: Column) -> Column:
    return F.greatest(F.lit(10.0), F.lit(6.0) + F.sqrt(degree) * 4)


def node_label(title: Column) -> Column:
    cut = F.substring(title, 1, 10)
    return F.when(F.length(title) > 10, F.concat(cut, F.lit("..."))).otherwise(cut)


def link_width(value: Column) -> Column:
    return F.least(F.lit(4.0), F.greatest(F.lit(1.0), value))


def blend_mode(weight: Column) -> Column:
    """Name of a tf / tf-idf mix by the share of tf-idf in it."""
    return F.when(weight < 0.3, "tf").when(weight > 0.7, "tfidf").otherwise("blend")
