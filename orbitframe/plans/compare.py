"""Result columns in a form that compares equal across engines."""

from pyspark.sql import DataFrame, functions as F, types as T


def plain(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Timestamps to epoch milliseconds, doubles to ``digits`` decimals, dates,
    booleans and string arrays to text."""
    out = []
    for field in df.schema.fields:
        if columns and field.name not in columns:
            continue
        c = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_millis(c.cast("timestamp"))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(kind, (T.BooleanType, T.DateType)):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def r6(expression: str, name: str = "", digits: int = 6) -> str:
    """The same rounding in SQL, named after the column by default."""
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"
