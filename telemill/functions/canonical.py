"""Row hashes that any engine with SHA-256 can check.

Each value is told as text by its type, with its length before it, so that no two rows read alike:

* null: ``-``; text: itself; whole numbers and booleans: as written; decimals: as written;
* floating point: the nearest whole number of millionths, half away from zero, below nine million millions; beyond,
  the nearest whole number; ``nan``, ``inf`` and ``-inf``;
* dates: days since 1970-01-01; times: microseconds since then; bytes: hexadecimal digits in lower case.

A row's hash is the first fifteen hexadecimal digits of the SHA-256 of its texts in a row, as a whole number of 60 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums of row hashes are told modulo this prime, 2^61 - 1.
MODULUS = (1 << 61) - 1
MOST_MILLIONTHS = 9e12


def canonical_text(c: Column, kind: T.DataType) -> Column:
    """A value as text; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        fine = F.round(F.when(F.abs(x) < MOST_MILLIONTHS, x) * F.lit(1e6), 0).cast("bigint").cast("string")
        far = F.when(F.abs(x) < 1e37, x).cast("decimal(38,0)").cast("string")
        odd = F.when(F.isnan(x), "nan").when(x > 0, "inf").otherwise("-inf")
        return F.when(c.isNull(), None).when(F.isnan(x), "nan").otherwise(F.coalesce(fine, far, odd))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType, T.StringType)):
        return c.cast("string")
    raise TypeError(f"no canonical text for {kind.simpleString()}")


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    parts = []
    for name in columns or df.columns:
        text = canonical_text(F.col(name), df.schema[name].dataType)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.conv(F.substring(F.sha2(row_text(df, columns), 256), 1, 15), 16, 10).cast("bigint")


# ---- the same in SQL, for engines that count text in code points and hash it as UTF-8


def text_sql(name: str, kind: str) -> str:
    """``kind``: number (floating point), time, date, or plain."""
    text = {
        "number": f"CAST(CAST(round({name} * 1000000.0, 0) AS BIGINT) AS VARCHAR)",
        "time": f"CAST(epoch_us({name}) AS VARCHAR)",
        "date": f"CAST({name} - DATE '1970-01-01' AS VARCHAR)",
        "plain": f"CAST({name} AS VARCHAR)",
    }[kind]
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def hash_sql(columns: dict[str, str]) -> str:
    row = " || ".join(text_sql(name, kind) for name, kind in columns.items())
    return f"CAST('0x' || substr(sha256({row}), 1, 15) AS BIGINT)"
