"""SQLite spellings as temporary SQL functions: JVM-side, inlined by the
optimizer, no Python in the plan. Spark keeps its own date() and time(), so
their texts are date_text() and time_text(); texts that pass the guard may call
date() and time(), which ``plans.dialect`` respells."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Strftime codes and the datetime patterns that they stand for.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}

_NUMBER = r"try_cast(regexp_extract(x, r'^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) as double)"

_DEFINITIONS = {
    "datetime(x STRING) RETURNS STRING": "date_format(try_cast(x as timestamp), 'yyyy-MM-dd HH:mm:ss')",
    "time_text(x STRING) RETURNS STRING": "date_format(try_cast(x as timestamp), 'HH:mm:ss')",
    "julianday(x STRING) RETURNS DOUBLE": "unix_seconds(try_cast(x as timestamp)) / 86400.0D + 2440587.5D",
    "date_text(x STRING) RETURNS STRING": "date_format(try_cast(x as date), 'yyyy-MM-dd')",
    # a number is what a text begins with, 0 if that is none
    "sqlite_int(x STRING) RETURNS BIGINT": "CASE WHEN x IS NOT NULL THEN coalesce(try_cast(regexp_extract(x, r'^\\s*([+-]?\\d+)\\s*$', 1) as bigint), try_cast(" + _NUMBER + " as bigint), 0) END",
    "sqlite_real(x STRING) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL THEN coalesce(" + _NUMBER + ", 0.0D) END",
    # a date as SQLite reads it; other texts are none
    "sqlite_stamp(x STRING) RETURNS TIMESTAMP": r"CASE WHEN x RLIKE r'^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$' THEN try_cast(x as timestamp) END",
    # -1, 0 or 1: a number beside a text, which counts as a number if all of it is one and else is greater
    "sqlite_order(n DOUBLE, x STRING) RETURNS INT": r"CASE WHEN n IS NOT NULL AND x IS NOT NULL THEN CASE WHEN NOT x RLIKE r'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$' THEN -1 ELSE cast(sign(n - try_cast(trim(x) as double)) as int) END END",
    # place 0 is before the first character; a negative length counts to the left
    "sqlite_substr2(x STRING, p BIGINT) RETURNS STRING": "substring(x, cast(p as int))",
    "sqlite_substr3(x STRING, p BIGINT, n BIGINT) RETURNS STRING": """CASE WHEN n >= 0 AND p = 0 THEN substring(x, 1, cast(greatest(n - 1, 0) as int))
        WHEN n >= 0 THEN substring(x, cast(p as int), cast(n as int))
        ELSE substring(x, cast(greatest(1, if(p < 0, length(x) + 1 + p, p) + n) as int), cast(greatest(0, least(-n, if(p < 0, length(x) + 1 + p, p) - 1)) as int)) END""",
}


def _strftime() -> str:
    """strftime(format, x): each code is replaced by its value in turn."""
    stamp, out = "try_cast(x as timestamp)", "fmt"
    for code, pattern in STRFTIME.items():
        out = f"replace({out}, '{code}', date_format({stamp}, '{pattern}'))"
    out = f"replace({out}, '%w', cast(dayofweek({stamp}) - 1 as string))"
    return f"replace({out}, '%s', cast(unix_seconds({stamp}) as string))"


def register(spark: SparkSession) -> None:
    """Define the functions in the session, once."""
    if spark.catalog.functionExists("sqlite_substr3"):
        return
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strftime(fmt STRING, x STRING) RETURNS STRING RETURN {_strftime()}")
    for head, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
