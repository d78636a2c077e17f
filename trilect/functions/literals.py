"""Column values as SQL literals of the three dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilect.functions.columns import as_column
from trilect.operators.repair import DEFAULT_DATE, _base, type_class

# Accepted spellings of truth.
TRUE_TEXT = ["true", "1", "yes", "on"]
FALSE_TEXT = ["false", "0", "no", "off"]
BOOLEAN_LITERAL = {"mysql": ("1", "0"), "pg": ("TRUE", "FALSE"), "oracle": ("1", "0")}
TIMESTAMP_TYPES = ["DATETIME", "TIMESTAMP", "TIMESTAMPTZ", "DATE"]
BINARY_TYPES = ["BLOB", "BYTEA", "LONGBLOB", "MEDIUMBLOB", "TINYBLOB", "VARBINARY", "BINARY"]
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^\d{2}:\d{2}:\d{2}(?:\.\d+)?$"
# Oracle time masks.
MASK = "YYYY-MM-DD HH24:MI:SS"
MASK_T = 'YYYY-MM-DD"T"HH24:MI:SS'
MASK_ZONE = "TZH:TZM"


def _text(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def escape(s: str | Column, dialect: str) -> Column:
    """Backslash escapes for mysql; doubled quotes and no carriage returns otherwise."""
    s = as_column(s)
    if dialect != "mysql":
        return _text(_text(s, "'", "''"), "\r", "")
    for old, new in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        s = _text(s, old, new)
    return s


def quoted(s: str | Column, dialect: str) -> Column:
    return F.concat(F.lit("'"), escape(s, dialect), F.lit("'"))


def normalize_datetime_text(s: str | Column) -> Column:
    """ISO 8601 text as ``YYYY-MM-DD HH:MM:SS``: no T, fraction, Z or offset."""
    out = _text(F.trim(as_column(s)), "T", " ")
    for pattern in (r"\.\d+", r"[Zz]$", r"[+-]\d{2}:?\d{2}$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def normalize_numeric_text(s: str | Column) -> Column:
    """Number text as a bare literal; NULL if it is none."""
    bare = F.trim(as_column(s))
    whole = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("decimal(38,0)").cast("string"))
    return F.when(bare.contains("."), double_literal(bare.try_cast("double"), absent=None)).otherwise(whole)


def normalize_boolean_text(s: str | Column, dialect: str) -> Column:
    word = F.lower(F.trim(as_column(s)))
    true, false = BOOLEAN_LITERAL[dialect]
    return F.when(word.isin(TRUE_TEXT), F.lit(true)).when(word.isin(FALSE_TEXT), F.lit(false))


def double_literal(x: str | Column, absent: str | None = "NULL") -> Column:
    """Whole numbers below 1e15 without a point, others with at most six decimals; NaN and infinity are ``absent``."""
    x = as_column(x).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")
    return (
        F.when(x.isNull() | ~finite, F.lit(absent))
        .when(whole, F.when(whole, x).cast("bigint").cast("string"))
        .otherwise(fixed)
    )


def _oracle_call(function: str, value: Column, mask: Column) -> Column:
    return F.concat(F.lit(f"{function}('"), escape(value, "oracle"), F.lit("', '"), mask, F.lit("')"))


def _oracle_time(text: Column, declared: str) -> Column:
    upper = declared.upper()
    bare_time = F.trim(text).rlike(ISO_TIME)
    value = F.when(
        bare_time, F.concat(F.lit(f"{DEFAULT_DATE} "), F.regexp_replace(F.trim(text), r"\.\d+", ""))
    ).otherwise(text)
    if _base(declared) == "DATE":
        plain = F.when(F.trim(value).rlike(ISO_DATETIME), normalize_datetime_text(value)).otherwise(value)
        mask = F.when(plain.contains(" "), F.lit(MASK)).otherwise(F.lit("YYYY-MM-DD"))
        return _oracle_call("TO_DATE", plain, mask)
    stripped = F.regexp_replace(F.trim(value), r"\.\d+", "")
    zoned = "ZONE" in upper
    if zoned:
        stripped = F.regexp_replace(stripped, r"[Zz]$", "+00:00")
    else:
        stripped = F.regexp_replace(F.regexp_replace(stripped, r"[Zz]$", ""), r"[+-]\d{2}:?\d{2}$", "")
    has_t = F.substring(stripped, 11, 1) == "T"
    mask = F.when(has_t, F.lit(MASK_T)).otherwise(F.lit(MASK))
    if not zoned:
        return _oracle_call("TO_TIMESTAMP", stripped, mask)
    mask = F.concat(mask, F.when(stripped.rlike(r"[+-]\d{2}:\d{2}$"), F.lit(MASK_ZONE)).otherwise(F.lit("")))
    return _oracle_call("TO_TIMESTAMP_TZ", stripped, mask)


def _array_literal(text: Column, declared: str) -> Column:
    """A JSON list as ``ARRAY['a', 'b']::T[]``; an object becomes a single element."""
    base = declared.upper().removesuffix("[]")
    items = F.from_json(text, "array<string>")
    listed = F.concat(
        F.lit("ARRAY["), F.array_join(F.transform(items, lambda e: quoted(e, "pg")), ", "), F.lit(f"]::{base}[]")
    )
    single = F.concat(F.lit("ARRAY["), quoted(text, "pg"), F.lit(f"]::{base}[]"))
    return F.when(F.trim(text).startswith("["), listed).when(F.trim(text).startswith("{"), single).otherwise(quoted(text, "pg"))


def _binary_literal(text: Column, dialect: str) -> Column:
    hexed = F.lower(F.left(text, F.lit(2))) == "0x"
    digits = F.substring(text, 3, 1 << 30)
    if dialect == "mysql":
        return F.when(hexed, text).otherwise(F.concat(F.lit("UNHEX("), quoted(text, dialect), F.lit(")")))
    if dialect == "pg":
        return F.when(hexed, F.concat(F.lit("E'\\\\x"), digits, F.lit("'"))).otherwise(quoted(text, dialect))
    return F.when(hexed, F.concat(F.lit("HEXTORAW('"), digits, F.lit("')"))).otherwise(
        F.concat(F.lit("UTL_RAW.CAST_TO_RAW("), quoted(text, dialect), F.lit(")"))
    )


def text_literal(x: str | Column, declared: str, dialect: str) -> Column:
    """Text in a column of type ``declared``: dates, truth values and numbers lose their quotes or get a call."""
    text = as_column(x).cast("string")
    base, kind, upper = _base(declared), type_class(declared), declared.upper()
    truth = base in ("BOOLEAN", "BOOL", "TINYINT") or "NUMBER(1)" in upper
    plain = quoted(text, dialect)
    if "[]" in upper and dialect == "pg":
        return _array_literal(text, declared)
    if base in BINARY_TYPES:
        return _binary_literal(text, dialect)
    if kind == "date":
        if dialect == "oracle" and base in ("TIMESTAMP", "DATE"):
            return _oracle_time(text, declared)
        time = F.regexp_replace(F.trim(text), r"\.\d+", "")
        if base in TIMESTAMP_TYPES:
            time = F.concat(F.lit(f"{DEFAULT_DATE} "), time)
        if dialect == "oracle":
            return plain
        return (
            F.when(F.trim(text).rlike(ISO_DATETIME), quoted(normalize_datetime_text(text), dialect))
            .when(F.trim(text).rlike(ISO_DATE), quoted(F.trim(text), dialect))
            .when(F.trim(text).rlike(ISO_TIME), quoted(time, dialect))
            .otherwise(plain)
        )
    if truth:
        return F.coalesce(normalize_boolean_text(text, dialect), plain)
    if kind in ("integer", "decimal"):
        return F.coalesce(normalize_numeric_text(text), plain)
    if kind == "json" and dialect == "pg":
        return F.concat(plain, F.lit("::jsonb"))
    return plain


def sql_literal(x: str | Column, dtype: T.DataType, dialect: str, declared: str | None = None) -> Column:
    """Any column value as a literal; ``declared`` is the target column's type text."""
    c = as_column(x)
    true, false = BOOLEAN_LITERAL[dialect]
    truth = declared is not None and (_base(declared) in ("BOOLEAN", "BOOL", "TINYINT") or "NUMBER(1)" in declared.upper())
    if isinstance(dtype, T.BooleanType):
        out = F.when(c, F.lit(true)).otherwise(F.lit(false))
    elif isinstance(dtype, T.NumericType) and dialect == "pg" and truth:
        out = F.when(c != 0, F.lit(true)).otherwise(F.lit(false))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        out = double_literal(c)
    elif isinstance(dtype, T.IntegralType):
        out = c.cast("string")
    elif isinstance(dtype, T.DecimalType):
        out = F.coalesce(normalize_numeric_text(c.cast("string")), c.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out = _oracle_call("TO_TIMESTAMP", text, F.lit(MASK)) if dialect == "oracle" else quoted(text, dialect)
    elif isinstance(dtype, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
        out = _oracle_call("TO_DATE", text, F.lit("YYYY-MM-DD")) if dialect == "oracle" else quoted(text, dialect)
    elif isinstance(dtype, T.BinaryType):
        out = _binary_literal(F.concat(F.lit("0x"), F.hex(c)), dialect)
    elif isinstance(dtype, T.ArrayType):
        out = text_literal(F.to_json(c), declared or "TEXT[]", dialect)
    elif isinstance(dtype, (T.StructType, T.MapType)):
        out = text_literal(F.to_json(c), declared or "JSON", dialect)
    elif declared is not None:
        out = text_literal(c, declared, dialect)
    else:
        text = c.cast("string")
        out = F.when(F.trim(text).rlike(ISO_DATETIME), quoted(normalize_datetime_text(text), dialect)).otherwise(
            quoted(text, dialect)
        ) if dialect != "oracle" else quoted(text, dialect)
    return F.when(c.isNull(), F.lit("NULL")).otherwise(out)
