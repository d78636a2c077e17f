"""Scalar functions with the meaning one SQL dialect gives them.

Every builder returns a native Column. ``dialect`` is ``mysql``, ``pg`` or
``oracle``; the divergences sit in one table so that a value can be corrected
in one place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trilect.functions.columns import as_column

DIALECTS = ("mysql", "pg", "oracle")

# What each dialect does where a shared name means different things.
DIVERGENCE = {
    "log": {"mysql": "ln", "pg": "log10", "oracle": "ln"},
    "length": {"mysql": "bytes", "pg": "chars", "oracle": "chars"},
    "greatest_with_null": {"mysql": "null", "pg": "skip", "oracle": "skip"},
    "integer_division": {"mysql": "fraction", "pg": "truncate", "oracle": "fraction"},
    "division_by_zero": {"mysql": "null", "pg": "error", "oracle": "error"},
    "regexp_replace": {"mysql": "all", "pg": "first", "oracle": "first"},
    "empty_string": {"mysql": "value", "pg": "value", "oracle": "null"},
    "nulls_ascending": {"mysql": "first", "pg": "last", "oracle": "last"},
}

# The constants that replace the clock and the random generator.
FIXED_TIMESTAMP = "2024-06-15 00:00:00"
FIXED_DATE = "2024-06-15"
FIXED_RANDOM = 0.5
FIXED_RANDOM_INTEGER = 42


def rule(feature: str, dialect: str) -> str:
    name = "pg" if dialect == "postgresql" else dialect
    return DIVERGENCE[feature][name]


# --- numbers ---------------------------------------------------------------


def log(x: str | Column, dialect: str) -> Column:
    return F.log10(x) if rule("log", dialect) == "log10" else F.ln(x)


def greatest(*columns: str | Column, dialect: str) -> Column:
    cols = [as_column(c) for c in columns]
    largest = F.greatest(*cols) if len(cols) > 1 else cols[0]
    if rule("greatest_with_null", dialect) == "skip":
        return largest
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, largest)


def divide(a: str | Column, b: str | Column, dialect: str, integers: bool = False) -> Column:
    """``a / b``; ``integers`` says both sides have an integer type in the source dialect."""
    a, b = as_column(a), as_column(b)
    if rule("division_by_zero", dialect) == "null":
        return F.try_divide(a, b)
    guarded = F.when(b == F.lit(0), F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(b)
    if integers and rule("integer_division", dialect) == "truncate":
        return F.call_function("div", a, guarded)
    return a / guarded


# Doubles from here on have no digits after the point; below it 18 of them fit a decimal.
_WHOLE_FROM = 1e15


def truncate(x: str | Column, digits: int) -> Column:
    """TRUNCATE / TRUNC: drop digits after ``digits`` places, toward zero, in decimal; ``digits`` may be negative."""
    value = as_column(x)

    def cut(exact: Column) -> Column:
        return F.when(exact < 0, F.ceil(exact, F.lit(digits))).otherwise(F.floor(exact, F.lit(digits))).cast("double")

    large = value.cast("double") if digits >= 0 else cut(value.cast("decimal(38,0)"))
    return F.when(F.abs(value) < F.lit(_WHOLE_FROM), cut(value.cast("decimal(38,18)"))).otherwise(large)


def _rounded(x: Column, scale: int, kind: str) -> Column:
    """``x`` rounded once, half up, from all its digits, as ``kind``.

    A decimal of 38 digits can't hold every double, so the digits after the point depend on the
    size: 37 of them below 1, where a double has the most, 18 up to 1e20, none beyond.
    """
    size = F.abs(x.cast("double"))

    def of(held: int) -> Column:
        exact = x.try_cast(f"decimal(38,{held})")
        return (F.round(exact, scale) if held else exact).cast(kind)

    return F.when(size < 1, of(37)).when(size < 1e20, of(18)).otherwise(of(0))


def to_signed(x: str | Column) -> Column:
    """CAST AS SIGNED / ::INTEGER / CAST AS INTEGER: rounds where Spark's cast would truncate.

    What lies beyond 64 bits becomes the largest or smallest value, as CAST AS SIGNED has it.
    """
    value = as_column(x)
    high, low = F.lit(2**63 - 1), F.lit(-(2**63))
    size = value.cast("double")
    return F.when(size >= float(2**63), high).when(size <= -float(2**63), low).otherwise(_rounded(value, 0, "bigint"))


def to_text(x: str | Column) -> Column:
    return as_column(x).cast("string")


def to_numeric(x: str | Column, precision: int, scale: int) -> Column:
    return _rounded(as_column(x), scale, f"decimal({precision},{scale})")


def to_date(x: str | Column) -> Column:
    return as_column(x).cast("date")


def number_format(x: str | Column, digits: int, dialect: str) -> Column:
    """FORMAT(x, n) or TO_CHAR(x, 'FM999,999,999.00'); the mask of the latter has no leading zero."""
    value = as_column(x)
    fraction = F.round(value.cast("decimal(38,18)"), digits)
    text = F.when(F.abs(value) < F.lit(_WHOLE_FROM), F.format_number(fraction, digits)).otherwise(
        F.format_number(value.cast("decimal(38,0)"), digits)
    )
    return text if dialect == "mysql" else F.regexp_replace(text, r"^(-?)0\.", "$1.")


# --- nulls and text ----------------------------------------------------------


def null_substitute(x: str | Column, default: Column) -> Column:
    """IFNULL / NVL / two-argument COALESCE."""
    return F.coalesce(as_column(x), default)


def nvl2(x: str | Column, present: Column, absent: Column) -> Column:
    return F.when(as_column(x).isNotNull(), present).otherwise(absent)


def empty_as_null(x: str | Column, dialect: str) -> Column:
    return F.nullif(as_column(x), F.lit("")) if rule("empty_string", dialect) == "null" else as_column(x)


def concat(*parts: str | Column, dialect: str) -> Column:
    """CONCAT / ||: NULL if any part is NULL, except that Oracle reads NULL as ''."""
    cols = [as_column(p) for p in parts]
    joined = F.concat(*cols)
    if rule("empty_string", dialect) != "null":
        return joined
    return F.nullif(F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), F.lit(""))


def length(s: str | Column, dialect: str) -> Column:
    return F.octet_length(s) if rule("length", dialect) == "bytes" else F.char_length(s)


def regex(pattern: str) -> str:
    """A POSIX class pattern in Java syntax."""
    for name, java in POSIX_CLASSES.items():
        pattern = pattern.replace(f"[[:{name}:]]", f"[{java}]").replace(f"[:{name}:]", java)
    return pattern


# POSIX bracket classes and their Java spelling.
POSIX_CLASSES = {
    "space": r"\s",
    "digit": r"0-9",
    "alpha": r"\p{Alpha}",
    "alnum": r"\p{Alnum}",
    "upper": r"\p{Upper}",
    "lower": r"\p{Lower}",
    "punct": r"\p{Punct}",
}


def _java_replacement(replacement: str, dialect: str, moved: int = 0) -> str:
    """A replacement in Java's spelling, with group numbers raised by ``moved``.

    In pg and oracle a dollar sign is itself, ``\\1`` a group and ``\\\\`` a backslash;
    mysql writes groups as ``$1``.
    """

    def piece(m: re.Match[str]) -> str:
        if m["group"]:
            return f"${int(m['group'][1:]) + moved}"
        if m["dollar"]:
            return r"\$"
        return r"\\"

    dollar = "(?!)" if dialect == "mysql" else r"\$"
    group = r"[\\$]\d" if dialect == "mysql" else r"\\\d"
    return re.sub(rf"(?P<group>{group})|(?P<dollar>{dollar})|\\\\?", piece, replacement)


def regexp_replace(s: str | Column, pattern: str, replacement: str, dialect: str, flags: str = "") -> Column:
    """REGEXP_REPLACE with the dialect's default scope; ``flags='g'`` forces all matches.

    First-only scope is one native call: the text before the first match is
    captured and put back, so group numbers move up by two.
    """
    if rule("regexp_replace", dialect) == "all" or "g" in flags:
        return F.regexp_replace(as_column(s), regex(pattern), _java_replacement(replacement, dialect))
    inner = re.sub(r"\\([1-9])", lambda m: f"\\{int(m.group(1)) + 2}", regex(pattern))
    java = _java_replacement(replacement, dialect, moved=2)
    return F.regexp_replace(as_column(s), rf"\A([\s\S]*?)({inner})", f"$1{java}")


def hex_text(s: str | Column) -> Column:
    """HEX / ENCODE(..., 'hex') / RAWTOHEX over the UTF-8 bytes."""
    return F.hex(F.encode(as_column(s), "UTF-8"))


def json_text(doc: str | Column, path: str) -> Column:
    """JSON_UNQUOTE(JSON_EXTRACT(..)) / ->> ."""
    return F.get_json_object(as_column(doc), path)


def json_text_by_regex(doc: str | Column, key: str) -> Column:
    """The JSON-free spelling: the first quoted or bare scalar after ``"key":``, NULL if none."""
    pattern = rf'"{re.escape(key)}"\s*:\s*"?([^",}}]+)"?'
    return F.nullif(F.regexp_extract(as_column(doc), pattern, 1), F.lit(""))


def in_csv(x: str | Column, csv: str) -> Column:
    """FIND_IN_SET(x, 'a,b,c') > 0."""
    return F.find_in_set(as_column(x), F.lit(csv)) > 0


# --- dates -------------------------------------------------------------------

# Fixed values: %-codes of DATE_FORMAT and their Java letters.
PERCENT_CODES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "c": "M",
    "d": "dd",
    "e": "d",
    "M": "MMMM",
    "b": "MMM",
    "W": "EEEE",
    "a": "EEE",
    "H": "HH",
    "k": "H",
    "h": "hh",
    "I": "hh",
    "l": "h",
    "i": "mm",
    "s": "ss",
    "S": "ss",
    "p": "a",
    "j": "DDD",
    "f": "SSSSSS",
    "T": "HH:mm:ss",
    "r": "hh:mm:ss a",
}

# TO_CHAR codes and their Java letters.
TO_CHAR_CODES = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MONTH": "MMMM",
    "MON": "MMM",
    "MM": "MM",
    "DDD": "DDD",
    "DAY": "EEEE",
    "DY": "EEE",
    "DD": "dd",
    "HH24": "HH",
    "HH12": "hh",
    "HH": "hh",
    "MI": "mm",
    "SS": "ss",
    "AM": "a",
    "PM": "a",
    "Q": "q",
}
_NAME_CODES = {"MONTH", "MON", "DAY", "DY"}
_PADDED_CODES = {"MONTH", "DAY"}
_TO_CHAR = re.compile("|".join(sorted(TO_CHAR_CODES, key=len, reverse=True)), re.IGNORECASE)
_IN_QUOTES = re.compile(r'"([^"]*)"')


def _literal(text: str) -> str:
    """Text between TO_CHAR codes: what stands in double quotes, and signs; any other letter is no code."""
    out, at = "", 0
    for m in [*_IN_QUOTES.finditer(text), None]:
        plain = text[at : m.start()] if m else text[at:]
        if unknown := re.search(r"[A-Za-z]+", plain):
            raise ValueError(f"unknown format code: {unknown[0]}")
        out += plain + (m[1] if m else "")
        at = m.end() if m else at
    return _quoted(out)


def _percent_code(letter: str) -> str:
    if letter in PERCENT_CODES:
        return PERCENT_CODES[letter]
    if letter.isalpha():
        raise ValueError(f"unknown format code: %{letter}")
    return _quoted(letter)


def _quoted(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z']", literal) else literal


def date_format(d: str | Column, pattern: str, dialect: str, blank_padded: bool = False) -> Column:
    """DATE_FORMAT with %-codes (mysql) or TO_CHAR codes (pg, oracle).

    ``blank_padded`` gives TO_CHAR's fixed-width names of days and months. A code that
    isn't in the tables raises a ValueError; literal letters of TO_CHAR stand in double quotes.
    """
    d = as_column(d)
    if dialect == "mysql":
        java = re.sub(
            r"%(.)|([^%]+)",
            lambda m: _percent_code(m.group(1)) if m.group(1) else _quoted(m.group(2)),
            pattern,
        )
        return F.date_format(d, java)

    pieces: list[Column] = []
    plain = ""
    at = 0
    # Codes inside double quotes are text.
    hidden = _IN_QUOTES.sub(lambda m: " " * len(m[0]), pattern)
    for m in _TO_CHAR.finditer(hidden):
        plain += _literal(pattern[at : m.start()])
        at = m.end()
        code = m.group(0).upper()
        cased = code in _NAME_CODES and (m.group(0).isupper() or m.group(0).islower())
        if not cased and not (blank_padded and code in _PADDED_CODES):
            plain += TO_CHAR_CODES[code]
            continue
        if plain:
            pieces.append(F.date_format(d, plain))
            plain = ""
        name = F.date_format(d, TO_CHAR_CODES[code])
        if cased:
            name = F.upper(name) if m.group(0).isupper() else F.lower(name)
        pieces.append(F.rpad(name, 9, " ") if blank_padded and code in _PADDED_CODES else name)
    plain += _literal(pattern[at:])
    if plain:
        pieces.append(F.date_format(d, plain))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def date_part(part: str, d: str | Column) -> Column:
    return F.date_part(F.lit(part), as_column(d)).cast("int")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """DATEDIFF / date subtraction / TRUNC(date subtraction): whole days as an integer."""
    return F.datediff(to_date(later), to_date(earlier))


def shift_days(d: str | Column, days: int) -> Column:
    return F.date_add(to_date(d), F.lit(days))


def shift_months(d: str | Column, months: int) -> Column:
    """ADD_MONTHS / +- INTERVAL n MONTH; the day is held inside the target month."""
    return F.add_months(to_date(d), F.lit(months))


def interval_days(text: str) -> int:
    """The day count of ``INTERVAL 30 DAY``, ``INTERVAL '30 days'`` or ``INTERVAL '30' DAY``."""
    found = re.fullmatch(r"\s*INTERVAL\s+'?(-?\d+)\s*'?\s*'?days?'?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a day interval: {text}")
    return int(found.group(1))


def date_trunc(unit: str, d: str | Column) -> Column:
    return F.date_trunc(unit, as_column(d)).cast("date")


def last_day(d: str | Column) -> Column:
    return F.last_day(to_date(d))


def whole_years(later: str | Column, earlier: str | Column) -> Column:
    """EXTRACT(YEAR FROM AGE(a, b)) / TIMESTAMPDIFF(YEAR, b, a): completed years."""
    start, end = to_date(earlier).cast("timestamp_ntz"), to_date(later).cast("timestamp_ntz")
    return F.timestamp_diff("YEAR", start, end).cast("int")


def order_by(c: str | Column, dialect: str, descending: bool = False) -> Column:
    """Sort order with the dialect's default place for NULL."""
    c = as_column(c)
    first = (rule("nulls_ascending", dialect) == "first") != descending
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def pinned_now() -> Column:
    return F.lit(FIXED_TIMESTAMP).cast("timestamp_ntz")


def pinned_today() -> Column:
    return F.lit(FIXED_DATE).cast("date")


def pinned_random() -> Column:
    return F.lit(FIXED_RANDOM)


def pinned_random_integer() -> Column:
    return F.lit(FIXED_RANDOM_INTEGER)
