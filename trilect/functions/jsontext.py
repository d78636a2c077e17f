"""Repair of damaged JSON texts by scanning them for strings.

A text is cut at the quotes that no backslash escapes, so that every second part is the inside
of a string. What lies between strings is repaired there; inside a string only what JSON
forbids is changed, in a way that keeps its meaning: a backslash that begins no escape is
doubled and a control character is escaped. All of it is Spark columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trilect.functions.columns import as_column

# Two characters that no text may hold stand for a backslash that escapes, and for an escaped quote.
ESCAPE, QUOTE = "\ufdd0", "\ufdd1"
# The short escapes of JSON.
SHORT = {"\b": "b", "\t": "t", "\n": "n", "\f": "f", "\r": "r"}


def payload(x: str | Column) -> Column:
    """The JSON in a model's answer: behind its thoughts, inside its code fence, between its remarks.

    A text that begins with a bracket is left as it is up to its last bracket, whatever its strings say.
    """
    text = F.trim(as_column(x))
    # thoughts and fences that matter come before anything that looks like JSON

    def before(whole: Column, mark: str) -> Column:
        return whole.contains(mark) & ~F.substring_index(whole, mark, 1).rlike(r'[\[{]\s*["\[{]')

    behind = F.when(
        text.startswith("<think>") | before(text, "</think>"), F.regexp_replace(text, r"(?s)^(?:.*?</think>|<think>[^\[{]*)", "")
    ).otherwise(text)
    opened = F.when(before(behind, "```"), F.regexp_replace(behind, r"(?s)^[^`]*```[A-Za-z]*", "")).otherwise(behind)
    opened = F.regexp_replace(opened, r"(?s)^[^\[{]+(?=[\[{])", "")
    found = F.when(text.rlike(r"^[\[{]"), text).otherwise(opened)
    found = F.regexp_replace(found, r"(?:\s*```\s*|\n\s*```[^`]*)$", "")
    return F.trim(F.regexp_replace(found, r'(?s)(?<=[\]}])[^\]}"]*$', ""))


def _parts(text: Column) -> Column:
    """The text cut at its quotes; the parts at odd places are strings."""
    marked = F.regexp_replace(text, r"(?s)\\(.)", f"{ESCAPE}$1")
    return F.split(F.replace(marked, F.lit(ESCAPE + '"'), F.lit(QUOTE)), '"', -1)


def _string(part: Column) -> Column:
    """The inside of a string with its wrong escapes doubled and its control characters escaped."""
    out = F.regexp_replace(part, ESCAPE + r"(?![\\/bfnrt]|u[0-9A-Fa-f]{4})", ESCAPE + ESCAPE)
    escaped = out
    for code in range(32):
        shown = SHORT.get(chr(code), f"u{code:04x}")
        # behind a backslash the character itself was the wrong escape
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(ESCAPE + shown))
    return F.when(out.rlike(r"[\x00-\x1f]"), escaped).otherwise(out)


def _between(part: Column) -> Column:
    """Marks, numbers and words without control characters, leading zeros and commas before a closing bracket."""
    out = F.regexp_replace(part, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(out, r"(?<![0-9A-Za-z_.+])0+(?=[0-9])", "")
    return F.regexp_replace(out, r",(\s*[\]}])", "$1")


def repaired(text: Column) -> Column:
    """The text with its strings kept and what lies between them repaired."""
    parts = F.transform(_parts(text), lambda p, k: F.when(k % 2 == 1, _string(p)).otherwise(_between(p)))
    joined = F.array_join(parts, '"')
    back = F.replace(F.replace(joined, F.lit(QUOTE), F.lit('\\"')), F.lit(ESCAPE), F.lit("\\"))
    return F.when(text.rlike(f"[{ESCAPE}{QUOTE}]"), text).otherwise(back)


def flaw(text: Column) -> Column:
    """Why a repaired text still isn't JSON, as far as brackets and quotes tell."""
    outside = F.array_join(F.filter(_parts(text), lambda p, k: k % 2 == 0), " ")

    def count(marks: str) -> Column:
        return F.char_length(outside) - F.char_length(F.translate(outside, marks, ""))

    return (
        F.when(text == "", "nothing but remarks")
        .when(text.rlike(f"[{ESCAPE}{QUOTE}]"), "a character that stands for another")
        .when(F.size(_parts(text)) % 2 == 0, "a string without an end")
        .when(count("[{") > count("]}"), "a bracket without an end")
        .when(count("[{") < count("]}"), "a bracket without a beginning")
        .when(~text.rlike(r"^[\[{]"), "no bracket at the beginning")
        .otherwise("a mark, number or word out of place")
    )
