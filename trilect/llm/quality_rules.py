"""Quality rules as a ledger: every rule is evaluated once per text and kept as one bit.

``ledger`` stores the measurements and a failure bitmask. Policies are named sets of
rules; applying one, or a later version of it, is a bitwise test of the stored mask and
never reads a text again. ``ablation`` needs one count per distinct mask.

Defined cases: a NULL or blank text has no words and all measurements 0; it fails
``few_words``. Repeated rows are judged one by one. Other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.shared import BLANKS, let, text_of, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rule name -> failing condition over the measurements. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclaims": "10 * n_exclaims > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}

BASE = ("few_words", "repeat_words")

#: Versioned policies: the rules a text must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "exclaims"),
    "v2": tuple(RULES),
}

MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words",
)


def _count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more.

    Window hashes are compared first: distinct hashes mean distinct windows. Where some
    agree, numbers of (hash, position) are sorted, the windows at neighbouring equal hashes
    are compared as text, and the covered words are the union of [start, start + 3).
    """
    at = lambda w, i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def shared(items: Column, key: Callable[[Column], Column]) -> Column:
        """The items, in order, whose key a neighbour in that order has too."""
        near = lambda s, x, k: F.coalesce(key(F.get(s, k)) == key(x), F.lit(False))
        return let(F.sort_array(items), lambda s: F.filter(s, lambda x, k: near(s, x, k - 1) | near(s, x, k + 1)))

    def covered(hashes: Column, w: Column) -> Column:
        # As many low bits hold the position as the number of words needs; fewer bits of
        # the hash only mean that more windows are compared as text.
        bits = F.length(F.bin(F.size(w)))
        left = lambda x: F.call_function("shiftleft", x, bits)
        right = lambda x: F.call_function("shiftright", x, bits)
        likely = shared(F.transform(hashes, lambda h, i: left(h).bitwiseOR(i.cast("bigint"))), right)
        places = F.transform(likely, lambda x: (x - left(right(x))).cast("int"))
        texts = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *at(w, i)).alias("t"), i.alias("i")))
        starts = F.sort_array(F.transform(shared(texts, lambda x: x["t"]), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, s: F.struct(
            (a["n"] + s + F.lit(3) - F.greatest(s, a["end"])).alias("n"), (s + F.lit(3)).alias("end")
        )
        return F.aggregate(starts, zero, add, lambda a: a["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*at(w, i)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h, w)),
        )

    return F.when(F.size(words) >= 3, count(words)).otherwise(F.lit(0)).cast("bigint")


def measurements(text: Column) -> Column:
    """All measurements of one text as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
        ),
    )
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"),
            F.length(F.array_join(w, "")).cast("bigint").alias("chars"),
            _repeat_words(w).alias("repeat"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            m["w"]["chars"].alias("word_chars"),
            _count_of(text, SYMBOLS).alias("n_symbols"),
            _count_of(text, "!").alias("n_exclaims"),
            m["l"]["n"].alias("n_lines"),
            m["l"]["dup"].alias("n_dup_lines"),
            m["w"]["repeat"].alias("n_repeat_words"),
        ),
    )


def mask_of(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    """The bits of the named rules."""
    places = list(rules)
    return sum(1 << places.index(n) for n in names)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failed``, whose bit k says that rule k failed."""
    measured = docs.select(F.col(doc_id).alias("doc_id"), measurements(text_of(text)).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(rules.values())]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint"))


def apply_policy(entries: DataFrame, policy: str = "v2", name: str = "kept", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Adds whether no rule of the policy failed; reads the stored bits only."""
    mask = mask_of(POLICIES[policy], rules)
    return entries.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(entries: DataFrame, policy: str = "v2", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it rejects.

    Rows are first counted by mask, at most 2 ** rules groups whatever the input.
    """
    places, mask = list(rules), mask_of(POLICIES[policy], rules)
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << places.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]
    ])
    each = masks.select("bits", "n", F.explode(listed).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_by_it"),
    )


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` of one policy."""
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) != 0
    judged = apply_policy(ledger(docs), policy).withColumn("base_failed", base)
    return judged.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def keep_passing(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only: the ledger beside each row, then the policy."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    # Rules name measurements; the document is out of their reach, whatever its columns are called.
    entries = ledger(rows, doc_id="_doc", text="_doc.text")
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) == 0
    return apply_policy(entries, policy).filter(F.col("kept") & base).select("doc_id.*")
