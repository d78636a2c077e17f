"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

* The visible text under a character-trigram model, learnt from documents whose language is
  known. Its weight is tempered: past ``TEMPER`` trigrams a longer text adds no certainty.
* The language that the markup declares, through a table of how often each is declared
  where the text says which language; declarations that are often wrong count for little.
* The address suffix and the host, as priors: the languages of a host's other pages are
  smoothed by its domain's, those by the suffix's, and those by all pages'.

The tables are grouped sums of the text evidence over all pages. There may be any number
of languages: the model is read ``BLOCK`` languages at a time, each block in a pass of its
own over the texts, sums are rows of (group, language), and a page carries one number per
language. The driver holds one block, and one sum per language.

Defined cases: a NULL or empty page, or one without letters, has no text evidence; a missing
declaration or a NULL url gives none of its kind, so that such a page gets the prior of all
pages. Repeated rows count each. Equal posteriors go to the first language by name. Documents
without a language or text teach nothing; without any, no page has a language. Other columns
are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.hashing import mix
from trilect.llm.shared import drop, let, slices, text_of
from trilect.operators.ordering import checked_broadcast, null_safe_join
from trilect.session import cut, store

BUCKETS, TEMPER = 1 << 15, 200.0
#: Added counts: per trigram bucket, per declaration, and of the wider group at each level.
TRIGRAM, DECLARED, WIDER = 0.05, 0.5, 4.0
SLICE_BYTES = 8 << 20
#: Languages scored in one pass over the texts: 32 MB of the model in a worker.
BLOCK = 128


def trigrams(text: str) -> np.ndarray:
    """The buckets of a text's trigrams of lower-case letters, with word edges."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = (points >= 97) & (points <= 122) | (points >= 192)
    points = np.where(letter, points, np.uint64(32))
    points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    word = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    return (mix(word, 51) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], DataFrame]:
    """The languages by name, and (lang, bucket, n): how often each has a trigram."""
    source = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            coded = pc.dictionary_encode(batch.column(0))
            codes, texts = coded.indices.to_numpy(), batch.column(1)
            by_code = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[by_code], np.arange(len(coded.dictionary) + 1))
            for code, (a, b) in enumerate(zip(ends, ends[1:])):
                counts = np.zeros(BUCKETS, np.int64)
                for k in by_code[a:b]:
                    counts += np.bincount(trigrams(texts[int(k)].as_py()), minlength=BUCKETS)
                there = np.flatnonzero(counts)
                names = pa.array([coded.dictionary[code].as_py()] * len(there), pa.string())
                yield pa.RecordBatch.from_pydict({"lang": names, "bucket": pa.array(there, pa.int32()), "n": counts[there]})

    counted = store(source.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()], counted


def block_of(counted: DataFrame, names: list[str]) -> np.ndarray:
    """Of a run of languages, by language and bucket, the log probability of a trigram."""
    table = np.zeros((len(names), BUCKETS))
    rows = counted.filter((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("counts")
    )
    packed = rows.select("lang", F.col("counts.bucket").alias("bucket"), F.col("counts.n").alias("n"))
    place = {name: k for k, name in enumerate(names)}
    for row in packed.toLocalIterator():
        table[place[row["lang"]], row["bucket"]] = row["n"]
    return np.log((table + TRIGRAM) / (table.sum(1, keepdims=True) + TRIGRAM * BUCKETS))


def scored(texts: DataFrame, model: np.ndarray, before: int, last: bool) -> DataFrame:
    """``texts`` with the text's log likelihoods under one more block of languages behind those in ``logs``.

    The last block makes them shares of all languages and leaves the text out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in texts.columns if c not in ("text", "logs")]
    kept = carried if last else [*carried, "text"]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    at, width = texts.columns.index("text"), before + len(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, SLICE_BYTES):
            logs = np.zeros((batch.num_rows, width))
            if before:
                logs[:, :before] = batch.column("logs").flatten().to_numpy().reshape(-1, before)
            for k, t in enumerate(batch.column(at)):
                found = trigrams(t.as_py())
                if len(found):
                    logs[k, before:] = shared.value[:, found].sum(1) * min(1.0, TEMPER / len(found))
            if last:
                logs -= np.logaddexp.reduce(logs, axis=1, keepdims=True)
            packed = pa.FixedSizeListArray.from_arrays(logs.ravel(), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], packed], names=[*kept, "logs"])

    return texts.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "logs array<double>"]))


def constant(values: list, kind: str) -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def visible(html: Column) -> Column:
    """A page's text without scripts, styles, comments, tags and character references."""
    without = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(without, r"<[^>]*>", " "), r"&#?\w+;", " ")


def declared(html: Column) -> Column:
    """The primary language tag of the html element, or else of the content-language header; NULL without."""
    tags = [F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,8})", 1)]
    tags.append(F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,8})", 1))
    return F.lower(F.coalesce(*[F.nullif(t, F.lit("")) for t in tags]))


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last label); NULL where there is no host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block: int = BLOCK) -> DataFrame:
    """Per page page_id, language, posterior, text_language, declared and host."""
    names, counted = train(docs)
    n = len(names)
    markup = text_of(html)
    host, domain, suffix = address(F.col(url))
    source = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
        declared(markup).alias("declared"), visible(markup).alias("text"),
    )
    if not names:
        none = F.lit(None).cast("string")
        return source.select("page_id", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), "declared", "host")
    read = source
    for begin in range(0, n, block):
        part = names[begin : begin + block]
        read = cut(scored(read, block_of(counted, part), begin, last=begin + len(part) == n))
    drop(counted)

    # Sums of the text evidence: by host, and from there by domain, suffix and over all.
    own = F.transform("logs", F.exp)
    by_host = cut(
        read.select("host", "domain", "suffix", F.posexplode(own).alias("k", "p"))
        .groupBy("host", "domain", "suffix", "k")
        .agg(F.sum("p").alias("n"))
    )

    def summed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """One array per group with its sum for each language."""
        sums = rows.groupBy(*keys, "k").agg(F.sum("n").alias("n"))
        return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias(name))

    def share(counts: Column, wider: Column) -> Column:
        """Shares of the counts, with ``WIDER`` more that are spread as those of the wider group."""
        totalled = F.struct(counts.alias("each"), F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).alias("total"))
        return let(
            totalled,
            lambda t: F.zip_with(t["each"], wider, lambda c, w: (F.greatest(c, F.lit(0.0)) + WIDER * w) / (t["total"] + WIDER)),
        )

    none = constant([0.0] * n, "double")
    by_language = dict(by_host.groupBy("k").agg(F.sum("n")).collect())
    total = sum(by_language.values())
    all_share = constant([(by_language.get(k, 0.0) + WIDER / n) / (total + WIDER) for k in range(n)], "double")
    priors = null_safe_join(summed(by_host, ["host", "domain", "suffix"], "hosts"), summed(by_host, ["suffix"], "suffixes"), ["suffix"])
    priors = null_safe_join(priors, summed(by_host, ["domain"], "domains"), ["domain"])
    priors = priors.withColumn("by_suffix", share(F.col("suffixes"), all_share))
    priors = cut(priors.select("host", "hosts", share(F.col("domains"), F.col("by_suffix")).alias("by_domain")))

    # How often each language is declared where the text says which one is used.
    stated = read.filter("declared is not null").select("declared", F.posexplode(own).alias("k", "n"))
    said = cut(summed(stated, ["declared"], "counts"))
    by_language = dict(said.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect())
    kinds = said.count()
    totals = constant([by_language.get(k, 0.0) + DECLARED * (kinds + 1) for k in range(n)], "double")
    odds = said.select("declared", F.zip_with("counts", totals, lambda c, t: F.ln((c + DECLARED) / t)).alias("odds"))

    met = null_safe_join(read, checked_broadcast(priors), ["host"]).join(checked_broadcast(odds), "declared", "left")
    # A page is no evidence about itself, so its own share leaves the host's sums.
    others = F.zip_with("hosts", own, lambda a, b: a - b)
    prior = F.when(F.col("host").isNull(), all_share).otherwise(share(others, F.col("by_domain")))
    found = F.zip_with(F.zip_with("logs", prior, lambda t, p: t + F.ln(p)), F.coalesce("odds", none), lambda a, o: a + o)
    met = met.select("page_id", "declared", "host", "logs", found.alias("found"))
    listed = constant(names, "string")

    def best(values: str) -> Column:
        """The language of the largest, the first of equals."""
        return F.get(listed, F.array_position(values, F.array_max(values)).cast("int") - 1)

    norm = let(F.array_max("found"), lambda top: F.aggregate("found", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return met.select(
        "page_id", best("found").alias("language"), (F.lit(1.0) / norm).alias("posterior"), best("logs").alias("text_language"), "declared", "host"
    )
