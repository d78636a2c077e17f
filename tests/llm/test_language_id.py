import math
import random
from collections import Counter

import numpy as np
import pytest

from trilect.llm.language_id import BUCKETS, DECLARED, TEMPER, TRIGRAM, WIDER, address, declared, identify, trigrams, visible

TEXT = {
    "en": "the quick brown fox and the lazy dog went over to that other thing with them",
    "fr": "le renard brun et le chien paresseux sont allés vers cette autre chose avec eux",
}
SCHEMA = "page_id bigint, url string, html string, host string, text string, lang string, l0 double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, TEXT[x] * 3, x) for k, x in enumerate(["en", "fr"] * 10)] + [(90, None, "en"), (91, "x", None), (92, "", "de")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "t", "l", 0.0) for i, u, h in rows], SCHEMA)


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><script>the the the</script><p>{text}</p></html>"


def result(df):
    return {r.page_id: (r.language, r.posterior) for r in df.collect()}


def test_text_decides_against_the_markup(spark, docs):
    rows = [(k, "http://h.org/", page(TEXT["fr"], "en")) for k in range(5)] + [(k, "http://i.org/", page(TEXT["en"], "en")) for k in range(5, 9)]
    got = result(identify(frame(spark, rows), docs))
    assert [got[k][0] for k in range(9)] == ["fr"] * 5 + ["en"] * 4


def test_other_evidence_decides_where_the_text_says_nothing(spark, docs):
    rows = [(k, f"http://a{k}.fr/", page(TEXT["fr"], "fr-FR")) for k in range(6)]
    rows += [(10 + k, f"http://b{k}.uk/", page(TEXT["en"], "en")) for k in range(6)]
    rows += [(20, "http://c.fr/", page("123")), (21, "http://c.uk/", page("")), (22, None, page("1", "fr")), (23, "http://d.com/", page("1", "EN"))]
    rows += [(30 + k, "http://www.two.com/x", page(TEXT["fr"])) for k in range(4)] + [(40, "https://u@www.two.com:80/y", page("..."))]
    got = result(identify(frame(spark, rows), docs))
    assert [got[k][0] for k in (20, 21, 22, 23, 40)] == ["fr", "en", "fr", "en", "fr"]
    assert all(0.5 < got[k][1] < 1 for k in (20, 21, 22, 23, 40))


def made(lang):
    """Words of a language of its own."""
    rng = random.Random(lang)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
    return [" ".join("".join(rng.choices(letters, k=rng.randrange(3, 8))) for _ in range(60)) for _ in range(2)]


def test_three_hundred_languages(spark):
    langs = [f"l{k:03d}" for k in range(300)]
    taught = spark.createDataFrame([(k, made(x)[0] + " " + made(x)[1], x) for k, x in enumerate(langs)], "doc_id bigint, text string, lang string")
    pages = [(k, f"http://{x}.org/", page(made(x)[k % 2])) for k, x in enumerate(langs)]
    got = result(identify(frame(spark, pages), taught))
    assert len(got) == 300 and sum(got[k][0] == x for k, x in enumerate(langs)) == 300


def by_hand(docs, pages):
    """The same evidence, page by page in plain loops."""
    counts = {}
    for lang, text in docs:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(trigrams(text).tolist())
    names = sorted(x for x in counts if counts[x])
    rows = []
    for page_id, host, said, text in pages:
        found = trigrams(text).tolist()
        logs = []
        for x in names:
            size = sum(counts[x].values())
            value = sum(math.log((counts[x][t] + TRIGRAM) / (size + TRIGRAM * BUCKETS)) for t in found)
            logs.append(value * min(1.0, TEMPER / len(found)) if found else 0.0)
        own = np.exp(np.array(logs) - np.logaddexp.reduce(logs))
        rows.append((page_id, host, said, own))

    def total(keep):
        return sum((r[3] for r in rows if keep(r)), np.zeros(len(names)))

    def share(sums, wider):
        return (np.maximum(sums, 0) + WIDER * wider) / (sums.sum() + WIDER)

    def cut(host, k):
        return None if host is None else ".".join(host.split(".")[-k:])

    result, kinds = {}, {r[2] for r in rows if r[2]}
    over_all = share(total(lambda r: True), np.full(len(names), 1 / len(names)))
    for page_id, host, said, own in rows:
        by_suffix = share(total(lambda r: cut(r[1], 1) == cut(host, 1)), over_all)
        by_domain = share(total(lambda r: cut(r[1], 2) == cut(host, 2)), by_suffix)
        prior = over_all if host is None else share(total(lambda r: r[1] == host) - own, by_domain)
        odds = np.zeros(len(names))
        if said:
            spoken = total(lambda r: r[2] is not None)
            odds = np.log((total(lambda r: r[2] == said) + DECLARED) / (spoken + DECLARED * (len(kinds) + 1)))
        found = np.log(own) + np.log(prior) + odds
        result[page_id] = (names[int(found.argmax())], 1 / np.exp(found - found.max()).sum())
    return result


@pytest.mark.parametrize("block", [1, 3, 128])
def test_posteriors_by_hand_in_blocks_of_any_size(spark, block):
    rng, langs = random.Random(7), ["aa", "bb", "cc", "dd", "eé,"]
    docs = [(x, " ".join(made(x))) for x in langs] + [("zz", ""), (None, "abc"), ("aa", None)]
    pages = []
    for k in range(40):
        words = made(rng.choice(langs))[0].split()[: rng.randrange(0, 12)]
        host = rng.choice(["www.a.com", "b.a.com", "c.org", "org", None])
        pages.append((k, host, rng.choice(["aa", "bb", "xx", None]), " ".join(words + made(rng.choice(langs))[1].split()[: rng.randrange(0, 9)])))
    rows = [(k, f"http://{host}/x" if host else None, page(text, said)) for k, host, said, text in pages]
    taught = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(docs)], "doc_id bigint, text string, lang string")
    got, wanted = result(identify(frame(spark, rows), taught, block=block)), by_hand(docs, pages)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(got[k][1] == pytest.approx(wanted[k][1], rel=1e-6) for k in wanted)


def test_odd_rows(spark, docs):
    rows = [(1, None, None), (1, None, None), (None, "not a url", ""), (2, "http://", "<p>" + TEXT["en"] * 5000)]
    found = identify(frame(spark, rows), docs)
    assert found.count() == 4 and result(found)[2][0] == "en" and all(0 < r.posterior <= 1 for r in found.collect())
    assert identify(frame(spark, []), docs).count() == 0
    untaught = identify(frame(spark, rows), docs.limit(0)).collect()
    assert len(untaught) == 4 and all(r.language is None for r in untaught)


def test_columns(spark):
    html = "<!-- <p>no</p> --><style>a{}</style><HTML class='x' LANG='pt-BR'><p>a&nbsp;b</p>"
    df = spark.createDataFrame([(html, "HTTPS://user@Www.Ex.co.UK:8080/p?q")], "h string, u string")
    row = df.select(visible(df.h), declared(df.h), *address(df.u)).first()
    assert row[0].split() == ["a", "b"] and row[1:] == ("pt", "www.ex.co.uk", "co.uk", "uk")
    meta = spark.createDataFrame([('<meta http-equiv="Content-Language" content="de">',)], "h string")
    assert meta.select(declared(meta.h)).first()[0] == "de"


def test_pages(spark, documents, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    found = identify(pages, documents).join(pages, "page_id").collect()
    assert len(found) == pages.count() and sum(f"/{r.language}/" in r.url for r in found) >= 0.95 * len(found)
