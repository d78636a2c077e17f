import collections
import re

from trilect.llm.quality_rules import BASE, POLICIES, RULES, ablation, apply_policy, keep_passing, ledger, mask_of, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {k + d for k, w in enumerate(windows) if w in twice for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), text.count("!"),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


def measured(df):
    names = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words"]
    return [(r.doc_id, tuple(r[n] for n in names)) for r in df.collect()]


def test_measurements_are_those_of_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = measured(ledger(documents))
    assert len(got) == len(texts) and all(expected(texts[i]) == m for i, m in got)


def test_odd_rows(odd_docs):
    got = sorted(measured(ledger(odd_docs)), key=repr)
    assert got == sorted([(r.doc_id, expected(r.text)) for r in odd_docs.collect()], key=repr)


def test_overlapping_windows_count_once(make_docs):
    texts = ["a b c a b c a b", "a a a a", "a b c x a b c", "a b", "a b c\na b c\n\n \n"]
    got = dict(measured(ledger(make_docs(list(enumerate(texts))))))
    assert got == {k: expected(t) for k, t in enumerate(texts)}


def test_policies_read_the_mask_only(odd_docs):
    entries = ledger(odd_docs).select("doc_id", "failed")
    for name, rules in POLICIES.items():
        kept = apply_policy(entries, name).collect()
        assert all(r.kept == (r.failed & mask_of(rules) == 0) for r in kept)


def test_ablation_counts(documents):
    masks = [r.failed for r in ledger(documents).collect()]
    got = {r.rule: (r.failing, r.only_by_it) for r in ablation(ledger(documents)).collect()}
    for rule in RULES:
        bit = mask_of([rule])
        assert got[rule] == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks))


def test_clean_stays_and_junk_goes(spark, documents, data_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    for r in quality_rules(documents).collect():
        if not r.base_failed and r.doc_id in labels:
            assert r.kept == bool(labels[r.doc_id])
        assert r.base_failed == bool(r.failed & mask_of(BASE)) and not (r.base_failed and r.kept)


def test_stage_keeps_the_columns(odd_docs, no_docs):
    kept = keep_passing(odd_docs)
    assert kept.schema == odd_docs.schema
    wanted = {(r.doc_id, r.n_words) for r in quality_rules(odd_docs).filter("kept").collect()}
    assert {(r.doc_id, len(WORD.findall(r.text))) for r in kept.collect()} == wanted and wanted
    assert keep_passing(no_docs).count() == 0 and ledger(no_docs).count() == 0


def test_plan_has_no_python(documents):
    assert "Python" not in quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
