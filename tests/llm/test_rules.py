
import pytest
from plain_versions import WORD, plain_base, plain_kept

from eventledger.llm import queries, rules
from eventledger.llm.common import read_table

@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_definition(spark, sf):
    rows = read_table(spark, f"/root/testdata/{sf}", "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_quality_rules(spark, f"/root/testdata/{sf}").collect()}
    kept = plain_kept([(r.lang, r.text) for r in rows])
    assert got == {r.doc_id: (*plain_base(r.text), k) for r, k in zip(rows, kept)}
    assert True in kept and False in kept


def test_odd_rows(spark):
    rows = [
        (1, None, "en", 5), (2, "", None, 5), (3, " \n\t", "xx", 5), (None, "a b c d e a b c d e x", None, 5),
        (4, "l one\nl one\nl one \n\n\n" + "w " * 9, "en", 5), (4, "Ж🙂 #$% <|>&* 1", "en", 5), (5, "word " * 300_000, "en", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = rules.measure(df)
    assert got.columns[:3] == ["doc_id", "text", "lang"]
    base = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert base == sorted((r[0] or 0, *plain_base(r[1])) for r in rows)
    assert rules.measure(df.limit(0)).collect() == []


def test_divergence():
    assert rules.divergence([1, 0], [0, 1]) == pytest.approx(1.0)
    assert rules.divergence([0.3, 0.7], [0.3, 0.7]) == 0.0


def test_a_rare_language_is_not_held_against_others(spark):
    """Clean Spanish below MIN_REFERENCE words, beside a large English corpus."""
    from_sf = read_table(spark, "/root/testdata/sf0.1", "documents").where("lang IN ('en', 'es')").orderBy("doc_id")
    texts = {lang: [r.text for r in from_sf.where(f"lang = '{lang}'").limit(400).collect()] for lang in ("en", "es")}
    few = [t for t in texts["es"] if 60 <= len(WORD.findall(t)) <= 400 and not plain_base(t)[-1]][:4]
    assert few and sum(len(WORD.findall(t)) for t in few) < rules.MIN_REFERENCE
    rows = [("en", t) for t in texts["en"]] + [("es", t) for t in few] + [(None, t) for t in texts["en"][:50]]
    got = rules.measure(spark.createDataFrame(rows, "lang string, text string")).collect()
    rare = [r for r in got if r.lang == "es"]
    assert len(rare) == len(few) and all(r.kept and r.char_divergence is None and r.word_divergence is None for r in rare)
    assert all(r.char_divergence is not None for r in got if r.lang != "es" and r.n_words >= rules.MIN_WORDS)


def test_every_language_of_enough_words_has_a_reference(spark):
    rows = spark.range(230).selectExpr("concat('l', id) AS lang", f"repeat(concat('w', id, ' '), {rules.MIN_REFERENCE} + CAST(id AS INT)) AS text")
    assert len(rules.references(rows)) == 230
