"""Licence scans, language identification and the quality classifier."""

import random
import time

import pytest
from pyspark.sql import functions as F

from eventledger.llm import cotraining, langid, licenses, queries
from eventledger.llm.common import read_table

SF = "/root/testdata/sf0.01"


def test_all_notices_are_found(spark):
    got = queries.op6_license_scan(spark, SF)
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    plain = lambda text: text.replace(",", "")
    notices = {n: t for n, t in licenses.TEMPLATES.items() if len(t) < 90}
    want = {(i, n) for i, t in texts.items() for n, notice in notices.items() if plain(notice) in plain(t)}
    assert want and {(r.doc_id, r.license) for r in got.collect()} == want
    for r in got.collect():
        assert plain(texts[r.doc_id][r.first_char : r.last_char]).rstrip(".") == plain(licenses.TEMPLATES[r.license])
        assert r.coverage == 1.0


def test_changed_and_repeated_texts(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    changed = [w for i, w in enumerate(mit) if i % 11 != 5]
    changed.insert(20, "indeed")
    notice = licenses.TEMPLATES["MIT notice"]
    rows = [
        (1, "x " * 50 + " ".join(changed).upper() + " y" * 50), (2, (notice + "\n") * 3), (3, " ".join(mit[:40])),
        (4, "released under the * MIT License!"), (5, None), (6, ""), (None, notice), (7, "Licensed under nothing"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(0))
    got = licenses.scan(df).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert set(by_id) == {1, 2, 4, None}
    assert by_id[1][0].license == "MIT" and by_id[1][0].matched == len(changed) - 1
    assert (by_id[1][0].first_word, by_id[1][0].last_word) == (50, 50 + len(changed))
    assert [r.first_word for r in sorted(by_id[2], key=lambda r: r.first_word)] == [0, 5, 10]
    assert by_id[4][0].coverage == 1.0
    assert licenses.scan(df.limit(0)).collect() == []


GNU = (
    "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as "
    "published by the Free Software Foundation{b} either version {v} of the License, or (at your option) any later version."
)


def found_in(text):
    index = licenses.Index(licenses.TEMPLATES)
    return [(index.names[t], matched, len(index.words[t])) for t, matched, *_ in licenses.scan_text(text.encode(), index)]


def test_versions_of_a_family_are_told_apart():
    heads = {
        "GPL-2.0 header": GNU.format(what="program", a=";", name="", b=";", v="2"),
        "GPL-3.0 header": GNU.format(what="program", a=":", name="", b=",", v="3"),
        "LGPL-2.1 header": GNU.format(what="library", a=";", name="Lesser ", b=";", v="2.1"),
        "LGPL-3.0 header": GNU.format(what="library", a=":", name="Lesser ", b=",", v="3"),
        "AGPL-3.0 header": GNU.format(what="program", a=":", name="Affero ", b=",", v="3"),
    }
    for name, text in heads.items():
        assert [n for n, matched, size in found_in(f"// {text}\n// more") if matched == size] == [name]
        assert len(found_in(text)) == 1
    assert found_in(GNU.format(what="library", a=";", name="Library ", b=";", v="2")) == []
    assert found_in(GNU.format(what="program", a=";", name="", b=";", v="1")) == []
    both = found_in(" and ".join(heads.values()))
    assert [n for n, _, _ in both] == list(heads)


def test_whole_texts_and_their_parts():
    for name in ("MIT", "MIT permission", "ISC", "ISC permission", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause conditions", "Unlicense"):
        words = licenses.TEMPLATES[name].split()
        assert [n for n, _, _ in found_in("Copyright (c) 2020 me\n" + "\n".join(words) + " end")] == [name]
        words[len(words) // 3] = "other"
        assert [n for n, _, _ in found_in(" ".join(words))] == [name]


def test_equal_matches_go_by_coverage_and_many_take_little_time():
    assert [n for n, _, _ in found_in(licenses.TEMPLATES["GPL-3.0 header"])] == ["GPL-3.0 header"]
    start = time.perf_counter()
    assert len(found_in(" ; ".join([licenses.TEMPLATES["MIT notice"], "text between"] * 20_000))) == 20_000
    assert time.perf_counter() - start < 30


def test_templates_without_a_shingle_raise(spark):
    with pytest.raises(ValueError, match="fewer than"):
        licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"two": "two words"})


def test_alignment_equals_longest_common_sequence():
    rng = random.Random(8)
    for _ in range(60):
        a = [rng.randint(1, 6) for _ in range(12)]
        b = [rng.randint(1, 6) for _ in range(16)]
        table = [[0] * 17 for _ in range(13)]
        for i in range(12):
            for j in range(16):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], (table[i][j] + 1) if a[i] == b[j] else 0)
        matched, first, last = licenses.align(a, [None] * 20 + b, 40)
        assert matched == table[12][16] and last - first >= matched


def test_languages_of_pages(spark):
    model = langid.fit(read_table(spark, SF, "documents"))
    assert model[0] == ["de", "en", "es", "fr"]
    rows = read_table(spark, SF, "pages")
    got = {r.page_id: r for r in queries.op8_language_id(spark, SF).collect()}
    declared = {r.page_id: r.html.split('lang="')[1][:2] for r in rows.collect()}
    right = sum(got[i].lang == lang for i, lang in declared.items()) / len(declared)
    assert right > 0.98
    bare = rows.withColumn("html", F.regexp_replace("html", 'lang="[a-z]+"', ""))
    blind = {r.page_id: r for r in langid.identify(bare, model).collect()}
    assert sum(blind[i].lang == lang for i, lang in declared.items()) / len(declared) > 0.95
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_host_and_declaration_decide_without_text(spark):
    model = langid.fit(read_table(spark, SF, "documents"))
    texts = {r.lang: r.text for r in read_table(spark, SF, "documents").where("n_chars > 900 AND doc_id < 300").collect()}
    page = lambda lang, text: f"<html lang='{lang}'><article><p>{text}</p></article>"
    rows = [(i, "http://a.test/x", page("de", texts["de"])) for i in range(20)]
    rows += [(100 + i, "http://b.test/x", page("fr", texts["fr"])) for i in range(20)]
    rows += [(200, "http://a.test/y", ""), (201, None, "<html lang=fr>"), (202, "http://b.test/", None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit(3))
    got = {r.page_id: r.lang for r in langid.identify(df, model).collect()}
    assert (got[200], got[201], got[202]) == ("de", "fr", "fr") and None in got
    assert langid.identify(df.limit(0), model).collect() == []
    empty = langid.fit(read_table(spark, SF, "documents").limit(0))
    assert {r.lang for r in langid.identify(df, empty).collect()} == {None}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = read_table(spark, sf, "labels")
    got = cotraining.classify(read_table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"))
    judged = got.join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.3


def test_classifier_on_odd_rows(spark):
    rows = [(1, "good text here", "en", "s", 0.3), (1, "good text here", "en", "s", 0.3), (None, None, None, None, None), (2, "", "", "", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p_good double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = cotraining.classify(df, labels)
    assert got.columns == ["doc_id", "p_text", "p_meta", "p_good", "kept"]
    assert got.count() == 4 and got.where("doc_id IS NULL").count() == 1
    assert {r.p_good for r in cotraining.classify(df, labels.limit(0)).collect()} == {0.5}
    assert {r.kept for r in cotraining.classify(df, labels.where("quality = 1 AND doc_id = 2")).collect()} == {True}
    assert cotraining.classify(df.limit(0), labels).collect() == []
