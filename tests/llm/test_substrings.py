import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from plain_versions import WORD, plain_passages

from eventledger.llm import queries, substrings

def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op5_substring_dedup(spark, sf).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{Path(sf)}/documents.parquet')")
        assert got == set(db.execute(queries.OP5_SQL).fetchall())
    assert any(r[2] for r in got) and hashlib.sha256(b"").hexdigest() not in {r[3] for r in got if r[1] > r[2]}


@pytest.mark.parametrize(("buffer", "heavy"), [(60, 400), (60, 3), (1_500_000, 3), (1_500_000, 400)])
def test_equals_definition_on_overlapping_repeats(spark, monkeypatch, buffer, heavy):
    monkeypatch.setattr(substrings, "BUFFER_WORDS", buffer)
    monkeypatch.setattr(substrings, "GROUP_WINDOWS", 50)
    monkeypatch.setattr(substrings, "SAMPLE", 1.0)
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 30)}" for _ in range(300)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 270)
            parts += base[a : a + rng.randint(5, 60)] + [f"x{rng.randint(0, 9)}"] * rng.choice([1, 2, 45])
        rows.append((rng.randint(0, 30), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substrings.remove_repeats(df)) == plain_passages(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{n}" for n in range(25))
    other = "\n".join(["lead in", text, "tail  end"])
    rows = [(1, text, 9), (1, text, 9), (None, text, 8), (2, other, None), (3, None, 1), (4, "", 1), (5, "é " * 50, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = substrings.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert found(got) == plain_passages([r[:2] for r in rows])
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[2] == "lead in\ntail  end" and texts[3] is None and texts[4] == "" and texts[None] == ""
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def test_very_long_text(spark):
    rows = [(1, "a b c d e f g " * 60_000), (2, " ".join(map(str, range(300_000))))]
    got = found(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(g[1], g[2]) for g in got] == [(420_000, 420_000 - 7), (300_000, 0)]


def test_a_phrase_that_most_suffixes_share_is_spread(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE", 1.0)
    monkeypatch.setattr(substrings, "HEAVY", 5_000)
    codes = substrings.WordCodes()

    def phrase_hash(words):
        return int(substrings._window_hashes(np.array([codes[w.encode()] for w in words], np.uint64), 6, 6)[0][0])

    tagline = min(([*"read our terms before you".split(), f"go{n}"] for n in range(200)), key=phrase_hash)
    rows = [(i, " ".join([*(f"{i}a{n}" for n in range(15)), *tagline, *(f"{i}b{n}" for n in range(15))])) for i in range(1000)]
    rows += [(5000 + i, t) for i, t in rows[:50]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.selectExpr("doc_id _key", "hash(text) _tag", "cast(text as binary) _text")
    heavy = substrings._heavy_phrases(texts, 20, 6)
    assert [h % (1 << 64) for h in heavy] == [phrase_hash(tagline)]

    def sizes(phrases):
        total = Counter()
        for batch in substrings._suffix_records(texts.toArrow().to_batches(), 16, 20, 6, phrases, 10**9):
            for kind, group, payload in zip(*(c.to_pylist() for c in batch.columns)):
                total[group] += len(payload) * (kind == 0)
        return total

    assert max(sizes([]).values()) > 0.5 * sum(sizes([]).values())
    assert max(sizes(heavy).values()) < 0.15 * sum(sizes(heavy).values())
    assert found(substrings.remove_repeats(df, phrase=6)) == plain_passages(rows)
