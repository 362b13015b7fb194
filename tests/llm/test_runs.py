import hashlib
import random
import zlib

import numpy as np
import pytest
from plain_versions import WORD

from eventledger.llm import queries, runs
from eventledger.llm.common import read_table


def plain_runs(words, min_length=24, min_exponent=3):
    """Runs by comparing the words with themselves at every distance."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(min_length, min_exponent * q):
                found.setdefault((start, length), q)  # the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None,) * 4
    for s, length, q in sorted(found, key=lambda r: (r[0], r[2])):
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert got.keys() == rows.keys()
    short = [i for i, t in rows.items() if len(WORD.findall(t or "")) < 4000]
    assert len(short) > 150 and all(got[i] == plain_row(i, rows[i]) for i in short)
    assert sum(r[1] > 0 for r in got.values()) > 10


def sequences(count, longest):
    rng = random.Random(9)
    for _ in range(count):
        n, letters = rng.randint(0, longest), rng.randint(1, 5)
        words = [rng.randint(1, letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
                b = rng.randint(a, n)
                words[a:b] = [words[a + (i - a) % p] if a + (i - a) % p < n else 1 for i in range(a, b)]
        yield words


@pytest.mark.parametrize("limits", [(2, 2), (5, 2), (4, 3), (9, 3), (24, 3), (24, 5)])
def test_runs_equal_brute_force(limits):
    for words in sequences(300, 60 if limits[0] < 24 else 200):
        assert [tuple(r) for r in runs.runs_of(np.array(words, np.int64), *limits).tolist()] == plain_runs(words, *limits)


def test_stretches_hold_all_runs():
    docs = list(sequences(400, 150))
    codes = np.array([w for d in docs for w in d], np.uint64)
    sizes = np.array([len(d) for d in docs])
    begins = np.cumsum(sizes) - sizes
    found = {}
    for first, last in runs._stretches(codes, np.repeat(np.arange(len(docs)), sizes), 8, 24):
        doc = int(np.searchsorted(begins, first, side="right")) - 1
        own = runs.runs_of(codes[first:last])
        found.setdefault(doc, []).extend((int(s + first - begins[doc]), int(n), int(q)) for s, n, q in own)
    for d, words in enumerate(docs):
        assert sorted(found.get(d, []), key=lambda r: (r[0], r[2])) == plain_runs(words)


def test_extensions_and_tours():
    rng = random.Random(4)
    for _ in range(100):
        words = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        tree, n = runs.SuffixTree(words), len(words)
        for sign in (1, -1):
            order = sorted(range(n + 1), key=lambda i: [sign * w for w in words[i:]])
            assert tree.tour(descending=sign < 0)[0] == order
        common = runs.Extensions(tree)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        plain = [next((k for k in range(n) if words[i + k : i + k + 1] != words[j + k : j + k + 1] or max(i, j) + k >= n), 0) for i, j in pairs]
        assert common.at(*np.array(pairs).T).tolist() == plain


def test_odd_rows(spark):
    loop = "la di da " * 20
    rows = [
        (1, None, "n"), (2, "", "n"), (3, " \t\n", "n"), (None, loop, "x"), (4, loop, "x"), (4, loop, "x"),
        (5, "one " * 23, "n"), (6, "one " * 24, "x"), (7, "a b c " * 40, "x"), (8, "x y z " * 60_000, "x"),
        (9, " ".join(f"w{i % 5000}" for i in range(150_000)), "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", queries.F.lit(7))
    got = runs.find_runs(df.select("doc_id", "text", "runs", "collapsed")).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id) == sorted((False, r[0]) for r in rows if r[0])
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed, r.n_words))
    for key, text, _ in rows[:9]:
        words = WORD.findall(text or "")
        found = plain_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want = (found, " ".join(w for i, w in enumerate(words) if i not in gone), len(words))
        assert all(x == want for x in by_id[key])
    assert len(by_id[4]) == 2
    assert by_id[8] == [([(0, 180_000, 3)], "x y z", 180_000)]
    assert by_id[9][0][0] == [(0, 150_000, 5000)]
    assert runs.find_runs(df.limit(0)).collect() == []


def test_short_phrases_and_other_limits(spark):
    df = spark.createDataFrame([(1, "a b a b c c c")], "doc_id long, text string")
    row = runs.find_runs(df, min_length=2, min_exponent=2).first()
    assert [tuple(r) for r in row.runs] == [(0, 4, 2), (4, 3, 1)] and row.collapsed == "a b c"
    with pytest.raises(ValueError):
        runs.find_runs(df, min_exponent=1)
