import random

import pytest
from plain_versions import plain_components, plain_fingerprint

from eventledger.llm import queries, simhash
from eventledger.llm.common import read_table
from eventledger.llm.components import components

SF = "/root/testdata/sf0.001"


def unsigned(x):
    return x & (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, name):
    sf = f"/root/testdata/{name}"
    got = queries.op9_simhash_near_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    codes = {i: plain_fingerprint(t) for i, t in texts.items()} if name == "sf0.001" else None
    found = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert len(found) == len(texts)
    if codes:
        assert dict(found) == codes
    assert {r.doc_id: r.component_id for r in got} == plain_components(found)


def test_dense_neighbourhood_over_partitions(spark, monkeypatch):
    """Thousands of fingerprints that differ from a base in a few bits of one block's rest."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 4000:
        x = base
        for b in rng.sample(range(64), rng.randint(1, 14)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    monkeypatch.setattr(simhash, "PART_ROWS", 700)
    monkeypatch.setattr(simhash, "LEAF", 100)
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = simhash.links(rows, len(values))
    roots = {r.node: r.root for r in components(edges, "test").collect()}
    want = plain_components(list(enumerate(values)))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(roots.get(signed(v), signed(v)), set()).add(i)
    expected = {}
    for i, c in want.items():
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_more_blocks_give_the_same_links(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        x = v
        for b in rng.sample(range(64), rng.choice([3, 4, 5])):
            x ^= 1 << b
        values.append(x)
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    pairs = lambda n: {
        frozenset(r) for r in simhash.links(rows, n).collect()
    }
    assert pairs(120) == pairs(1 << 26) == {
        frozenset((signed(a), signed(b))) for a in values for b in values if 0 < (a ^ b).bit_count() <= 4
    }


def test_odd_rows(spark):
    rows = [
        (1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "A  b\tC d\ne", None), (4, None, "x"),
        (5, "", "x"), (6, " \n", "x"), (7, "one", "x"), (None, "zwölf Ä ein zwei drei vier", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8
    assert [unsigned(r.fp) for r in got if r._key == 7] == [plain_fingerprint("one")]
    assert {r.component for r in got if r.fp == got[0].fp} and all(
        r.component == 1 for r in got if unsigned(r.fp) == plain_fingerprint("a b c d e")
    )
    assert {(r._key, r.component) for r in got if r.fp == 0} == {(4, 4), (5, 4), (6, 4)}
    stay = simhash.one_of_each(df, simhash.near_duplicates(df)).collect()
    assert sorted((r.doc_id or 0) for r in stay) == [0, 1, 4, 7]
    assert stay[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    root = lambda x: got.get(x, x)
    assert len({root(i) for i in range(301)}) == 1
    assert len({root(i) for i in range(1000, 1201)}) == 1
    assert root(0) != root(1000) and root(5000) == 5000
