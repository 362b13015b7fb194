import hashlib
import zlib

import pytest
from check_oracle import differences
from pyspark.sql import functions as F

from eventledger.llm import manifest, queries
from eventledger.llm.common import read_table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out += level[i ^ 1 : (i ^ 1) + 1]
        i >>= 1
    return out


def plain_manifest(rows):
    """rows: tuples of FIELDS -> sorted (id, leaf, subroot, root, digest of siblings)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is None, row[0] or 0, plain_leaf(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_levels([m[2] for m in sorted(groups[g], key=lambda m: m[:3])]) for g in names]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for g, (name, tree) in enumerate(zip(names, trees)):
        for i, member in enumerate(sorted(groups[name], key=lambda m: m[:3])):
            proof = "".join(siblings(tree, i) + siblings(top, g))
            out.append((member[3], member[2], tree[-1][0], top[-1][0], proof))
    return sorted(out, key=str)


def built(df, **options):
    made = manifest.build(df, FIELDS, **options)
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")


def test_query_equals_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", "op13", queries.op13_merkle_manifest, queries.OP13_SQL) is None


def test_query_equals_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in read_table(spark, sf, "documents").select(FIELDS).collect()]
    want = {r[0]: r for r in plain_manifest(rows)}
    got = queries.op13_merkle_manifest(spark, sf).collect()
    assert {r.doc_id for r in got} == want.keys() and len(got) == len(rows)
    for r in got:
        doc_id, leaf, subroot, root, proof = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, sha(proof))
        hit = zlib.crc32(str(doc_id).encode()) % 7 == 0
        assert r.verified == (not hit) == (r.folded_root == root)
    assert any(not r.verified for r in got)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 3, None: 1}, {"a": 1024, "b": 1025}, {"a": 2500, "": 5, "é": 1, "z": 7}])
def test_sizes_around_slot_arrays(spark, sizes):
    rows = [(i * 37 - 500, "s", lang, i, f"t{i}") for lang, n in sizes.items() for i in range(n)]
    assert built(frame(spark, rows).repartition(3)) == plain_manifest(rows)


def test_several_levels_of_slot_arrays(spark):
    rows = [(i, "s", lang, i, f"t{i}") for lang, n in {"a": 1, "b": 17, "c": 300, "d": 64, "e": 5}.items() for i in range(n)]
    assert built(frame(spark, rows), fan_bits=2) == plain_manifest(rows)


def test_nulls_ties_repeats_and_distant_ids(spark):
    rows = [
        (None, None, None, None, None), (None, "s", None, 1, ""), (None, "s", None, 1, ""), (5, "s", None, 2, "x"),
        (5, "s", "en", 2, "x"), (5, "s", "en", 2, "x"), (5, "t", "en", 2, "y"), (6, "t", "en", 2, "y"), (4, "", "en", -3, "é🙂"),
        (-(1 << 63), "a", "en", 0, "low"), ((1 << 63) - 2, "a", "en", 0, "high"), (1 << 40, "a", "en", 0, "far"), (511, "q", "en", 1, "q"),
        (512, "q", "en", 1, "q"), (63, "q", "en", 1, "q"), (64, "q", "en", 1, "q"), (-1, "q", "en", 1, "q"), (-1, "r", "en", 1, "q"),
        (7, "q", "", 1, "x" * 3_000_000),
    ]
    df = frame(spark, rows).withColumn("node", F.lit(1)).withColumn("_g", F.lit("x")).withColumn("n", F.lit(0))
    assert built(df) == plain_manifest(rows)


def test_one_id_in_a_third_of_the_rows(spark):
    rows = [(i if i % 3 else 12, "s", "en" if i % 5 else None, i, f"t{i % 50}") for i in range(1200)]
    assert built(frame(spark, rows).repartition(4)) == plain_manifest(rows)


def test_empty_table(spark):
    assert built(frame(spark, [])) == []
    assert manifest.fold(manifest.build(frame(spark, []), FIELDS)).collect() == []


def test_fold_finds_changed_claims(spark):
    rows = [(i, "s", "en" if i < 9 else "de", i, f"t{i}") for i in range(15)]
    made = manifest.build(frame(spark, rows), FIELDS, keep={"claim": F.when(F.col("doc_id") != 3, manifest.leaf(F.lit("x")))})
    root = made.first().root
    honest = manifest.fold(made).collect()
    assert all(r.folded_root == root for r in honest)
    lied = {r.doc_id: r.folded_root for r in manifest.fold(made, "claim").collect()}
    assert lied.pop(3) is None and all(v != root for v in lied.values())
