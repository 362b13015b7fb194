import numpy as np
import pytest
from pyspark.sql import functions as F

from eventledger.llm import mixing, queries
from eventledger.llm.common import read_table

SF = "/root/testdata/sf0.01"


def nearest(tokens, p, targets, rounds=200_000):
    """Plain projected gradient on the same least squares problem."""
    a = (tokens[:, None] * p).T / tokens.sum()
    rate = np.ones(len(tokens))
    t = targets / tokens.sum()
    step = 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(rounds):
        rate = np.maximum(0, rate - step * a.T @ (a @ rate - t))
    return a @ rate * tokens.sum()


def posterior_rows(spark, tokens, p):
    rows = [(int(n), *map(float, q)) for n, q in zip(tokens, p)]
    return spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in range(p.shape[1])))


@pytest.mark.parametrize("targets", [(0.5, 0.3, 0.2), (0.05, 0.05, 0.9), (0.9, 0.3, 0.4)])
def test_totals_meet_attainable_targets(spark, targets):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(0, 500, 300)
    wanted = np.array(targets) * tokens.sum()
    rows = posterior_rows(spark, tokens, p)
    steps, reached = mixing.fit_rates(rows, wanted)
    rates = np.array([r[0] for r in rows.select(mixing._rate(steps, 3)).collect()])
    assert (rates >= 0).all()
    assert np.allclose(reached, wanted, atol=2e-4 * tokens.sum())
    assert np.allclose((tokens * rates) @ p, reached)
    assert np.allclose(nearest(tokens, p, wanted, 20_000), wanted, atol=2e-2 * tokens.sum())


@pytest.mark.parametrize(
    "held, wanted",
    [((0.9495, 0.05, 0.0005), (0.94, 0.04, 0.02)), ((0.9492, 0.05, 0.0008), (0.94, 0.04, 0.02)),
     ((0.90, 0.0995, 0.0005), (0.90, 0.0995 / 4, 0.0005 / 4)), ((0.9, 0.099999, 0.000001), (0.94, 0.04, 0.02))],
)
@pytest.mark.parametrize("soft", [0.0, 1e-7])
def test_rare_domains_meet_their_targets(spark, held, wanted, soft):
    tokens = np.round(np.array(held) * 1e6).astype(int)
    p = np.eye(3) * (1 - 3 * soft) + soft
    total = np.array(wanted) * tokens.sum()
    rows = posterior_rows(spark, tokens, p)
    steps, reached = mixing.fit_rates(rows, total)
    rates = np.array([r[0] for r in rows.select(mixing._rate(steps, 3)).collect()])
    assert np.allclose(reached, total, atol=2e-6 * tokens.sum())
    assert np.allclose((tokens * rates) @ p, reached) and (rates >= 0).all()


def test_targets_out_of_reach_are_approached(spark):
    p = np.array([[0.6, 0.4], [0.5, 0.5], [0.4, 0.6]])
    tokens, wanted = np.array([10, 10, 10]), np.array([30.0, 0.0])
    _, reached = mixing.fit_rates(posterior_rows(spark, tokens, p), wanted)
    assert np.allclose(reached, nearest(tokens, p, wanted, 20_000), atol=1e-3)


def test_targets_out_of_reach_leave_rates_finite(spark):
    p = np.array([[0.6, 0.4], [0.5, 0.5], [0.4, 0.6]])
    rows = posterior_rows(spark, np.array([10, 10, 10]), p)
    steps, reached = mixing.fit_rates(rows, np.array([30.0, 0.0]))
    assert np.isfinite(reached).all() and (reached >= 0).all()


def test_query_meets_its_shares(spark):
    rows = queries.op1_mixing(spark, SF)
    got = rows.select((F.col("n_tokens") * F.col("rate")).alias("n"), "*").agg(
        *(F.sum(F.col("n") * F.col(f"p_{d}")).alias(d) for d in queries.SHARES), F.sum("n_tokens").alias("all"), F.min("rate").alias("least")
    ).first()
    assert got["least"] >= 0
    assert rows.count() == 1000
    assert all(abs(got[d] / got["all"] - share) < 1e-3 for d, share in queries.SHARES.items())
    names = {c for c in rows.columns if c.startswith("p_")}
    assert names == {"p_good", "p_low", "p_toxic"}


def test_posteriors_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = mixing.quality_domains(read_table(spark, sf, "labels"))
    rows, domains = mixing.mix(read_table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"), scale={"low": 0.25})
    judged = rows.join(labels.where("doc_id % 2 = 1"), F.col("_key") == F.col("doc_id"))
    good = judged.where("domain = 'good'").select(F.avg((F.col(f"p_{domains.index('good')}") > 0.5).cast("int"))).first()[0]
    bad = judged.where("domain <> 'good'").select(F.avg((F.col(f"p_{domains.index('good')}") > 0.5).cast("int"))).first()[0]
    assert good > 0.98 and bad < 0.5


def test_many_rare_words_tell_domains_apart(spark):
    """40 marker words a class, each in 2.5 % of its documents, one a document."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4000):
        mark = f"{'ab'[i % 2]}{i // 2 % 40}"
        rows.append((i, " ".join([*rng.choice(words, 30), mark])))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = df.where("doc_id < 2000").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    got = mixing.posteriors(df, mixing.fit(df, labels, "doc_id", "text")).collect()
    own = [r.p_1 if r._key % 2 else r.p_0 for r in got]
    assert min(own) > 0.8 and len(own) == 4000


def plain_posteriors(rows, labelled):
    """rows: (id, text), labelled: {id: domain} -> {id: posteriors}, in plain Python."""
    domains = sorted(set(labelled.values()))
    sets = {i: set(t.split()) for i, t in rows}
    own = {d: sum(x == d for x in labelled.values()) for d in domains}
    total = sum(own.values())
    weight = {}
    for w in {w for i in labelled for w in sets[i]}:
        seen = {d: sum(w in sets[i] for i, x in labelled.items() if x == d) for d in domains}
        for d in domains:
            a, b, n, m = seen[d], sum(seen.values()) - seen[d], own[d], total - own[d]
            cells = [(a, (a + b) * n / total), (b, (a + b) * m / total), (n - a, (total - a - b) * n / total), (m - b, (total - a - b) * m / total)]
            sure = 2 * sum(x * np.log(x / e) for x, e in cells if x)
            odds = np.log((a + n / total) / (n + 1)) - np.log((b + m / total) / (m + 1))
            weight[w, d] = odds if sure >= 16 and abs(odds) >= 1 else 0.0
    out = {}
    for i, found in sets.items():
        part = min(1.0, 400 / max(1, len(found)))
        score = np.array([part * sum(weight.get((w, d), 0.0) for w in found) + np.log(own[d] / total) for d in domains])
        out[i] = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    return out


def test_posteriors_and_rates_equal_plain_versions(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        kind = i % 3
        rows.append((i, " ".join([*rng.choice([f"w{k}" for k in range(60)], rng.integers(1, 40)), *rng.choice([f"m{kind}{k}" for k in range(4)], 2 * (i % 2))])))
    labelled = {i: "abc"[i % 3] for i in range(0, 240, 2)} | {i: "abc"[i % 3] for i in range(1, 120, 2)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, domain string")
    got = {r._key: r for r in mixing.mix(df, labels, shares={"a": 0.5, "b": 0.2, "c": 0.3})[0].collect()}
    want = plain_posteriors(rows, labelled)
    assert all(np.allclose([got[i].p_0, got[i].p_1, got[i].p_2], want[i], atol=1e-9) for i in want)
    tokens = np.array([len(t.split()) for _, t in rows], float)
    p = np.array([want[i] for i in range(240)])
    targets = np.array([0.5, 0.2, 0.3]) * tokens.sum()
    rates = np.array([got[i].rate for i in range(240)])
    assert (rates >= 0).all() and np.allclose((tokens * rates) @ p, targets, atol=1e-4 * tokens.sum())
    a = (tokens[:, None] * p).T / tokens.sum()
    plain, step = np.ones(240), 1 / np.linalg.eigvalsh(a @ np.diag(1 / tokens) @ a.T * tokens.sum()).max()
    for _ in range(20_000):  # projected gradient, each document's step by its tokens, as in the least squares
        plain = np.maximum(0, plain - step * (p @ (a @ plain - targets / tokens.sum())))
    assert np.allclose(rates, plain, atol=0.02)


def test_whole_copies_keep_the_totals(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, int(rng.integers(1, 3000)), float(i % 2), float(1 - i % 2), 0.25 if i % 2 else 1.04) for i in range(2000)]
    rows += [(5000 + i, 0, int(rng.integers(1, 900)), 1.0, 0.0, 2.6) for i in range(300)]
    df = spark.createDataFrame(rows, "_key long, _tag int, n_tokens long, p_0 double, p_1 double, rate double").repartition(5)
    got = mixing.whole_copies(df, 2).collect()
    assert len(got) == len(rows) and all(r.copies == 1 for r in got if r.rate == 1.04)
    for rate, counts in ((0.25, {0, 1}), (2.6, {2, 3})):
        own = [r for r in got if r.rate == rate]
        assert {r.copies for r in own} <= counts
        wanted = rate * sum(r.n_tokens for r in own)
        assert abs(sum(r.n_tokens * r.copies for r in own) / wanted - 1) < 0.01
    assert mixing.whole_copies(df.limit(0), 2).collect() == []


def test_no_python_in_the_plans(spark):
    rows, _ = mixing.mix(read_table(spark, SF, "documents"), mixing.quality_domains(read_table(spark, SF, "labels")))
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()


def test_odd_rows(spark):
    rows = [(1, "a b", 1.0), (1, "a b", 1.0), (None, "c", 0.5), (2, None, 0.1), (3, "", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(1, "x"), (1, "a"), (None, "a"), (2, None), (9, "b")], "doc_id long, domain string")
    got, domains = mixing.mix(df, labels, shares={"a": 2.0})
    assert domains == ["a"] and got.count() == 5
    assert {round(r.rate, 2) for r in got.collect()} == {2.0}
    assert {r.n_tokens for r in got.where("_key < 4").collect()} == {2, 0}
    nameless, domains = mixing.mix(df, labels.limit(0))
    assert domains == [""] and {r.rate for r in nameless.collect()} == {1.0}
    assert mixing.mix(df.limit(0), labels)[0].collect() == []
    share = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(share - 1.3) < 0.02
