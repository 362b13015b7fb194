"""The pipeline's stages against plain versions of the same decisions."""

import pytest
from plain_versions import WORD, plain_base, plain_components, plain_fingerprint, plain_kept, plain_passages

from pyspark.sql import functions as F

import corpus_pipeline
from eventledger.llm import mixing, pieces, queries
from eventledger.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    kept = {i for (i, r), k in zip(rows.items(), plain_kept([(r.lang, r.text) for r in rows.values()])) if k}
    assert {r.doc_id for r in seen[0].collect()} == kept and all(not plain_base(rows[i].text)[-1] for i in kept)
    label = plain_components([(i, plain_fingerprint(rows[i].text)) for i in sorted(kept)])
    single = {i for i in kept if label[i] == i}
    assert {r.doc_id for r in seen[1].collect()} == single < kept
    cut = {i: (n, gone, words) for i, n, gone, words in plain_passages([(i, rows[i].text) for i in single])}
    third = {r.doc_id: r for r in seen[2].collect()}
    assert set(third) == {i for i, (n, gone, _) in cut.items() if n > gone}
    assert all(" ".join(WORD.findall(r.text)) == cut[i][2] and r.n_chars == len(r.text) for i, r in third.items())
    rated, _ = mixing.mix(seen[2], mixing.quality_domains(read_table(spark, SF, "labels")), scale=corpus_pipeline.SCALE)
    rates = {r._key: r.rate for r in rated.collect()}
    fourth = seen[3].collect()
    copies = {i: [r.doc_id for r in fourth].count(i) for i in third}
    assert all(r.doc_id in rates for r in fourth) and all(copies[i] == 1 for i, rate in rates.items() if abs(rate - 1) <= mixing.NEAR_ONE)
    assert all(int(rate) <= copies[i] <= int(rate) + 1 for i, rate in rates.items() if abs(rate - 1) > mixing.NEAR_ONE)
    assert all(d.columns == columns for d in seen[:4])
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = {r.doc_id: r.text for r in fourth}
    last = seen[4].collect()
    assert len(last) == len(fourth)
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in last)
    decoded = pieces.decode(seen[4], pieces.Model.load(queries.PIECES)).collect()
    assert all(r.decoded == texts[r.doc_id] for r in decoded)


def test_mixing_meets_its_totals(spark):
    """Expected tokens of each domain in what is kept, against those that the scale asks for."""
    sf = "/root/testdata/sf0.1"
    docs = read_table(spark, sf, "documents")
    labels = mixing.quality_domains(read_table(spark, sf, "labels"))
    rated, domains = mixing.mix(docs, labels, scale=corpus_pipeline.SCALE)
    rated = rated.cache()
    kept = corpus_pipeline.mixture(spark, docs, sf).groupBy("doc_id").count()
    read = rated.join(kept, F.col("_key") == F.col("doc_id"), "left").withColumn("times", F.coalesce("count", F.lit(0)))
    for d, name in enumerate(domains):
        tokens = F.col("n_tokens") * F.col(f"p_{d}")
        mostly = F.coalesce(*(F.when(F.col(f"p_{k}") > 0.5, corpus_pipeline.SCALE[n]) for k, n in enumerate(domains) if n in corpus_pipeline.SCALE), F.lit(1.0))
        wanted, rates, got = read.agg(F.sum(tokens * mostly), F.sum(tokens * F.col("rate")), F.sum(tokens * F.col("times"))).first()
        print(name, round(wanted), round(rates), round(got))
        assert abs(rates / wanted - 1) < 0.005 and abs(got / wanted - 1) < 0.02
    rated.unpersist()


def test_empty_and_odd_documents(spark):
    documents = read_table(spark, SF, "documents")
    odd = documents.limit(0).union(spark.createDataFrame([(None, None, None, None, None)] * 2, documents.schema))
    docs = odd.union(documents.limit(60)).union(documents.limit(3))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 20
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
