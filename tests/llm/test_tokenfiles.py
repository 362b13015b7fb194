import random
import zlib

import numpy as np
import pytest

from eventledger.llm import queries, tokenfiles
from eventledger.llm.common import read_table

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return tokenfiles.Encoder.load(public_tokenizers.path("word_bpe_49k.json"), queries.END_ID)


def plain_rows(encoder, rows):
    """rows: (id, text) in order -> (id, start, ids) by the library on whole texts."""
    tokenizer, start, out = encoder.tokenizer(), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, queries.END_ID]
        out.append((key, start, ids))
        start += len(ids)
    return out


def read_back(df):
    return [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in df.orderBy("start").collect()]


def test_query_equals_the_library(spark, encoder):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = [(key, start, len(ids), crc(ids)) for key, start, ids in plain_rows(encoder, rows)]
    assert sorted(map(tuple, queries.op11_token_files(spark, sf).collect())) == want


def test_odd_texts(spark, tmp_path, encoder, monkeypatch):
    rng = random.Random(5)
    letters = list("abcXYZ''sd012 \t\n\v\f\r  -éÉßẞΣσς漢字🙂́ͅ​  ẛİ.,!<|>")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(1500)]
    texts += ["", None, " ", "\n" * 50, "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "it's we'll I'd", " ́ x", "ab" * 400_000, "w " * 400_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    monkeypatch.setattr(tokenfiles, "PIECE_BYTES", 1000)  # in this process only; workers keep theirs
    assert [*tokenfiles._pieces(b"ab " * 5000)][0].startswith(b"ab ab")
    assert b" ".join(tokenfiles._pieces(b"ab " * 5000)).split() == [b"ab"] * 5000
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, _key int")
    path = str(tmp_path / "tokens")
    tokenfiles.write(df.repartition(5), path, encoder, block_ids=5000)
    whole = plain_rows(encoder, sorted(rows))
    assert read_back(tokenfiles.read(spark, path)) == whole
    flat = [i for _, _, ids in whole for i in ids]
    for first, last in [(0, 10), (4990, 15_020), (len(flat) - 3, len(flat) + 50), (7, 7)]:
        got = sorted(tokenfiles.read_span(spark, path, first, last).collect())
        assert [i for r in got for i in r.ids] == flat[first:last]
        assert all(flat[r.place : r.place + len(r.ids)] == r.ids for r in got)


def test_ties_null_ids_and_repeated_rows(spark, tmp_path, encoder):
    rows = [(3, "b"), (None, "last"), (1, "a"), (1, "a"), (1, "another"), (None, None), (-5, "first")]
    path = str(tmp_path / "tokens")
    tokenfiles.write(spark.createDataFrame(rows, "doc_id int, text string"), path, encoder)
    got = read_back(tokenfiles.read(spark, path))
    assert [key for key, _, _ in got] == [-5, 1, 1, 1, 3, None, None]
    ends = np.cumsum([len(ids) for _, _, ids in got])
    assert [start for _, start, _ in got] == [0, *ends[:-1]]
    plain = [ids for _, _, ids in plain_rows(encoder, rows)]
    assert sorted(ids for _, _, ids in got) == sorted(plain)


def test_empty_table(spark, tmp_path, encoder):
    path = str(tmp_path / "tokens")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, encoder)
    assert tokenfiles.read(spark, path).collect() == [] == tokenfiles.read_span(spark, path, 0, 9).collect()


def test_frequent_ids_take_one_byte(spark, tmp_path, encoder):
    path = str(tmp_path / "tokens")
    tokenfiles.write(spark.createDataFrame([(1, "zebra " * 900 + "quux apple")], "doc_id long, text string"), path, encoder)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert ranks[0].n == 900 and [r.rank for r in ranks] == list(range(len(ranks)))
    block = spark.read.parquet(f"{path}/blocks").first()
    assert len(block.data) == block.n_ids and len(block.control) == -(-block.n_ids // 4)


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 3, 4, 5, 1000]:
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfiles.pack(values)
        lengths = [max(1, (int(v).bit_length() + 7) // 8) for v in values]
        assert data == b"".join(int(v).to_bytes(k, "little") for v, k in zip(values, lengths))
        assert [control[i // 4] >> 2 * (i % 4) & 3 for i in range(n)] == [k - 1 for k in lengths]
        assert tokenfiles.unpack(control, data, n).tolist() == values.tolist()


def test_damaged_blocks_are_found(spark, tmp_path, encoder):
    path = str(tmp_path / "tokens")
    tokenfiles.write(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path, encoder)
    row = spark.read.parquet(f"{path}/blocks").first().asDict()
    row["data"] = bytes(row["data"][:-1]) + b"\x7f"
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles._decoded(row, np.arange(100, dtype=np.uint32))


def test_tokenizers_that_look_across_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokenfiles.Encoder.load(public_tokenizers.path("byte_bpe_50k.json"))
