import random
import time

import numpy as np
import pytest

from eventledger.llm import pieces, queries
from eventledger.llm.common import read_table

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(queries.PIECES)


def odd_texts(model):
    rng = random.Random(1)
    letters = list("abcdeinrst  ▁éüß漢字の☃🙂\n\t.,'0019")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500)]
    plain = [p for p, t in zip(model.pieces, model.types) if t == 1]
    texts += ["".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(1000)]
    return [*texts, "", " ", "\n", " " * 30 + "x" + " " * 37, None, "ab" * 3000, "x " * 50000]


def test_ids_are_those_of_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = odd_texts(model)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(rows, model).collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}


def test_query_on_all_documents(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    got = queries.op2_sentencepiece(spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_unigram_models_maximise_scores():
    """A hand-made vocabulary against all segmentations."""
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.4, "▁": -0.5, "▁a": -1.2, "bb": -2.9}
    words = ["▁", *scores]
    model = pieces.Model(
        pieces.UNIGRAM, ["<unk>", *scores], [2, *[1] * len(scores)], [0.0, *scores.values()], 0, True, []
    )
    encoder = pieces.Encoder(model)

    def best(word):
        ways = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            ways[end] = max(
                (ways[i][0] + scores[word[i:end]], ways[i][1] + [word[i:end]]) for i in range(end) if word[i:end] in scores
            )
        return ways[-1]

    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(200)]
    for word, ids in zip(words, encoder.solve(words)):
        import numpy as np

        found = [model.pieces[i] for i in np.frombuffer(ids, "<i4")]
        assert "".join(found) == word
        assert sum(scores[p] for p in found) == pytest.approx(best(word)[0])


def test_clashing_columns_and_empty_tables(spark, model):
    rows = spark.createDataFrame([("hello", "x", 1)], "text string, ids string, _text int")
    got = pieces.decode(pieces.encode(rows, model), model).collect()
    assert got[0].asDict() == {"text": "hello", "_text": 1, "ids": got[0].ids, "decoded": "hello"}
    assert pieces.encode(rows.limit(0), model).collect() == []


def test_texts_without_spaces(model):
    """A megabyte of Han and other text in words of many hundred characters, in seconds."""
    rng = random.Random(2)
    han = [chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000)]
    common = [p for p, t in zip(model.pieces, model.types) if t == 1 and any(ord(c) > 0x3000 for c in p)]
    texts = ["".join(rng.choices(han + common * 2, k=rng.randint(400, 1200))) for _ in range(420)]
    texts += ["ひらがなカタカナ漢字テスト" * 50, "สวัสดีชาวโลก" * 60, "abc漢字def" * 80, "https://example.org/" + "x1y2" * 20]
    encoder = pieces.Encoder(model)
    start = time.process_time()
    got = encoder.solve(["▁" + t for t in texts])
    spent = time.process_time() - start
    size = sum(len(t.encode()) for t in texts)
    assert size > 950_000 and spent / size * 1e9 < 2000
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library.encode(t) for t in texts]
