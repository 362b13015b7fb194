"""A quality classifier by co-training of two views of a document.

One view is what the text holds: shares of characters, of repeats and of hashed words. The
other is what is known beside it: language, source, size and layout. Each view has a
logistic classifier. Labelled documents teach both at first; then, round by round, each view
labels the documents without a label of which it is sure, and these teach the other view.

Features are written once. All fitting is distributed: a Newton step needs the sums of
x x' and of x times the error over all rows, which partitions add up before Spark sums them.
A fifth of the labelled documents is held out; on it each view's scores are calibrated, and
the calibrated views combine to one probability.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import long_id, text_tag, written
from eventledger.llm.rules import _class_table, _count_classes
from eventledger.llm.simhash import known_id
from eventledger.llm.substrings import WordCodes

HASHED = 48  # bins of words
SOURCES, LANGS = 32, 8  # bins of sources and of languages
TEXT = 8 + 6 + HASHED + 1
META = SOURCES + LANGS + 5 + 1
ROUNDS = 2
STEPS = 4  # Newton steps in each round
SURE = 0.95  # probability from which on a view labels for the other
PSEUDO = 0.3  # weight of such a label
RIDGE = 0.02
BINS = 20  # of scores, in calibration
HELD_OUT = 5  # one labelled document of so many is held out


def _features(batches):
    """(key, tag, lang, source, text) to both views in one vector of 32-bit floats."""
    import pyarrow as pa
    import xxhash

    table = _class_table()
    codes = WordCodes()

    def bin_of(name: str | None, n: int) -> int:
        return xxhash.xxh64_intdigest(name or "") % n

    for batch in batches:
        vectors = []
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            text = text or b""
            words = text.split()
            n = max(1, len(words))
            classes = _count_classes(text, table)
            size = max(1, int(classes.sum()))
            x = np.zeros(TEXT + META, np.float32)
            x[:8] = classes / size * 4
            found = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
            distinct, times = np.unique(found, return_counts=True)
            x[8] = len(distinct) / n
            x[9] = times.max(initial=0) / n
            x[10] = np.mean(found[1:] == found[:-1]) if len(found) > 1 else 0.0
            lines = text.split(b"\n")
            x[11] = 1 - len(set(lines)) / len(lines)
            x[12] = (size - classes[3]) / n / 10
            x[13] = 1.0 if len(words) < 20 else 0.0
            x[14 : 14 + HASHED] = np.sqrt(np.bincount((found % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / n)
            x[14 + HASHED] = 1.0
            m = x[TEXT:]
            m[bin_of(source, SOURCES)] = 1.0
            m[SOURCES + bin_of(lang, LANGS)] = 1.0
            m[SOURCES + LANGS :] = (
                math.log1p(size) / 10, min(1.0, size / 1000), math.log1p(len(lines)) / 5,
                math.log1p(size / len(lines)) / 10, float(source is None), 1.0,
            )
            vectors.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["_key", "_tag", "x"])


def features(documents: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = documents.select(
        long_id(id_col).alias("_key"), text_tag(text_col).alias("_tag"), F.col(lang_col).cast("string").alias("_lang"),
        F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("binary").alias("_text"),
    )
    return rows.mapInArrow(_features, "_key long, _tag int, x binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, TEXT + META).astype(np.float64)


def _scores(x: np.ndarray, views) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :TEXT] @ views[0], x[:, TEXT:] @ views[1]


def _chance(score):
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _sums(batches, views, teachers):
    """Newton sums of both views over a partition: (slot, value)."""
    import pyarrow as pa

    sizes = (TEXT, META)
    total = [np.zeros((d, d + 1)) for d in sizes]
    for batch in batches:
        x = _matrix(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)  # -1 without a label
        now = _scores(x, views)
        told = [_chance(s) for s in _scores(x, teachers)] if teachers else None
        for v, part in enumerate((x[:, :TEXT], x[:, TEXT:])):
            y, weight = label.copy(), (label >= 0).astype(float)
            if told is not None:
                other = told[1 - v]
                lent = (label < 0) & ((other >= SURE) | (other <= 1 - SURE))
                y[lent], weight[lent] = other[lent] >= 0.5, PSEUDO
            use = weight > 0
            rows, p = part[use], _chance(now[v][use])
            total[v][:, :-1] += (rows * (weight[use] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ rows
            total[v][:, -1] += rows.T @ (weight[use] * (y[use] - p))
    flat = np.concatenate([t.ravel() for t in total])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["slot", "value"])


def fit(rows: DataFrame, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views from ``rows(x, label)``; label -1 means none."""
    views = (np.zeros(TEXT), np.zeros(META))
    teachers = None
    for _ in range(rounds + 1):
        for _ in range(steps):
            now, lent = views, teachers
            sums = rows.select("x", "label").mapInArrow(lambda b: _sums(b, now, lent), "slot int, value double")  # noqa: B023
            found = sums.groupBy("slot").agg(F.sum("value").alias("value")).collect()  # as many as weights, squared
            flat = np.zeros(TEXT * (TEXT + 1) + META * (META + 1))
            for r in found:
                flat[r["slot"]] = r["value"]
            new, at = [], 0
            for weights in views:
                d = len(weights)
                part = flat[at : at + d * (d + 1)].reshape(d, d + 1)
                at += d * (d + 1)
                move = np.linalg.solve(part[:, :-1] + RIDGE * np.eye(d), part[:, -1] - RIDGE * weights)
                new.append(weights + move * min(1.0, 5.0 / max(1e-12, np.abs(move).max())))
            views = (new[0], new[1])
        teachers = views
    return views


def _binned(batches, views):
    import pyarrow as pa

    for batch in batches:
        x = _matrix(batch.column(0))
        for v, score in enumerate(_scores(x, views)):
            bins = np.minimum((_chance(score) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), v, np.int32)), pa.array(bins), batch.column(1)], ["view", "bin", "label"]
            )


def _isotonic(good: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Rising chances by bin, by pooling neighbours that fall; two rows' worth of the prior in each."""
    blocks: list[list[float]] = []
    for g, k in zip(good + 2 * prior, n + 2.0):
        blocks.append([g, k, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            g2, k2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + k2, blocks[-1][2] + c2]
    return np.concatenate([np.full(c, g / k) for g, k, c in blocks])


def calibrate(held: DataFrame, views) -> tuple[np.ndarray, float]:
    """(log odds by view and bin, prior log odds) from held-out ``rows(x, label)``."""
    counts = held.select("x", "label").mapInArrow(lambda b: _binned(b, views), "view int, bin int, label int")
    found = counts.groupBy("view", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    good, n = np.zeros((2, BINS)), np.zeros((2, BINS))
    for r in found:
        good[r["view"], r["bin"]], n[r["view"], r["bin"]] = r["good"], r["n"]
    prior = (good[0].sum() + 1) / (n[0].sum() + 2)
    chances = np.array([_isotonic(good[v], n[v], prior) for v in (0, 1)])
    return np.log(chances / (1 - chances)), math.log(prior / (1 - prior))


def _judge(batches, views, odds, prior):
    import pyarrow as pa

    for batch in batches:
        x = _matrix(batch.column(2))
        single = [odds[v][np.minimum((_chance(s) * BINS).astype(int), BINS - 1)] for v, s in enumerate(_scores(x, views))]
        columns = [*map(_chance, single), _chance(single[0] + single[1] - prior)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *map(pa.array, columns)], ["_key", "_tag", "p_text", "p_meta", "p_good"]
        )


def classify(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    label_col: str = "quality",
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, p_text, p_meta, p_good, kept) of every document.

    p_text and p_meta are the calibrated views, p_good their combination, kept whether it is
    at least one half. ``labels`` holds 0 or 1 by id; null ids and labels are left out, of
    contrary labels of an id the lower counts. Null and empty texts have features like any
    other. A null id stays null and takes no label; repeated rows get the same chances.
    Without labels of both kinds every document gets the share of good labels, or one half.
    """
    told = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_key")).agg(F.min(label_col).cast("int").alias("label"))
    )
    rows = written(features(documents, id_col, text_col, lang_col, source_col), "cotraining")
    marked = rows.join(told, "_key", "left").select("_key", F.coalesce("label", F.lit(-1)).alias("label"), "x")
    apart = (F.col("label") >= 0) & (F.pmod(F.xxhash64("_key"), F.lit(HELD_OUT)) == 0)
    marked = written(marked.select("*", apart.alias("apart")), "cotraining")
    kinds = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    good, bad = kinds.get(1, 0), kinds.get(0, 0)
    if not good or not bad:
        share = F.lit(good / (good + bad) if good + bad else 0.5)
        return rows.select(known_id("_key").alias(id_col), *(share.alias(n) for n in ("p_text", "p_meta", "p_good")), (share >= 0.5).alias("kept"))
    views = fit(marked.where("NOT apart"), rounds)
    odds, prior = calibrate(marked.where("apart"), views)
    judged = rows.mapInArrow(lambda b: _judge(b, views, odds, prior), "_key long, _tag int, p_text double, p_meta double, p_good double")
    return judged.select(known_id("_key").alias(id_col), "p_text", "p_meta", "p_good", (F.col("p_good") >= 0.5).alias("kept"))
