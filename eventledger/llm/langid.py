"""Languages of web pages by Bayesian fusion of evidence.

For each page four things speak: the likelihood of its main text under a model of byte
trigrams per language, the language that its markup declares, the suffix of its address and
its host. How far a declaration can be trusted, and what languages a suffix and a host use,
are sums of the texts' posteriors, grouped in Spark. Priors are smoothed down a hierarchy:
a host's towards its suffix, a suffix's towards all pages. A page's own text is taken out of
its host's and suffix's sums, so that it does not speak twice.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import long_id, text_tag, written
from eventledger.llm.pages import host_of, main_text

BUCKETS = 1 << 14
FIT_ROWS = 20_000  # documents of known language that the text model is fitted on, at most
FULL_GRAMS = 60.0  # trigrams from which on a longer text adds nothing
TEXT_SHARE = 0.95  # of the text's evidence is trusted, the rest is even
HOST_WEIGHT = 5.0  # pages that a suffix's prior counts for in a host's
SUFFIX_WEIGHT = 20.0  # pages that the overall prior counts for in a suffix's
TOLD_WEIGHT = 2.0  # pages that an even spread counts for in what a declaration means

_DECLARED = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.I | re.S)


def _grams(text: str) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text, case folded and with single spaces."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _count_grams(batches):
    import pyarrow as pa

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            grams = _grams(text)
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += np.bincount(grams, minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"]
        )


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS):
    """(languages, log shares of trigrams by language) from documents that name a language.

    Of more than ``rows`` such documents those with the smallest hashes of their ids are used.
    """
    known = documents.where(f"`{lang_col}` IS NOT NULL AND `{text_col}` IS NOT NULL AND `{id_col}` IS NOT NULL")
    chosen = known.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = known.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(
        F.lower(F.trim(F.col(lang_col).cast("string"))).alias("lang"), F.col(text_col).alias("text")
    )
    counts = texts.mapInArrow(_count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most languages times buckets
    langs = sorted({r["lang"] for r in found})
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in found:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _evidence(batches, langs: list[str], model: np.ndarray):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, tag, url, page in zip(*(batch.column(i).to_pylist() for i in range(4))):
            host = host_of(url)
            suffix = host.rpartition(".")[2] if not host[-1:].isdigit() else ""
            told = _DECLARED.search(page or "")
            grams = _grams(main_text(page)) if page else np.zeros(0, np.int64)
            fit = np.zeros(len(langs))
            for lo in range(0, len(grams), 1 << 18):
                fit += model[:, grams[lo : lo + (1 << 18)]].sum(axis=1)
            fit *= min(1.0, FULL_GRAMS / max(1, len(grams)))
            text = np.exp(fit - fit.max()) if len(langs) else fit
            text = TEXT_SHARE * text / max(text.sum(), 1e-300) + (1 - TEXT_SHARE) / max(1, len(langs))
            rows.append((key, tag, host, suffix, told[1].lower() if told else "", len(grams), text.tolist()))
        columns = zip(*rows) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["_key", "_tag", "host", "suffix", "told", "n_grams", "text"]
        )


def _sums(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*(F.sum(F.get("text", F.lit(i))) for i in range(size))).alias(f"{key}_sums"))


def identify(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, lang, confidence, text_lang, told, host) of every row; ``model`` comes from ``fit``.

    A page without text is judged by its address and declaration alone, one without any of
    them gets the most frequent language. Null html is an empty page, a null url the
    nameless host. Ties go to the language first by name. A null id stays null. Repeated rows
    count as pages of their own. Without languages in the model, lang is null.
    """
    langs, table = model
    size = len(langs)
    raw = pages.select(
        long_id(id_col).alias("_key"), text_tag(html_col).alias("_tag"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")
    )
    kinds = "_key long, _tag int, host string, suffix string, told string, n_grams long, text array<double>"
    rows = written(raw.mapInArrow(lambda b: _evidence(b, langs, table), kinds), "langid")
    if not size:
        none = F.lit(None).cast("string")
        return rows.select(_known(id_col), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "told", "host")
    every = rows.agg(*(F.sum(F.get("text", F.lit(i))) for i in range(size))).first()
    overall = np.array([(x or 0.0) + 1.0 for x in every])
    overall /= overall.sum()
    # Text evidence by language and declaration: the chance of a declaration in a language.
    said = _sums(rows, "told", size)
    joined = rows.join(_sums(rows, "suffix", size), "suffix").join(_sums(rows, "host", size), "host").join(said, "told")

    def at(name: str, i: int) -> Column:
        return F.get(name, F.lit(i))

    def others(name: str) -> Column:
        """Pages beside this one that the sums are made of."""
        return sum((at(name, i) for i in range(1, size)), at(name, 0)) - 1.0

    def prior(i: int) -> Column:
        own = at("text", i)
        by_suffix = (at("suffix_sums", i) - own + SUFFIX_WEIGHT * float(overall[i])) / (others("suffix_sums") + SUFFIX_WEIGHT)
        return (at("host_sums", i) - own + HOST_WEIGHT * by_suffix) / (others("host_sums") + HOST_WEIGHT)

    def declared(i: int) -> Column:
        share = (at("told_sums", i) - at("text", i) + TOLD_WEIGHT * float(overall[i])) / (others("told_sums") + TOLD_WEIGHT)
        return F.when(F.col("told") == "", 1.0).otherwise(share / float(overall[i]))

    weights = F.array(*(at("text", i) * F.greatest(prior(i), F.lit(1e-9)) * F.greatest(declared(i), F.lit(1e-9)) for i in range(size)))
    names = F.array(*(F.lit(x) for x in langs))
    judged = joined.select("_key", "host", "told", "n_grams", "text", weights.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    best = lambda name: F.element_at(names, F.array_position(name, F.array_max(name)).cast("int"))
    return judged.select(
        _known(id_col),
        best("w").alias("lang"),
        (F.array_max("w") / total).alias("confidence"),
        F.when(F.col("n_grams") > 0, best("text")).alias("text_lang"),
        "told",
        "host",
    )


def _known(id_col: str) -> Column:
    return F.nullif("_key", F.lit((1 << 63) - 1)).alias(id_col)
