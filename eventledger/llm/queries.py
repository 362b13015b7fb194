"""One query per operator over its whole table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.llm import (
    cotraining,
    langid,
    licenses,
    manifest,
    mixing,
    pages,
    pieces,
    rules,
    runs,
    simhash,
    substrings,
    tokenfiles,
    topk,
)
from eventledger.llm.common import SPACE, read_table
from eventledger.session import prepare, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


#: Shares of all tokens that a training mixture shall have.
SHARES = {"good": 0.94, "low": 0.04, "toxic": 0.02}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(read_table(prepare(spark), sf_dir, "labels"))
    rows, domains = mixing.mix(read_table(spark, sf_dir, "documents"), labels, shares=SHARES)
    return rows.select(
        simhash.known_id("_key").alias("doc_id"),
        "n_tokens",
        *(F.col(f"p_{d}").alias(f"p_{name}") for d, name in enumerate(domains)),
        "rate",
    )


#: Vocabulary file of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str, path: str = PIECES) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    model = pieces.Model.load(path)
    rows = read_table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(rows, model, check_col="round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(prepare(spark), sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(read_table(prepare(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(read_table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), starts AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS passage
    FROM d, unnest(range(1, len(w) - 18)) AS r(i)
), later AS (
    SELECT doc_id, i FROM starts
    QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS spots
    FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN spots IS NULL THEN w ELSE
           list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(spots, x[2])), lambda x: x[1])
       END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(prepare(spark), sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.measure(read_table(prepare(spark), sf_dir, "documents"), columns=["doc_id"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model learns from documents that name a language."""
    model = langid.fit(read_table(prepare(spark), sf_dir, "documents"))
    return langid.identify(read_table(spark, sf_dir, "pages"), model)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(prepare(spark), sf_dir, "documents"))
    return found.select(
        simhash.known_id("_key").alias("doc_id"),
        simhash.hex_digits("fp").alias("fingerprint"),
        simhash.known_id("component").alias("component_id"),
    )


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(prepare(spark), sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), topk.whole_numbers(F.col("embedding")).alias("v")
    )
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank,
       c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""


#: Id that ends each document in token files.
END_ID = 1


def op11_token_files(spark: SparkSession, sf_dir: str, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Token files of all documents, written under ``path`` (a new shared folder), read back."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = path or shared_dir(spark, "token-files")
    tokenfiles.write(read_table(prepare(spark), sf_dir, "documents"), path, tokenfiles.Encoder.load(vocabulary, END_ID))
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text), where every tenth document, by its id's CRC, ends periodically."""
    rows = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACE), lambda x: x != "")))
    places = words.withColumn("n", F.size("w")).selectExpr("*", "IF(n > 0, h DIV 10 % n, NULL) AS a")
    periods = places.selectExpr("*", "1 + (n - a) DIV (3 + h DIV 10 % 8) AS p")
    base = "slice(w, CAST(a + 1 AS INT), CAST(p AS INT))"
    whole = f"concat(slice(w, 1, CAST(a AS INT)), flatten(array_repeat({base}, CAST(1 + (n - a) DIV p AS INT))))"
    return periods.selectExpr("doc_id", f"IF(n > 0, array_join(slice({whole}, 1, n), ' '), text) AS text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted(read_table(prepare(spark), sf_dir, "documents")))
    better = "r.length * best.period > best.length * r.period"
    best = f"aggregate(runs, runs[0], (best, r) -> IF({better}, r, best))"
    listed = r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')"
    return found.withColumn("best", F.expr(f"IF(size(runs) > 0, {best}, NULL)")).selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "best.start AS start",
        "best.length AS length",
        "best.period AS period",
        "1000 * best.length DIV best.period AS exponent_milli",
        f"sha2({listed}, 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and the root of all documents, and which rows a changed ``n_chars`` gives away."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.build(
        read_table(prepare(spark), sf_dir, "documents"), fields, keep={"claim": F.when(hit, manifest.leaf(*changed))}
    )
    checked = manifest.fold(made.withColumn("claim", F.coalesce("claim", "leaf")), "claim")
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_field(name: str) -> str:
    return f"coalesce(strlen(({name})::VARCHAR) || ':' || ({name})::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_sql_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: Trees are named by their language, '=' before it, the tree of subroots '#'.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf('n_chars')} AS leaf,
           CASE WHEN {_SQL_CRC32} % 7 = 0 THEN {_sql_leaf('n_chars + 1')} ELSE {_sql_leaf('n_chars')} END AS claim
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM leaves
), lower(tree, lvl, pos, m, h) AS (
    SELECT tree, 0, pos, m, leaf FROM placed
    UNION ALL
    SELECT tree, lvl + 1, pos // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM lower WHERE m > 1 GROUP BY tree, lvl, pos // 2
), subroots AS (
    SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS m FROM lower WHERE m = 1
), upper_(tree, lvl, pos, m, h) AS (
    SELECT '#', 0, pos, m, subroot FROM subroots
    UNION ALL
    SELECT tree, lvl + 1, pos // 2, (any_value(m) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM upper_ WHERE m > 1 GROUP BY tree, lvl, pos // 2
), nodes AS (
    SELECT * FROM lower UNION ALL SELECT * FROM upper_
), walk(doc_id, leaf, home, tree, lvl, pos, m, proof, h) AS (
    SELECT doc_id, leaf, tree, tree, 0, pos, m, '', claim FROM placed
    UNION ALL
    SELECT w.doc_id, w.leaf, w.home,
           CASE WHEN w.m = 1 THEN '#' ELSE w.tree END,
           CASE WHEN w.m = 1 THEN 0 ELSE w.lvl + 1 END,
           CASE WHEN w.m = 1 THEN s.pos ELSE w.pos // 2 END,
           CASE WHEN w.m = 1 THEN s.m ELSE (w.m + 1) // 2 END,
           CASE WHEN w.m = 1 THEN w.proof ELSE w.proof || coalesce(o.h, '') END,
           CASE WHEN w.m = 1 THEN w.h WHEN w.pos % 2 = 1 THEN sha256(o.h || w.h) ELSE sha256(w.h || coalesce(o.h, '')) END
    FROM walk w JOIN subroots s ON s.tree = w.home
    LEFT JOIN nodes o ON o.tree = w.tree AND o.lvl = w.lvl AND o.pos = xor(w.pos, 1)
    WHERE w.m > 1 OR w.tree <> '#'
)
SELECT w.doc_id, w.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM walk w JOIN subroots s ON s.tree = w.home JOIN upper_ r ON r.m = 1
WHERE w.tree = '#' AND w.m = 1
"""


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_html_extraction": op3_html_extraction,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_language_id": op8_language_id,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_exact_top_k": op10_exact_top_k,
        "op11_token_files": op11_token_files,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op10_exact_top_k": OP10_SQL, "op13_merkle_manifest": OP13_SQL}
