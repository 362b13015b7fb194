"""Quality rules: counts of symbols, repeats and words, and divergence from language references.

A language reference is what all documents that declare a language hold together: shares of
character classes, and shares of the words that make up ``COMMON`` of its words or more. A
document is compared with the reference of its own language, or with the nearest one if it
declares no language, by Jensen-Shannon divergence in bits; one whose language is too rare for
a reference is left to the other rules. Short texts diverge by chance: the comparison starts at ``MIN_WORDS`` words, and the bound widens for the number of
bins that so few words cannot fill.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.substrings import WordCodes

COMMON = 0.002  # share of a language's words that makes a word common
MIN_REFERENCE = 2_000  # words that a language needs for a reference
MIN_WORDS = 50
CHAR_BOUND = 0.06
WORD_BOUND = 0.09
CHAR_NOISE = 2.0  # added to the bounds, divided by the number of words
WORD_NOISE = 0.12  # the same for each bin

CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "other", "wide")
_SYMBOLS = b"#*$%&|<>"


def _class_table():
    import numpy as np

    table = np.full(256, 7, np.uint8)  # 1 to 8 as in CLASSES; 0 for continuation bytes
    for byte in range(128):
        c = chr(byte)
        kind = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if byte in b" \t\n\v\f\r" else 0
        kind = kind or (5 if byte in _SYMBOLS else 6 if 32 < byte < 127 else 7)
        table[byte] = kind
    table[0x80:0xC0] = 0
    table[0xC0:] = 8
    return table


def _folded(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(".,;:!?\"'()[]").lower()


def _count_classes(text: bytes, table):
    import numpy as np

    counts = np.zeros(9, np.int64)
    for i in range(0, len(text), 1 << 22):
        counts += np.bincount(table[np.frombuffer(text[i : i + (1 << 22)], np.uint8)], minlength=9)
    return counts[1:]


def _word_shares(batches, share: float):
    """Per block of documents: words at or above ``share`` of a language's words, and totals."""
    import numpy as np
    import pyarrow as pa

    table = _class_table()
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}
    held = 0

    def emit():
        rows = []
        for lang, counted in words.items():
            total = sum(counted.values())
            rows.append((lang, None, total, classes[lang].tolist()))
            folded: Counter = Counter()
            for word, n in counted.items():
                folded[_folded(word)] += n
            rows += [(lang, word, n, None) for word, n in folded.items() if n >= share * total and word]
        words.clear()
        classes.clear()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "word", "n", "classes"])

    for batch in batches:
        for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            found = text.split()
            words.setdefault(lang, Counter()).update(found)
            classes[lang] = classes.get(lang, 0) + _count_classes(text, table)
            held += len(found)
            if held >= 3_000_000:
                yield emit()
                held = 0
    if words:
        yield emit()


def _exact_shares(batches, candidates: dict[str, list[str]]):
    import pyarrow as pa

    wanted = {lang: frozenset(words) for lang, words in candidates.items()}
    total: dict[str, Counter] = {}

    class Folds(dict):
        def __missing__(self, word):
            if len(self) > 400_000:
                self.clear()
            out = self[word] = _folded(word)
            return out

    folds = Folds()
    for batch in batches:
        for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if lang in wanted:
                counted = total.setdefault(lang, Counter())
                own = wanted[lang]
                for word, n in Counter(text.split()).items():
                    if (word := folds[word]) in own:
                        counted[word] += n
    rows = [(lang, word, n) for lang, counted in total.items() for word, n in counted.items()]
    columns = list(zip(*rows)) or [[]] * 3
    kinds = (pa.string(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "word", "n"])


def references(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, tuple[dict[str, float], list[float]]]:
    """Language to (shares of its common words, shares of character classes), from all rows.

    A word with a share of COMMON in the whole has at least half its occurrences in blocks
    where its share is COMMON / 2 or more. So the words that such blocks report, at least
    COMMON / 2 of the whole, hold all common ones and are 2 / COMMON a language at most; these
    few are then counted exactly. What reaches the driver is bounded by that for each language.
    """
    rows = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("binary").alias("text")
    ).where("text IS NOT NULL AND lang <> ''")
    blocks = rows.mapInArrow(lambda b: _word_shares(b, COMMON / 2), "lang string, word string, n long, classes array<long>")
    slot = lambda i: F.sum(F.get("classes", F.lit(i))).alias(f"c{i}")
    summed = blocks.groupBy("lang", "word").agg(F.sum("n").alias("n"), *(slot(i) for i in range(len(CLASSES))))
    summed = summed.persist()
    totals = summed.where("word IS NULL").where(F.col("n") >= MIN_REFERENCE)
    known = {r["lang"]: (r["n"], [r[f"c{i}"] for i in range(len(CLASSES))]) for r in totals.collect()}
    bound = totals.select("lang", F.col("n").alias("total"))
    held = summed.where("word IS NOT NULL").join(bound, "lang").where(F.col("n") >= COMMON / 2 * F.col("total"))
    candidates: dict[str, list[str]] = {}
    for r in held.select("lang", "word").collect():
        candidates.setdefault(r["lang"], []).append(r["word"])
    summed.unpersist()
    exact = rows.mapInArrow(lambda b: _exact_shares(b, candidates), "lang string, word string, n long")
    counts = {(r["lang"], r["word"]): r["n"] for r in exact.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for lang, (total, classes) in sorted(known.items()):
        shares = {w: counts[lang, w] / total for w in sorted(candidates.get(lang, [])) if counts[lang, w] >= COMMON * total}
        size = sum(classes) or 1
        out[lang] = (shares, [c / size for c in classes])
    return out


def divergence(p, q) -> float:
    """Jensen-Shannon divergence of two histograms that sum to one, in bits."""
    import numpy as np

    p, q = np.asarray(p, float), np.asarray(q, float)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(parts.sum() / 2)


def repeated_words(words: list[bytes], codes: WordCodes, window: int = 5) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    x = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    at = order[np.r_[False, same] | np.r_[same, False]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "char_divergence double, word_divergence double, kept boolean"
)


def _measure(batches, refs):
    import numpy as np
    import pyarrow as pa

    table = _class_table()
    codes = WordCodes()
    known = {
        lang: ({w: i for i, w in enumerate(shares)}, np.array([*shares.values(), 1 - sum(shares.values())]), np.array(classes))
        for lang, (shares, classes) in refs.items()
    }

    class Bins(dict):
        def __init__(self, index):
            super().__init__()
            self.index = index

        def __missing__(self, word):
            if len(self) > 400_000:
                self.clear()
            out = self[word] = self.index.get(_folded(word), len(self.index))
            return out

    bins = {lang: Bins(index) for lang, (index, _, _) in known.items()}

    def diverges(lang, words, classes):
        index, shares, expected = known[lang]
        counted = np.bincount(np.fromiter(map(bins[lang].__getitem__, words), np.int64, len(words)), minlength=len(shares))
        return divergence(classes / classes.sum(), expected), divergence(counted / len(words), shares), len(shares)

    def row(lang, text):
        text = text or b""
        words = text.split()
        classes = _count_classes(text, table)
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
        repeats = repeated_words(words, codes)
        n = len(words)
        failed = n < 10 or 100 * repeats > 20 * n
        chars = by_words = None
        kept = not failed
        own = [lang] if lang in known else [] if lang else list(known)
        if n >= MIN_WORDS and own:
            chars, by_words, size = min((diverges(x, words, classes) for x in own), key=lambda d: d[0] + d[1])
            kept = kept and chars <= CHAR_BOUND + CHAR_NOISE / n and by_words <= WORD_BOUND + WORD_NOISE * size / n
        return n, int(classes.sum() - classes[3]), int(classes[4]), dup, repeats, failed, chars, by_words, kept

    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
    for batch in batches:
        names = batch.schema.names
        langs, texts = (batch.column(names.index(n)).to_pylist() for n in ("_lang", "_text"))
        columns = zip(*(row(lang, text) for lang, text in zip(langs, texts))) if batch.num_rows else [[]] * 9
        rest = [n for n in names if n != "_lang"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(names.index(n)) for n in rest), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            [*rest, *(c.split()[0] for c in _COLUMNS.split(", "))],
        )


def measure(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all by default) and the rules' counts, divergences and verdict.

    Null and empty texts have no words and fail. Without a declared language the
    nearest reference counts; where the declared one has no reference, without any reference, or
    below MIN_WORDS words, the divergences are null and do not speak against a document. Each of several equal rows is judged alike.
    Input columns with the names of results are replaced.
    """
    refs = references(documents, lang_col, text_col)
    results = [c.split()[0] for c in _COLUMNS.split(", ")]
    picked = [c for c in (documents.columns if columns is None else columns) if c not in results]
    alias = {name: f"_c{i}" for i, name in enumerate(picked)}
    rows = documents.select(
        *(F.col(f"`{n}`").alias(a) for n, a in alias.items() if n != text_col),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"),
        F.col(text_col).cast("binary").alias("_text"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_lang")
    done = rows.mapInArrow(lambda b: _measure(b, refs), f"{kinds}, {_COLUMNS}")
    return done.select(
        *(F.decode("_text", "UTF-8").alias(n) if n == text_col else F.col(a).alias(n) for n, a in alias.items()), *results
    )
