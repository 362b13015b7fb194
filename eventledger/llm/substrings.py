"""Removal of passages that repeat anywhere in a corpus, by prefix-partitioned suffix trees.

A suffix is what a document holds from one word on, cut after ``WINDOW`` words: nothing
deeper is asked of the tree. Suffixes meet by a prefix of varying length:

* Each suffix belongs to the phrase of ``PHRASE`` words that has the smallest hash among
  the phrases within its window. Equal windows choose equal phrases, and neighbouring
  suffixes mostly share one, so that a run of them travels as one record. The phrase, its
  offset in the window and a hash of all the window's words are the labels on the path
  from the root to depth ``WINDOW``.
* A phrase's records go to one of many groups. Suffixes of a phrase that would overfill a
  group meet by the longer prefix instead, all of the window. Such phrases show in a fixed
  share of the documents; the choice changes where suffixes meet, never what is found.
* Sorting a group's suffixes lays the leaves of its subtree side by side. An internal node
  of depth ``WINDOW`` or more is a run of equal paths; every leaf below it but the first in
  (id, start) order is a repeat. Overlapping repeats merge into maximal spans. A task reads
  its group in pieces of ``GROUP_WINDOWS`` suffixes and keeps the first leaf of each node.

Before anything is shuffled each buffer of documents is treated the same way by itself:
a passage that a third of all documents share leaves a buffer once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import NO_ID, WORD_BYTES, long_id, mix, partitions_for, text_tag

WINDOW = 20
PHRASE = 8
BUFFER_WORDS = 1_500_000
GROUP_WINDOWS = 4_000_000
SAMPLE = 0.001  # share of the documents in which phrases are counted
HEAVY = 400  # suffixes there from which a phrase is taken apart: a tenth of GROUP_WINDOWS in all

_RECORD = "kind int, grp int, payload binary"
_SPAN = "_key long, _tag int, first int, last int"


class WordCodes(dict):
    """64-bit codes of words; forgets them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def _window_hashes(codes, phrase: int, window: int):
    """Hashes of the phrase and of the window that start at each word."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    powers = {1: codes}

    def upto(length: int):
        if length not in powers:
            half = 1 << (length.bit_length() - 1)
            half = half // 2 if half == length else half
            left, right = upto(half), upto(length - half)
            n = max(0, len(codes) - length + 1)
            step = np.uint64(pow(base, length - half, 1 << 64))
            powers[length] = left[:n] * step + right[half : half + n]
        return powers[length]

    return mix(upto(phrase)), mix(upto(window) + np.uint64(window))


def _repeats(keys, doc, start):
    """Marks windows whose keys also occur at a smaller (doc, start)."""
    import numpy as np

    out = np.zeros(len(doc), bool)
    code = keys[0].copy()
    for key in keys[1:]:
        code = mix(code) ^ key.astype(np.uint64)
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return out
    several = order[np.r_[False, same] | np.r_[same, False]]
    several = several[np.lexsort((start[several], doc[several], *(k[several] for k in keys)))]
    new = np.ones(len(several), bool)
    new[1:] = np.any([k[several][1:] != k[several][:-1] for k in keys], axis=0)
    first = several[np.maximum.accumulate(np.where(new, np.arange(len(several)), 0))]
    later = (doc[several] != doc[first]) | (start[several] != start[first])
    out[several[later]] = True
    return out


def _first_leaves(columns, gone):
    """What is left of the columns; equal rows of one place stay once for each text."""
    import numpy as np

    left = [c[~gone] for c in columns]
    whole, _, _, doc, tag, start = left
    order = np.lexsort((start, tag, doc, whole))
    same = np.ones(len(order), bool)
    for c in left:
        same[1:] &= c[order][1:] == c[order][:-1]
    same[:1] = False
    return [c[order[~same]] for c in left]


def _spans(doc, tag, start, window: int):
    """Merges windows into maximal spans: arrays (doc, tag, first, last)."""
    import numpy as np

    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order].astype(np.int64)
    if not len(doc):
        return doc, tag, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(new)
    ends = np.r_[at[1:] - 1, len(doc) - 1]
    return doc[at], tag[at], start[at], start[ends] + window


def _pack_spans(spans) -> bytes:
    doc, tag, first, last = spans
    return b"".join(
        (doc.astype("<i8").tobytes(), tag.astype("<i4").tobytes(), first.astype("<i4").tobytes(), last.astype("<i4").tobytes())
    )


def _least_phrases(phrases, at, span: int):
    """The smallest hash among the ``span`` phrases from each place on."""
    import numpy as np

    least = phrases
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    return least[at]


def _phrase_counts(batches, window: int, phrase: int):
    """Documents to (phrase, number of suffixes that belong to it)."""
    import numpy as np
    import pyarrow as pa

    codes = WordCodes()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = text.split()
            n = len(words) - window + 1
            if n < 1:
                continue
            phrases, _ = _window_hashes(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), phrase, window)
            least, counts = np.unique(_least_phrases(phrases, np.arange(n), window - phrase + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(counts)], ["phrase", "n"])


def _heavy_phrases(texts: DataFrame, window: int, phrase: int) -> list[int]:
    """Phrases with ``HEAVY`` suffixes or more in the sample: at most one for so many suffixes."""
    counted = texts.select("_text").sample(SAMPLE, seed=11).mapInArrow(
        lambda batches: _phrase_counts(batches, window, phrase), "phrase long, n long"
    )
    return [r["phrase"] for r in counted.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY).select("phrase").collect()]


def _suffix_records(batches, groups: int, window: int, phrase: int, heavy: list[int], buffer: int):
    """Documents to records of suffix runs (kind 0) and spans found within a buffer (kind 1)."""
    import numpy as np
    import pyarrow as pa

    codes = WordCodes()
    apart = np.sort(np.array(heavy, np.int64).view(np.uint64))
    docs: list = []
    held = 0

    def flush():
        docs.sort(key=lambda d: d[0])
        ids = np.array([d[0] for d in docs], np.int64)
        tags = np.array([d[1] for d in docs], np.int32)
        sizes = np.array([len(d[2]) for d in docs], np.int64)
        words = np.concatenate([d[2] for d in docs])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        of_word = np.repeat(np.arange(len(docs)), sizes)
        at = np.flatnonzero(ends[of_word] - np.arange(len(words)) >= window)
        phrases, windows = _window_hashes(words, phrase, window)
        span = window - phrase + 1
        least = _least_phrases(phrases, at, span)
        offset = np.zeros(len(at), np.int64)
        for step in range(span - 1, -1, -1):
            offset[phrases[at + step] == least] = step
        whole = windows[at]
        of = of_word[at]
        start = at - begins[of]
        doc, tag = ids[of], tags[of]
        gone = _repeats((whole, least), doc, start)
        if gone.any():
            yield 1, int(ids[0] % groups), _pack_spans(_spans(doc[gone], tag[gone], start[gone], window))
        keep = ~gone
        at, of, start, least, offset, whole = (x[keep] for x in (at, of, start, least, offset, whole))
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | (at[1:] + offset[1:] != at[:-1] + offset[:-1])
        meet = least
        if len(apart):
            alone = apart[np.minimum(np.searchsorted(apart, least), len(apart) - 1)] == least
            new |= alone
            new[1:] |= alone[:-1]
            meet = np.where(alone, whole, least)
        run = np.flatnonzero(new)
        count = np.diff(np.r_[run, len(at)])
        group = (meet[run] % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.unique(group))
        whole_bytes = whole.view(np.uint8).reshape(-1, 8)[:, :6]
        for runs in np.split(order, cuts[1:]):
            heads, n = run[runs], count[runs]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            payload = b"".join(
                (
                    np.int64(len(runs)).tobytes(),
                    least[heads].tobytes(),
                    ids[of[heads]].tobytes(),
                    tags[of[heads]].tobytes(),
                    start[heads].astype("<i4").tobytes(),
                    offset[heads].astype(np.uint8).tobytes(),
                    n.astype(np.uint8).tobytes(),
                    whole_bytes[np.repeat(heads, n) + inner].tobytes(),
                )
            )
            yield 0, int(group[runs[0]]), payload

    def emit():
        rows = list(flush())
        docs.clear()
        for i in range(0, len(rows), 64):
            kind, grp, payload = zip(*rows[i : i + 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(grp, pa.int32()), pa.array(payload, pa.binary())],
                ["kind", "grp", "payload"],
            )

    for batch in batches:
        for key, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = text.split()
            if len(words) < window:
                continue
            docs.append((key, tag, np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))))
            held += len(words)
            if held >= buffer:
                yield from emit()
                held = 0
    if docs:
        yield from emit()


def _subtrees(batches, window: int, piece: int):
    """Groups of suffix records, sorted by group, to the spans below deep nodes."""
    import numpy as np
    import pyarrow as pa

    def batch_of(spans):
        doc, tag, first, last = spans
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            ["_key", "_tag", "first", "last"],
        )

    def unpack(payload: bytes):
        n = int(np.frombuffer(payload, np.int64, 1)[0])
        at, out = 8, []
        for kind in (np.uint64, np.int64, np.int32, np.int32, np.uint8, np.uint8):
            out.append(np.frombuffer(payload, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return (*out, np.frombuffer(payload, np.uint8, offset=at).reshape(-1, 6))

    def leaves(payloads):
        least, doc, tag, start, offset, n, tail = (np.concatenate(x) for x in zip(*map(unpack, payloads)))
        n = n.astype(np.int64)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least, doc, tag = (np.repeat(x, n) for x in (least, doc, tag))
        start = np.repeat(start, n) + inner.astype(np.int32)
        offset = (np.repeat(offset, n) - inner).astype(np.uint8)
        whole = np.zeros((len(tail), 8), np.uint8)
        whole[:, :6] = tail
        return whole.view(np.uint64).ravel(), least, offset, doc, tag, start

    def firsts(held, payloads):
        """Spans of later leaves, and the first leaves of ``held`` and ``payloads`` together."""
        found = [np.concatenate(x) for x in zip(*held, leaves(payloads))]
        whole, least, offset, doc, tag, start = found
        gone = _repeats((whole, least, offset), doc, start)
        spans = _spans(doc[gone], tag[gone], start[gone], window)
        return spans, _first_leaves(found, gone)

    group, held, payloads, waiting, full = None, [], [], 0, piece
    for batch in batches:
        for kind, grp, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == 1:
                n = len(payload) // 20
                yield batch_of(
                    (
                        np.frombuffer(payload, np.int64, n),
                        *(np.frombuffer(payload, np.int32, n, n * (8 + 4 * i)) for i in range(3)),
                    )
                )
                continue
            if waiting and (grp != group or waiting >= full):
                spans, first = firsts(held, payloads)
                yield batch_of(spans)
                held, payloads, waiting = [first], [], 0
                full = max(piece, len(first[0]))
            if grp != group:
                group, held, full = grp, [], piece
            payloads.append(payload)
            waiting += len(payload) // 6
    if waiting:
        yield batch_of(firsts(held, payloads)[0])


def repeated_spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE
) -> DataFrame:
    """Word spans ``[first, last)`` that repeat an earlier passage: (_key, _tag, first, last).

    ``_key`` is the id (nulls as the largest number) and ``_tag`` the hash of the text.
    A document's spans may overlap or touch.
    """
    if not 0 < phrase <= window <= 200:
        raise ValueError("a phrase has 1 word to a window's, a window 200 words at most")
    parts = partitions_for(documents)
    groups = parts * 4
    texts = documents.select(long_id(id_col).alias("_key"), text_tag(text_col).alias("_tag"), F.col(text_col).cast("binary").alias("_text")).where(
        "_text IS NOT NULL"
    )
    heavy = _heavy_phrases(texts, window, phrase)
    records = texts.mapInArrow(lambda batches: _suffix_records(batches, groups, window, phrase, heavy, BUFFER_WORDS), _RECORD)
    grouped = records.repartition(parts, "grp").sortWithinPartitions("grp")
    return grouped.mapInArrow(lambda batches: _subtrees(batches, window, GROUP_WINDOWS), _SPAN)


def _cut(batches):
    """Rows (text, spans, …) to rows with the spans' words removed."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        at = names.index("_text")
        texts = batch.column(at).to_pylist()
        spans = batch.column(names.index("_spans")).to_pylist()
        out, totals, removed = [], [], []
        for text, cut in zip(texts, spans):
            if not cut:
                totals.append(len(text.split()) if text else 0)
                removed.append(0)
                out.append(text)
                continue
            bounds = [m.span() for m in WORD_BYTES.finditer(text)]
            keep = np.ones(len(bounds), bool)
            for span in cut:
                keep[span["first"] : span["last"]] = False
            edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
            parts = []
            for first, last in edge.reshape(-1, 2):
                lead = bounds[first - 1][1] if first and parts else bounds[first][0]
                parts.append(text[lead : bounds[last - 1][1]])
            totals.append(len(bounds))
            removed.append(len(bounds) - int(keep.sum()))
            out.append(b"".join(parts))
        columns = [c for name, c in zip(names, batch.columns) if name not in ("_text", "_spans")]
        kept = [name for name in names if name not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(out, pa.binary()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            [*kept, "_text", "_words", "_removed"],
        )


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE
) -> DataFrame:
    """All rows and columns; the text without repeated passages, plus n_words and n_removed.

    A word goes when it lies in a window of ``window`` words that also starts at a smaller
    (id, word position). What is left keeps its white space. Windows are judged on the
    input. Null texts stay null with no words; empty texts stay empty. Null ids count as
    the largest id. Rows that share an id stand at the same place: none of them is earlier
    than another at the same word position, so repeated rows are cut alike. Columns named
    n_words or n_removed in the input are replaced; others pass through unchanged.
    """
    others = [c for c in documents.columns if c not in (text_col, "n_words", "n_removed")]
    plain = {name: f"_c{i}" for i, name in enumerate(others)}
    spans = (
        repeated_spans(documents, id_col, text_col, window, phrase)
        .groupBy("_key", "_tag")
        .agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    )
    rows = documents.select(
        *(F.col(f"`{name}`").alias(alias) for name, alias in plain.items()),
        F.col(text_col).cast("binary").alias("_text"),
        long_id(id_col).alias("_key"),
        text_tag(text_col).alias("_tag"),
    )
    joined = rows.join(spans, ["_key", "_tag"], "left").drop("_key", "_tag")
    schema = [f for f in joined.schema.fields if f.name not in ("_text", "_spans")]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    done = joined.mapInArrow(_cut, f"{columns}, _text binary, _words long, _removed long")
    picked = {name: F.col(alias) for name, alias in plain.items()} | {text_col: F.decode("_text", "UTF-8")}
    return done.select(
        *(picked[name].alias(name) for name in documents.columns if name in picked),
        F.col("_words").alias("n_words"),
        F.col("_removed").alias("n_removed"),
    )
