"""Near duplicates by SimHash, searched with a Gray-order hierarchical index.

Fingerprints within ``max_bits`` of one another agree on all but ``max_bits`` of the blocks
that 64 bits are cut into, so each pair meets in at least one table that is keyed by the
blocks left over. A table's rows are dealt out by range in the order (table, key, Gray
rank), which cuts a crowded key anywhere. Within a partition every key's fingerprints, in
Gray order, form a tree: neighbours in that order differ in few bits, so a node can factor
out the bits that all fingerprints below it share. The search goes down pairs of nodes and
drops a pair once the shared patterns alone differ in more than ``max_bits`` bits. Keys
that reach over several partitions send their leaves, again with shared patterns, to a
join that prunes in the same way before fingerprints are compared.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import NO_ID, long_id, partitions_for, text_tag, written
from eventledger.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
FANOUT = 16
LEAF = 1024  # fingerprints in a leaf that travels between partitions
KEY_ROWS = 4096  # fingerprints that one key of a table should hold on average
PART_ROWS = 500_000


def _fingerprints(batches, shingle: int):
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest

    def fingerprint(text: bytes | None) -> int:
        words = text.lower().split() if text else []
        if not words:
            return 0
        joined = b" ".join(words)
        if len(words) <= shingle:
            codes = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            last = len(words) - shingle + 1
            codes = [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())]
        ones = np.zeros(64, np.int64)
        for i in range(0, len(codes), 1 << 16):
            part = np.array(codes[i : i + (1 << 16)], dtype="<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(codes), bitorder="little")
        return int(bits.view("<i8")[0])

    for batch in batches:
        codes = [fingerprint(text) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(codes, pa.int64())], ["_key", "_tag", "fp"]
        )


def fingerprints(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(_key, _tag, fp) per row: id (nulls as the largest number), text hash, signed 64 bits.

    Texts lose the case of A-Z. A text with fewer words than a shingle is one shingle; one
    without words, or null, has fingerprint zero.
    """
    rows = documents.select(
        long_id(id_col).alias("_key"), text_tag(text_col).alias("_tag"), F.col(text_col).cast("binary").alias("_text")
    )
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), "_key long, _tag int, fp long")


def _gray_rank(name: str) -> Column:
    rank = F.col(name)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank


def _masks(max_bits: int, blocks: int) -> list[int]:
    """A mask per table, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(values, bucket):
    """Levels of a tree per bucket: lists of (value, shared bits, first child, children)."""
    import numpy as np

    levels = [(values, np.full(len(values), ~np.uint64(0)), None, None)]
    while True:
        value, shared = levels[-1][:2]
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        if len(begins) == len(bucket):
            return levels
        sizes = np.diff(np.r_[begins, len(bucket)])
        place = np.arange(len(bucket)) - np.repeat(begins, sizes)
        first = np.flatnonzero(place % FANOUT == 0)
        both = np.bitwise_and.reduceat(value, first)
        agree = np.bitwise_and.reduceat(shared, first) & ~(both ^ np.bitwise_or.reduceat(value, first))
        levels.append((both & agree, agree, first, np.diff(np.r_[first, len(bucket)])))
        bucket = bucket[first]


def _search(levels, left, right, max_bits: int):
    """Pairs of leaves (i < j) within ``max_bits`` below the given pairs of top nodes."""
    import numpy as np

    stack = [(len(levels) - 1, left, right)]
    while stack:
        level, left, right = stack.pop()
        if level == 0:
            yield left, right
            continue
        if len(left) > 4096:
            stack.append((level, left[4096:], right[4096:]))
            left, right = left[:4096], right[:4096]
        first, count = levels[level][2:]
        value, shared = levels[level - 1][:2]
        width = count[right]
        n = count[left] * width
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(width, n)
        a = np.repeat(first[left], n) + at // wide
        b = np.repeat(first[right], n) + at % wide
        near = np.bitwise_count((value[a] ^ value[b]) & shared[a] & shared[b]) <= max_bits
        near &= (a < b) if level == 1 else (a <= b)
        if near.any():
            stack.append((level - 1, a[near], b[near]))


def _union(parent, a, b):
    """Joins a and b in the forest ``parent``, whose roots are the smallest members."""
    import numpy as np

    while len(a):
        while True:
            up = parent[a]
            if (up == a).all():
                break
            a = up
        while True:
            up = parent[b]
            if (up == b).all():
                break
            b = up
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _edges(values, parent):
    import numpy as np
    import pyarrow as pa

    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    n = len(moved)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(values[moved].view(np.int64)), pa.array(values[parent[moved]].view(np.int64)),
            pa.nulls(n, pa.int32()), none, none, none, none, pa.nulls(n, pa.binary()),
        ],
        ["u", "v", "tbl", "key", "part", "value", "shared", "leaf"],
    )


_INDEXED = "u long, v long, tbl int, key long, part long, value long, shared long, leaf binary"


def _index(batches, max_bits: int):
    """A partition sorted by (table, key, Gray rank) to edges, and leaves of its outer keys."""
    import numpy as np
    import pyarrow as pa

    parts = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches if batch.num_rows]
    if not parts:
        return
    tbl, key, values = (np.concatenate(x) for x in zip(*parts))
    values = values.view(np.uint64)
    new = np.r_[True, (tbl[1:] != tbl[:-1]) | (key[1:] != key[:-1])]
    bucket = np.cumsum(new) - 1
    levels = _forest(values, bucket)
    top = np.arange(len(levels[-1][0]))
    parent = np.arange(len(values))
    for a, b in _search(levels, top, top, max_bits):
        _union(parent, a, b)
    yield _edges(values, parent)

    rows = []
    for edge in sorted({0, bucket[-1]}):
        lo, hi = np.searchsorted(bucket, [edge, edge + 1])
        for i in range(lo, hi, LEAF):
            leaf = values[i : min(i + LEAF, hi)]
            both, some = np.bitwise_and.reduce(leaf), np.bitwise_or.reduce(leaf)
            agree = ~(both ^ some)
            numbers = [int(np.uint64(x).astype(np.int64)) for x in (values[lo], both & agree, agree)]
            rows.append((None, None, int(tbl[lo]), int(key[lo]), *numbers, leaf.tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
    names = ["u", "v", "tbl", "key", "part", "value", "shared", "leaf"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _across(batches, max_bits: int):
    """Pairs of leaves of one key to edges."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(left) // 8
            values = np.frombuffer(left + right, np.uint64)
            side = (np.arange(len(values)) >= n).astype(np.int64)
            levels = _forest(values, side)
            parent = np.arange(len(values))
            for a, b in _search(levels, np.array([0]), np.array([1]), max_bits):
                _union(parent, a, b)
            edges = _edges(values, parent)
            if edges.num_rows:
                yield pa.RecordBatch.from_arrays(edges.columns[:2], ["u", "v"])


def links(distinct: DataFrame, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect what a chain of fingerprints within ``max_bits`` connects.

    ``distinct`` has each fingerprint once in column fp, ``rows`` of them.
    """
    blocks = max_bits + 1
    while rows >> (64 * (blocks - max_bits) // blocks) > KEY_ROWS and blocks < max_bits + 4:
        blocks += 1
    masks = _masks(max_bits, blocks)
    table = F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("tbl", "mask")
    keyed = distinct.select("fp", table).select("tbl", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    least = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, rows * len(masks) // PART_ROWS)
    ranked = keyed.repartitionByRange(parts, "tbl", "key", _gray_rank("fp"))
    ordered = ranked.sortWithinPartitions("tbl", "key", _gray_rank("fp"))
    found = written(ordered.mapInArrow(lambda batches: _index(batches, max_bits), _INDEXED), "simhash-index")
    leaves = found.where("leaf IS NOT NULL").select("tbl", "key", "part", "value", "shared", "leaf")
    a, b = leaves.alias("a"), leaves.alias("b")
    apart = F.expr("bit_count((a.value ^ b.value) & a.shared & b.shared)")
    pairs = a.join(
        b,
        (F.col("a.tbl") == F.col("b.tbl")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.part") < F.col("b.part")) & (apart <= max_bits),
    ).select(F.col("a.leaf").alias("left"), F.col("b.leaf").alias("right"))
    return found.where("leaf IS NULL").select("u", "v").union(
        pairs.mapInArrow(lambda batches: _across(batches, max_bits), "u long, v long")
    )


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(_key, _tag, fp, component) per row; the component is the smallest id reachable.

    Rows link when their fingerprints differ in at most ``max_bits`` bits, equal and zero
    fingerprints included. A null id is the largest number in _key and component; repeated
    rows each give a row. Columns beside the id and the text are not read.
    """
    if not 0 <= max_bits < 60:
        raise ValueError("max_bits must lie between 0 and 59")
    rows = written(fingerprints(documents, id_col, text_col, shingle), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("_key").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distinct.count(), max_bits), "simhash-components")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    found = placed.select("fp", "root").join(least, "root").select("fp", "component")
    return rows.join(found, "fp").select("_key", "_tag", "fp", "component")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def known_id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def one_of_each(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component; all columns of ``documents``."""
    stay = found.where("_key = component").select("_key", "_tag", "component").distinct()
    rows = documents.select("*", long_id(id_col).alias("_key"), text_tag(text_col).alias("_tag"))
    return rows.join(stay, ["_key", "_tag"]).dropDuplicates(["_key", "component"]).select(*documents.columns)
