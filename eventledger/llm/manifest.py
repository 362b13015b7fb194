"""A Merkle manifest of a dataset: leaf coordinates by bitmap ranks, levels by slot arrays.

Leaves of a group (a language, say) ascend by id. Each run of ``2`` consecutive nodes, the
last one perhaps a lone node, becomes its hash, until one node, the subroot, is left; the
subroots in the order of their groups (null first, then by bytes) give the root likewise.

* **Coordinates.** Each group's ids are merged into compressed bitmaps: containers of
  ``1 << SPAN_BITS`` ids, of which only those with a document exist, each of a few 64-bit
  words that an aggregation ORs together before and after the shuffle. A directory holds
  the number of leaves before each container. A leaf's place is the directory's count, the
  set bits in the words before its own and those below its bit. No leaf is sorted.
* **Ids that occur more than once** set one bit. Where a container holds more rows than
  bits, its repeated ids are counted apart and added to the ranks above them; their own
  rows stand in the order of leaf digest (equal rows: any order, they are the same).
* **Levels.** Leaves are collected by (group, place / 1024) into arrays of 1024 slots
  (``1 << FAN_BITS``) keyed by place; one such array reduces ten levels at once, and its roots are the next
  nodes. Paths come back down the same arrays, so what moves is a digest a leaf.

A null id sorts behind all others. An empty table gives no rows. No task holds more than
the containers or slot arrays of its partition, whatever share of the rows one group has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import NO_ID, long_id, written
from eventledger.operators.numbering import number_rows, totals_before

SPAN_BITS = 9
WORDS = (1 << SPAN_BITS) // 64
FAN_BITS = 10


def field(column: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _group_key(name: str) -> Column:
    """Orders null first, then by bytes, and is never null itself."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Containers (_g, bucket, w0 … , n) with ``before``, the leaves of the group before each."""
    bit = "shiftleft(1L, CAST(_key & 63 AS INT))"
    words = [F.expr(f"bit_or(IF((_key & {(1 << SPAN_BITS) - 1}) DIV 64 = {k}, {bit}, 0L))").alias(f"w{k}") for k in range(WORDS)]
    merged = rows.groupBy("_g", F.shiftright("_key", SPAN_BITS).alias("bucket")).agg(*words, F.count("*").alias("n"))
    return written(totals_before(merged, ["bucket"], "n", ["_g"]), "bitmaps")


def _repeats(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What repeated ids add to ranks in their containers, and the order among their rows."""
    distinct = " + ".join(f"bit_count(w{k})" for k in range(WORDS))
    crowded = index.where(f"n > {distinct}").select("_g", "bucket")
    if crowded.isEmpty():
        return None
    inside = rows.join(crowded, (rows["_g"] == crowded["_g"]) & (F.shiftright(rows["_key"], SPAN_BITS) == crowded["bucket"]), "left_semi")
    several = written(inside.groupBy("_g", "_key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-ids")
    extra = F.expr(f"struct(_key & {(1 << SPAN_BITS) - 1} AS low, n - 1 AS more)")
    extras = several.groupBy("_g", F.shiftright("_key", SPAN_BITS).alias("bucket")).agg(F.collect_list(extra).alias("extras"))
    same = rows.select("_g", "_key", "_row", "node").join(several.select("_g", "_key"), ["_g", "_key"], "left_semi")
    return extras, number_rows(same, ["node", "_row"], ["_g", "_key"], "_among").select("_row", "_among")


def _coordinates(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their leaf's place in its group."""
    repeats = _repeats(rows, index)
    if repeats:
        extras, among = repeats
        index = index.join(extras, ["_g", "bucket"], "left")
        rows = rows.join(among, "_row", "left")
    else:
        index = index.withColumn("extras", F.lit(None).cast("array<struct<low: bigint, more: bigint>>"))
        rows = rows.withColumn("_among", F.lit(0).cast("bigint"))
    low = f"(_key & {(1 << SPAN_BITS) - 1})"
    below = "~shiftleft(-1L, CAST(_key & 63 AS INT))"
    ranks = " + ".join(
        f"CASE WHEN {low} DIV 64 > {k} THEN bit_count(w{k}) WHEN {low} DIV 64 = {k} THEN bit_count(w{k} & ({below})) ELSE 0 END"
        for k in range(WORDS)
    )
    more = f"coalesce(aggregate(extras, 0L, (sum, e) -> sum + IF(e.low < {low}, e.more, 0L)), 0L)"
    keyed = rows.withColumn("bucket", F.shiftright("_key", SPAN_BITS)).join(index.drop("n"), ["_g", "bucket"])
    return keyed.selectExpr(*(f"`{c}`" for c in rows.columns if c != "_among"), f"before + {ranks} + {more} + coalesce(_among, 0L) AS pos")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    return max(0, n - 1).bit_length()


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level of one slot array, its own first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _slot_rows(batches, fan_bits: int):
    """Slot arrays one by one: (row of the batch, its index, arrays of the slots, nodes by level)."""
    for batch in batches:
        slots, counts = batch.column("slots"), batch.column("n")
        for i in range(batch.num_rows):
            cells = slots.slice(i, 1).flatten()
            nodes = cells.field("node").to_pylist()
            yield batch, i, cells, _reduced(nodes, min(fan_bits, _levels_of(counts[i].as_py())))


def _roots(batches, fan_bits: int):
    import pyarrow as pa

    for batch, i, _, levels in _slot_rows(batches, fan_bits):
        yield pa.RecordBatch.from_arrays(
            [batch.column("_g").slice(i, 1), batch.column("chunk").slice(i, 1), pa.array(levels[-1])], ["_g", "pos", "node"]
        )


def _paths(batches, carried: Sequence[str], above: Sequence[str], fan_bits: int):
    """Slot arrays with the path above each to one row a slot, with its whole path."""
    import numpy as np
    import pyarrow as pa

    for batch, i, cells, levels in _slot_rows(batches, fan_bits):
        upper = batch.column("upper")[i].as_py()
        paths = []
        for s in range(len(cells)):
            near = [level[s >> k ^ 1] for k, level in enumerate(levels[:-1]) if s >> k ^ 1 < len(level)]
            paths.append("".join(near) + upper)
        slot = np.arange(len(cells))
        same = pa.array(np.full(len(cells), i))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_g").take(same), pa.array(slot + (batch.column("chunk")[i].as_py() << fan_bits)),
                cells.field("node"), pa.array(paths, pa.string()), *(cells.field(c) for c in carried), *(batch.column(c).take(same) for c in above),
            ],
            ["_g", "pos", "node", "path", *carried, *above],
        )


def _climb(nodes: DataFrame, sizes: DataFrame, most: int, fan_bits: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of all levels, and the last node of each group.

    ``nodes``: (_g, pos, node, …), ``sizes``: (_g, n) with the number of nodes, ``most`` the largest.
    """
    levels, fan = [], 1 << fan_bits
    while True:
        rest = [c for c in nodes.columns if c not in ("_g", "pos", "node")]
        slot = F.struct(F.expr(f"CAST(pos & {fan - 1} AS INT)").alias("slot"), "node", *rest)
        arrays = nodes.groupBy("_g", F.shiftright("pos", fan_bits).alias("chunk")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        levels.append(written(arrays.join(sizes, "_g"), label))
        nodes = levels[-1].mapInArrow(lambda batches: _roots(batches, fan_bits), "_g string, pos long, node string")
        if most <= fan:
            return levels, nodes
        sizes = sizes.withColumn("n", F.shiftright(F.col("n") + (fan - 1), fan_bits))
        most = -(-most // fan)


def _descend(levels: list[DataFrame], above: DataFrame, fan_bits: int, label: str) -> DataFrame:
    """Paths of all nodes of the lowest level; ``above``: (_g, pos, path, …), what lies over the last node."""
    for level, arrays in reversed(list(enumerate(levels))):
        extra = [c for c in above.columns if c not in ("_g", "pos", "path")]
        upper = above.withColumnsRenamed({"pos": "chunk", "path": "upper"})
        joined = arrays.join(upper, ["_g", "chunk"])
        cell = arrays.schema["slots"].dataType.elementType
        carried = [f.name for f in cell if f.name not in ("slot", "node")]
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in [*(cell[c] for c in carried), *(above.schema[c] for c in extra)]]
        schema = ", ".join(["_g string, pos long, node string, path string", *kinds])
        rows = joined.mapInArrow(lambda batches, c=carried, e=extra: _paths(batches, c, e, fan_bits), schema)
        above = written(rows.select("_g", "pos", "path", *extra), label) if level else rows
    return above


def build(
    documents: DataFrame,
    fields: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    keep: dict[str, Column] | None = None,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """The manifest: one row a document with its ``leaf`` over ``fields``, its ``subroot``, the
    ``root``, and ``proof``: the hex digests of all siblings up to the root, one after the
    other. ``pos``, ``n_leaves``, ``group_pos`` and ``n_groups`` say where each belongs.

    ``keep`` adds columns computed from the document, for instance a digest that someone
    claims for it and ``fold`` may check.
    """
    keep = keep or {}
    rows = documents.select(
        _group_key(group_col).alias("_g"), long_id(id_col).alias("_key"), leaf(*(F.col(c) for c in fields)).alias("node"),
        *(c.alias(name) for name, c in keep.items()),
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "leaves")
    index = _bitmaps(rows)
    groups = index.groupBy("_g").agg(F.sum("n").alias("n"))
    groups = written(number_rows(groups, ["_g"], name="group_pos"), "groups")
    most, n_groups = groups.agg(F.max("n"), F.count("*")).first()

    placed = _coordinates(rows, index).drop("_row")
    levels, tops = _climb(placed, groups.select("_g", "n"), most or 0, fan_bits, "slots")
    subroots = written(tops.join(groups, "_g").select("_g", "group_pos", "n", F.col("node").alias("subroot")), "subroots")

    # The subroots are the leaves of one more tree, whose only group is the dataset.
    over = subroots.select(
        F.lit("").alias("_g"), F.col("group_pos").alias("pos"), F.col("subroot").alias("node"), F.col("_g").alias("group"), "n"
    )
    size = rows.sparkSession.range(1).select(F.lit("").alias("_g"), F.lit(n_groups).cast("long").alias("n"))
    top_levels, top = _climb(over, size, n_groups, fan_bits, "top-slots")
    summit = top.select("_g", "pos", F.lit("").alias("path"), F.col("node").alias("root"))
    group_paths = _descend(top_levels, summit, fan_bits, "top-paths")
    above = group_paths.select(
        F.col("group").alias("_g"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root",
        F.col("n").alias("n_leaves"), F.col("pos").alias("group_pos"), F.lit(n_groups).cast("long").alias("n_groups"),
    )
    paths = _descend(levels, written(above, "group-paths"), fan_bits, "paths")
    return paths.select(
        F.when(F.col("_key") != NO_ID, F.col("_key")).alias(id_col), F.col("node").alias("leaf"), "subroot", "root",
        F.col("path").alias("proof"), "pos", "n_leaves", "group_pos", "n_groups", *keep,
    )


def _fold_one(node: str, proof: str, pos: int, n: int, used: int) -> tuple[str, int]:
    """``node`` up to the last node over ``n``; the proof's digests from ``used`` on are its siblings."""
    while n > 1:
        if pos ^ 1 < n:
            other = proof[used : used + 64]
            used += 64
            node = _digest(other + node if pos & 1 else node + other)
        else:
            node = _digest(node)
        pos, n = pos >> 1, n + 1 >> 1
    return node, used


def _fold(batches, claim: str, name: str):
    import pyarrow as pa

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (claim, "proof", "pos", "n_leaves", "group_pos", "n_groups")]
        out = []
        for node, proof, pos, n, group_pos, n_groups in zip(*columns):
            if node is not None:
                node, used = _fold_one(node, proof, pos, n, 0)
                node, _ = _fold_one(node, proof, group_pos, n_groups, used)
            out.append(node)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])


def fold(manifest: DataFrame, claim: str = "leaf", name: str = "folded_root") -> DataFrame:
    """Adds the root that each row's digest ``claim`` leads to with the row's own proof; null for null."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema), f"`{name}` string"])
    return manifest.mapInArrow(lambda batches: _fold(batches, claim, name), schema)
