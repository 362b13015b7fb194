"""Token ids of a corpus as binary files, in ascending document order.

A dataset is a folder of three Parquet tables (Parquet so that Spark's committer puts only
whole files there and any file system that Spark reaches will do):

* ``ranks``: (rank, id, n). Ids are replaced by their rank in the corpus, the most frequent
  first, so that most values fit one byte.
* ``blocks``: one row for about ``BLOCK_IDS`` ids of consecutive documents, with
  ``control`` and ``data`` apart. A control byte holds the byte lengths, less one, of four
  values in two bits each, the first value lowest; ``data`` holds the values' bytes, least
  byte first. A block also has its place (``part``, ``block``, ``first``: ids of its part
  before it), its documents' ids and sizes, and a CRC of its bytes.
* ``parts``: (part, start, n_ids, n_docs), the ids of all parts before each part.

Texts are split at ASCII white space and each different word is encoded once for a task;
for tokenizers that treat white space as a border, as those that split words first do,
ids equal those of the whole text. ``Encoder`` refuses others.

Documents ascend by id; a null id comes last. Documents that share an id follow one
another by text hash, and repeated rows stay apart. A null text is an empty one: it holds the
end id only. The order is made by range partitioning on (id, text hash, row), so an id that
a third of the rows share is spread over tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventledger.llm.common import NO_ID, long_id, partitions_for
from eventledger.session import shared_dir

BLOCK_IDS = 1 << 16
PIECE_BYTES = 1 << 20  # texts are encoded in pieces of this size, cut at white space
CACHED_WORDS = 1_000_000  # of two generations each; a worker keeps them from task to task

BLOCK = (
    "part int, block int, first long, n_ids int, doc_ids array<long>, sizes array<int>, control binary, data binary, crc long"
)

_BORDER = re.compile(rb"[\x20\x09-\x0D]")

# The steps of a tokenizer that ``_PART`` stands for. Words that, lowered, are
# nothing but its matches are split by it as by the tokenizer; others go through the tokenizer.
_KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# UTF-8 of ASCII without the apostrophe and of the letters that U+00C0 … U+00FF lower to.
_PART = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


@dataclass
class Encoder:
    """A tokenizer's JSON file, parsed once per worker process."""

    spec: str
    end_id: int | None = None

    @classmethod
    def load(cls, path: str, end_id: int | None = None) -> Encoder:
        with open(path, encoding="utf-8") as file:
            encoder = cls(file.read(), end_id)
        encoder.check_borders()
        return encoder

    def check_borders(self) -> None:
        """Raise unless words may be encoded one by one: no rule may look across white space."""
        spec = json.loads(self.spec)
        steps = [s for s in _steps(spec.get("pre_tokenizer"), "pretokenizers")]
        drops = any(
            s["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (s["type"] == "Split" and s.get("behavior") == "Removed")
            for s in steps
        )
        prefix = any(s.get("add_prefix_space") for s in steps)
        strips = any(t.get("lstrip") or t.get("rstrip") or _BORDER.search(t["content"].encode()) for t in spec.get("added_tokens", []))
        tokenizer = self.tokenizer()
        probe = ["a b", "it 's", "x1 2y", "é ́e", "ab\ncd", "Σας ς", "- -", "<|a|> b\tc\x0bd\x0ce\rf"]
        encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        same = all(encode(t) == [i for w in _BORDER.split(t.encode()) for i in encode(w.decode())] for t in probe)
        if not drops or prefix or strips or not same:
            raise ValueError("this tokenizer looks across white space; its words cannot be encoded apart")

    @property
    def splits_plainly(self) -> bool:
        """Whether ``_PART`` splits plain words as this tokenizer does."""
        spec = json.loads(self.spec)
        normalizer = [s["type"] for s in _steps(spec.get("normalizer"), "normalizers")]
        steps = _steps(spec.get("pre_tokenizer"), "pretokenizers")
        pattern = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split"]
        kinds, model = [s["type"] for s in steps], spec["model"]
        bytewise = kinds == ["Split", "ByteLevel"] and not steps[1].get("use_regex", True)
        marks = all(t["content"].startswith("<|") and not t.get("normalized") for t in spec.get("added_tokens", []))
        return normalizer == _KNOWN_NORMALIZER and pattern == [_KNOWN_PATTERN] and bytewise and marks and model["type"] == "BPE"

    def tokenizer(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.spec)
        made.no_truncation()
        made.no_padding()
        return made

    @property
    def width(self) -> str:
        """Little-endian type that holds every id."""
        top = max(self.tokenizer().get_vocab_size(), (self.end_id or 0) + 1)
        return "<u2" if top <= 1 << 16 else "<u4"


def _steps(spec, inner: str):
    if not spec:
        return []
    return spec[inner] if spec["type"] == "Sequence" else [spec]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: its own where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Ids, as bytes, of words, and of the parts that the tokenizer's first steps split plain words into."""

    def __init__(self, encoder: Encoder):
        self.tokenizer, self.code = encoder.tokenizer(), {"<u2": "H", "<u4": "I"}[encoder.width]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plainly = encoder.splits_plainly
        self.before: dict[bytes, bytes] = {}  # the generation before, of which words in use come back

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            found = self._encoded(word)
        self[word] = found
        return found

    def _encoded(self, word: bytes) -> bytes:
        parts = ()
        if self.plainly:
            lower = word.lower() if word.isascii() else word.decode().lower().encode()
            parts = _PART.findall(lower)
        if not parts or sum(map(len, parts)) < len(lower) or b"<|" in word:
            return array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(parts) > 1:
            return b"".join([self[p] for p in parts])
        if lower != word:
            return self[lower]
        text = word.decode() if word.isascii() else "".join([self.letters[b] for b in word])
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()


_loaded: dict[int, _Words] = {}


def _pieces(text: bytes):
    """``text`` in pieces of about ``PIECE_BYTES``, cut at white space."""
    at = 0
    while len(text) - at > 2 * PIECE_BYTES:
        border = _BORDER.search(text, at + PIECE_BYTES)
        if not border:
            break
        yield text[at : border.start()]
        at = border.end()
    yield text[at:] if at else text


def _encode(batches, shared, width: str):
    """(_key, _tag, text) to (_key, _tag, n_ids, ids)."""
    import os

    import numpy as np
    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
    encoder: Encoder = shared.value
    code = zlib.crc32(encoder.spec.encode())
    if code not in _loaded:
        _loaded.clear()
        _loaded[code] = _Words(encoder)
    words = _loaded[code]
    end = b"" if encoder.end_id is None else np.array([encoder.end_id], width).tobytes()

    def batch_of(rows):
        keys, tags, ids = zip(*rows)
        sizes = pa.array([len(i) // np.dtype(width).itemsize for i in ids], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(tags, pa.int64()), sizes, pa.array(ids, pa.binary())], ["_key", "_tag", "n_ids", "ids"]
        )

    for batch in batches:
        held, size = [], 0
        for key, tag, text in zip(*(batch.column(i) for i in range(3))):
            parts = [b"".join(map(words.__getitem__, piece.split())) for piece in _pieces((text.as_py() or "").encode())]
            parts.append(end)
            held.append((key.as_py(), tag.as_py(), b"".join(parts)))
            size += len(held[-1][2])
            if size >= 4 * PIECE_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)


def _histogram(batches, width: str):
    """Ids to (id, n), once for each task."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(0, np.int64)
    for batch in batches:
        column = batch.column(0)
        for start in range(0, len(column), 256):
            ids = np.frombuffer(b"".join(column[start : start + 256].to_pylist()), width)
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def pack(values):
    """uint32 values to (control, data) bytes."""
    import numpy as np

    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    widest = int(lengths.max()) if len(lengths) else 1
    data = values.view(np.uint8).reshape(-1, 4)[:, :widest][np.arange(widest) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def _tables():
    """Lengths that each control byte stands for, and the bits that a value of each length has."""
    import numpy as np

    lengths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    masks = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
    return lengths.astype(np.int64), masks


def unpack(control: bytes, data: bytes, n: int):
    """The ``n`` values of a block, by table lookup for all at once."""
    import numpy as np

    by_control, masks = _tables()
    lengths = by_control[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    if (ends[-1] if n else 0) != len(data) or len(control) != -(-n // 4):
        raise ValueError("a block's control bytes do not fit its data")
    padded, starts = np.frombuffer(data + b"\0\0\0", np.uint8), ends - lengths
    values = padded[starts].astype(np.uint32)
    for byte in range(1, int(lengths.max()) if n else 1):
        values |= padded[starts + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values & masks[lengths]


def _blocks(batches, shared, width: str, block_ids: int):
    """Documents in order to blocks of their ranks."""
    import numpy as np
    import pyarrow as pa

    rank_of, part = shared.value, TaskContext.get().partitionId()
    block, first, keys, sizes, waiting, held = 0, 0, [], [], [], 0

    def row():
        values = rank_of[np.frombuffer(b"".join(waiting), width)]
        control, data = pack(values)
        cells = (part, block, first, len(values), keys, sizes, control, data, zlib.crc32(data, zlib.crc32(control)))
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK_SCHEMA().names, cells))], _BLOCK_SCHEMA())

    for batch in batches:
        for key, n, ids in zip(*(batch.column(i) for i in range(3))):
            keys.append(None if key.as_py() == NO_ID else key.as_py())
            sizes.append(n.as_py())
            waiting.append(ids.as_py())
            held += n.as_py()
            if held >= block_ids:
                yield row()
                block, first, keys, sizes, waiting, held = block + 1, first + held, [], [], [], 0
    if keys:
        yield row()


def _BLOCK_SCHEMA():
    import pyarrow as pa

    return pa.schema(
        [
            ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
            ("control", pa.binary()), ("data", pa.binary()), ("crc", pa.int64()),
        ]
    )


def write(
    documents: DataFrame, path: str, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Encode every whole text and write a dataset at ``path``, a folder that every executor reaches.

    The encoded texts are staged once; the ranks, the order and the blocks are made from
    them. What the driver holds is bounded by the vocabulary (ids and their counts).
    """
    import numpy as np

    spark = documents.sparkSession
    width, parts = encoder.width, partitions_for(documents)
    shared = spark.sparkContext.broadcast(encoder)
    rows = documents.select(long_id(id_col).alias("_key"), F.xxhash64(text_col).alias("_tag"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(lambda batches: _encode(batches, shared, width), "_key long, _tag long, n_ids int, ids binary")
    stage = shared_dir(spark, "token-ids")
    coded.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)

    counted = staged.select("ids").mapInArrow(lambda batches: _histogram(batches, width), "id long, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    rank_of = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.uint32)
    rank_of[counts["id"]] = np.arange(len(counts))
    counts.insert(0, "rank", np.arange(len(counts)))
    ranks = spark.createDataFrame(list(counts.itertuples(index=False, name=None)), "rank long, id long, n long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")

    ordered = staged.repartitionByRange(parts, "_key", "_tag", "_row").sortWithinPartitions("_key", "_tag", "_row")
    ranked = spark.sparkContext.broadcast(rank_of)
    made = ordered.select("_key", "n_ids", "ids").mapInArrow(lambda batches: _blocks(batches, ranked, width, block_ids), BLOCK)
    made.write.parquet(f"{path}/blocks")

    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(
        F.sum("n_ids").alias("n_ids"), F.sum(F.size("sizes")).cast("long").alias("n_docs")
    )
    # One row for each partition of the write above: as many as ``parts``, however large the corpus.
    sums.selectExpr(
        "part", "coalesce(sum(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start", "n_ids", "n_docs"
    ).coalesce(1).write.parquet(f"{path}/parts")


def _ids_of_ranks(spark: SparkSession, path: str):
    """Array of the ids by rank: as long as the vocabulary that occurs."""
    import numpy as np

    ranks = spark.read.parquet(f"{path}/ranks").toPandas()
    ids = np.zeros(len(ranks), np.uint32)
    ids[ranks["rank"]] = ranks["id"]
    return spark.sparkContext.broadcast(ids)


def _decoded(row: dict, ids):
    """The ids of one block; raises on damaged bytes."""
    control, data = row["control"], row["data"]
    if zlib.crc32(data, zlib.crc32(control)) != row["crc"]:
        raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
    return ids[unpack(control, data, row["n_ids"])].astype("<u4")


def _documents(batches, shared):
    import numpy as np
    import pyarrow as pa

    ids = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            values = _decoded(row, ids).tobytes()
            ends = np.cumsum(np.array(row["sizes"], np.int64))
            starts = ends - row["sizes"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + row["first"] + starts, pa.int64()),
                    pa.array(row["sizes"], pa.int64()),
                    pa.array([values[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the number of ids before their part; one row a part is broadcast."""
    starts = spark.read.parquet(f"{path}/parts").select("part", "start")
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(F.broadcast(starts), "part")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a dataset: (doc_id, start, n_tokens, ids), ids as little-endian unsigned
    32-bit integers, ``start`` the number of ids of all documents before."""
    ids = _ids_of_ranks(spark, path)
    return _placed(spark, path).mapInArrow(
        lambda batches: _documents(batches, ids), "doc_id long, start long, n_tokens long, ids binary"
    )


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids at corpus places ``[first, last)`` as (place, ids), one row for each block touched.

    Only blocks whose places overlap are decoded, as a training loader wants them.
    """
    ids = _ids_of_ranks(spark, path)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = row["start"] + row["first"]
                values = _decoded(row, ids.value)[max(0, first - at) : max(0, last - at)]
                yield pa.RecordBatch.from_pylist([{"place": max(at, first), "ids": values.tolist()}], pa.schema([("place", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    at = F.col("start") + F.col("first")
    touched = _placed(spark, path).where((at < last) & (at + F.col("n_ids") > first))
    return touched.mapInArrow(cut, "place long, ids array<long>")
