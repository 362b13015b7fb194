"""SentencePiece encoding and decoding by Viterbi search over words of equal length.

A batch's distinct words are grouped by length; the words of a group advance through their
positions together. For each end position and piece length one probe of the sorted piece
keys by substring hash finds the pieces of all words, and a maximum over the lengths leaves
a back pointer for each word. What is maximised depends on the model's type:

* Unigram models: the sum of the pieces' scores.
* BPE models: scores are merge ranks there, and their sum is not what such a model asks
  for. A segmentation is the one that merging gives if and only if each two neighbouring
  pieces are what merging makes of them alone. So a step has value 0 if the piece is
  compatible with the last piece of the prefix before it, else minus infinity; exactly one
  length survives. Compatibility follows from undoing the merges next to the seam, the
  latest first, and asking whether a merge across it would have come earlier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model file
UNIGRAM, BPE = 1, 2
BASE = 0x9E3779B97F4A7C15
SPREAD = 0xD6E8FEB86659FD93  # odd: spreads hashes over their leading bits
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
HELD_WORDS = 300_000  # words whose ids a task remembers
SLICE = 3_000_000  # bytes of text that are encoded at a time


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """A model file's pieces as arrays, with what the search needs. Its size is the vocabulary's."""

    kind: int
    pieces: list[str]
    types: list[int]
    scores: list[float]
    unknown: int
    dummy_prefix: bool
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> Model:
        import struct

        with open(path, "rb") as file:
            data = file.read()
        pieces, types, scores = [], [], []
        kind, dummy, tidy, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                parts = dict(_fields(value))
                pieces.append(parts.get(1, b"").decode())
                scores.append(struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0)
                types.append(parts.get(3, _NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                dummy, tidy, charsmap = bool(rules.get(3, 1)), bool(rules.get(4, 1)), rules.get(2, b"")
        if kind not in (UNIGRAM, BPE) or charsmap or tidy or _USER in types:
            raise ValueError("only unigram and BPE models without normalisation or user symbols are supported")
        unknown = types.index(_UNKNOWN)
        at = {p: i for i, p in enumerate(pieces) if types[i] == _BYTE}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if at else []
        return cls(kind, pieces, types, scores, unknown, dummy, byte_ids)

    def separators(self) -> str:
        """Characters among line breaks and tabs that no longer piece holds."""
        joined = {c for p, t in zip(self.pieces, self.types) if t == _NORMAL and len(p) > 1 for c in p}
        return "".join(c for c in "\n\t\r" if c not in joined)

    def tails(self) -> str:
        """Punctuation that no piece holds after a letter: merging stops there."""
        after = re.compile(f"[{LETTERS}]([^{LETTERS}])")
        held = {c for p, t in zip(self.pieces, self.types) if t == _NORMAL for c in after.findall(p)}
        return "".join(c for c in ".,;:!?$%&#*|" if c not in held)

    def by_words(self) -> bool:
        """Whether no piece goes on into the next word."""
        return not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, t in zip(self.pieces, self.types) if t == _NORMAL)


LONG_WORD = 24  # characters from which a word is looked at for places to cut


def merged(symbols: list[str], rank: dict[str, int]) -> list[tuple]:
    """Symbols merged by rank, the leftmost of equals first; each as (text, left, right)."""
    parts: list[tuple] = [(s, None, None) for s in symbols]
    while True:
        best = min(
            ((rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a[0] + b[0] in rank), default=None
        )
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][0], parts[i + 1][0])]


class Encoder:
    """Encodes distinct words of a batch together; made on the driver, as large as the vocabulary."""

    def __init__(self, model: Model):
        import numpy as np

        self.model = model
        chosen = [i for i, t in enumerate(model.types) if t == _NORMAL]
        rank: dict[str, int] = {}
        if model.kind == BPE:
            order = {s: n for n, s in enumerate(sorted({model.scores[i] for i in chosen}, reverse=True))}
            rank = {model.pieces[i]: order[model.scores[i]] for i in chosen if len(model.pieces[i]) > 1}
        at = {model.pieces[i]: i for i in chosen}
        size = len(model.pieces)
        self.none = size  # stands for a character without a piece
        self.rank = np.full(size + 1, -1, np.int64)
        self.left = np.full(size + 1, -1, np.int64)
        self.right = np.full(size + 1, -1, np.int64)
        usable = []
        for i in chosen:
            piece = model.pieces[i]
            if model.kind == BPE and len(piece) > 1:
                parts = merged(list(piece), rank)
                if len(parts) > 1:
                    continue  # no text is ever merged into it
                self.rank[i] = rank[piece]
                self.left[i] = at.get(parts[0][1], self.none)
                self.right[i] = at.get(parts[0][2], self.none)
            usable.append(i)
        self.hash = np.zeros(size + 1, np.uint64)
        self.size = np.ones(size + 1, np.int64)
        for i in usable:
            self.hash[i] = self._hash_of(model.pieces[i])
            self.size[i] = len(model.pieces[i])
        ids = np.array(usable)
        # The length is part of the key; equal keys would mean that two pieces collide.
        keys = self.hash[ids] * np.uint64(SPREAD)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        # Keys are spread evenly, so their leading bits tell almost where a key stands.
        self.begin = np.searchsorted(self.keys, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        leading = (self.keys >> np.uint64(46)).astype(np.int64)
        self.crowd = int(np.bincount(leading).max())
        self.keys = np.r_[self.keys, np.zeros(self.crowd, np.uint64)]
        self.ids = np.r_[self.ids, np.full(self.crowd, -1)]
        self.seen = np.zeros(1 << 21, bool)  # whether any key begins with these bits
        self.seen[(self.keys[: -self.crowd] >> np.uint64(43)).astype(np.int64)] = True
        self.pairs = self.fits = None  # pairs that were judged, by a hash of them; a task's own
        self.longest = int(self.size[ids].max())
        self.power = np.array([pow(BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        worst = min(model.scores[i] for i in chosen)
        self.score = np.array([*model.scores, worst - 10.0])
        inner = {a << 32 | b for i in usable for a, b in zip(map(ord, model.pieces[i]), map(ord, model.pieces[i][1:]))}
        self.inner = np.array(sorted(inner), np.uint64)  # neighbouring characters that some piece holds

    @staticmethod
    def _hash_of(text: str) -> int:
        value = 0
        for c in text:
            value = (value * BASE + ord(c) + 1) & (1 << 64) - 1
        return value

    def probe(self, hashes):
        """Places of the hashes that are pieces' hashes, and those pieces."""
        import numpy as np

        keys = hashes * np.uint64(SPREAD)
        places = np.flatnonzero(self.seen[(keys >> np.uint64(43)).astype(np.int64)])
        keys = keys[places]
        at = self.begin[(keys >> np.uint64(46)).astype(np.int64)]
        found = np.full(len(keys), -1)
        for step in range(self.crowd):
            there = self.keys[at + step] == keys
            found[there] = self.ids[at[there] + step]
        real = found >= 0
        return places[real], found[real]

    def compatible(self, left, right):
        """Whether merging what both pieces hold gives just these two; remembers what it judged."""
        import numpy as np

        if self.pairs is None:
            self.pairs, self.fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        pair = left << 32 | right
        slot = ((pair.view(np.uint64) * np.uint64(BASE)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.pairs[slot] != pair)
        good = self.fits[slot]
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            judged = self._judge(fresh >> 32, fresh & 0xFFFFFFFF)
            good[new] = judged[back]
            at = slot[new]
            self.pairs[at], self.fits[at] = -1, False
            self.pairs[at] = pair[new]
            self.fits[at] = good[new]
        return good

    def _judge(self, left, right):
        import numpy as np

        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        limit = np.full(len(left), np.iinfo(np.int64).max)
        left, right = left.copy(), right.copy()
        while len(live):
            at, whole = self.probe(self.hash[left] * self.power[self.size[right]] + self.hash[right])
            across = (left[at] != self.none) & (right[at] != self.none) & (self.size[left[at]] + self.size[right[at]] == self.size[whole])
            early = np.zeros(len(left), bool)
            early[at] = across & (2 * self.rank[whole] < limit[at])
            good[live[early]] = False
            undo_left = self.rank[left] > self.rank[right]
            limit = np.where(undo_left, 2 * self.rank[left], 2 * self.rank[right] + 1)
            going = ~early & ((self.left[left] >= 0) | (self.left[right] >= 0))
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
            left, right, limit, live = left[going], right[going], limit[going], live[going]
        return good

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers.

        Long words are cut between characters that no piece holds side by side: nothing is
        ever merged across. Scripts without spaces come as short words that way.
        """
        # Neighbouring unknown characters are one id where they are not spelled as bytes.
        cut = {w: self._cut(w) for w in words if len(w) > LONG_WORD} if self.model.byte_ids else {}
        if not cut:
            return self._solve(words)
        parts = {p for found in cut.values() for p in found}
        distinct = list(parts.union(w for w in words if w not in cut))
        ids = dict(zip(distinct, self._solve(distinct)))
        return [b"".join([ids[p] for p in cut[w]]) if w in cut else ids[w] for w in words]

    def _cut(self, word: str) -> list[str]:
        import numpy as np

        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.inner, pairs), max(0, len(self.inner) - 1))
        joined = self.inner[at] == pairs if len(self.inner) else np.zeros(len(pairs), bool)
        ends = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:])]

    def _solve(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, rows in by_length.items():
            step = max(1, 1_000_000 // (length + 1))
            for i in range(0, len(rows), step):
                group = rows[i : i + step]
                for row, ids in zip(group, self._advance([words[r] for r in group], length)):
                    out[row] = ids
        return out

    def _advance(self, words: list[str], length: int):
        import numpy as np

        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)
        prefix = np.zeros((length + 1, len(words)), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * np.uint64(BASE) + codes[:, i] + np.uint64(1)
        bpe = self.model.kind == BPE
        last = np.full((length + 1, len(words)), -1, np.int64)
        taken = np.zeros((length + 1, len(words)), np.int16)
        value = np.full((length + 1, len(words)), -np.inf)
        value[0] = 0
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                start = end - size
                at, found = self.probe(prefix[end] - prefix[start] * self.power[size])
                fit = (self.size[found] == size) & np.isfinite(value[start, at])
                at, found = at[fit], found[fit]
                if size == 1:
                    piece = np.full(len(words), self.none)
                    piece[at] = found
                    at = np.flatnonzero(np.isfinite(value[start]))
                    found = piece[at]
                if not len(at):
                    continue
                if bpe:
                    gain = np.zeros(len(at))
                    if start:
                        gain[~self.compatible(last[start, at], found)] = -np.inf
                else:
                    gain = value[start, at] + self.score[found]
                better = gain > value[end, at]
                at = at[better]
                value[end, at], last[end, at], taken[end, at] = gain[better], found[better], size
        ends = np.full(len(words), length)
        rows = np.arange(len(words))
        steps = []
        while (ends > 0).any():
            steps.append(np.where(ends > 0, last[ends, rows], -1))
            ends = ends - taken[ends, rows]
        chain = np.array(steps[::-1], np.int32).T
        real = chain >= 0
        data = chain[real].astype("<i4").tobytes()
        ends = np.cumsum(real.sum(axis=1)) * 4
        found = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for row in np.flatnonzero((chain == self.none).any(axis=1)):
            found[row] = self._spelled(words[row], chain[row][real[row]]).astype("<i4").tobytes()
        return found

    def _spelled(self, word: str, ids):
        """Characters without a piece as bytes, or as the unknown piece."""
        import numpy as np

        out, at = [], 0
        for i in ids.tolist():
            size = int(self.size[i])
            if i != self.none:
                out.append(i)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.model.unknown:
                out.append(self.model.unknown)  # neighbouring unknowns are one
            at += size
        return np.array(out, np.int32)


def _encode(batches, encoder: Encoder, check: bool = False):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    model = encoder.model
    apart = re.escape(model.separators())
    tails = re.escape(model.tails())
    ways = [f"{SPACE_MARK}*[^{SPACE_MARK}{apart}{tails}]*[{LETTERS}](?=[{tails}])"] if tails else []
    ways += [f"{SPACE_MARK}*[^{SPACE_MARK}{apart}]+", f"{SPACE_MARK}+"] + ([f"[{apart}]"] if apart else [])
    split = re.compile("|".join(ways)).findall if model.by_words() else lambda s: [s]
    prefix = SPACE_MARK if model.dummy_prefix else ""
    cache: dict[str, bytes] = {}
    read = _reader(model) if check else None

    def encoded(texts: list[str | None]):
        parts = [split(prefix + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        new = set().union(*parts).difference(cache)
        if len(cache) + len(new) > HELD_WORDS:
            cache.clear()
            new = set().union(*parts)
        fresh = list(new)
        cache.update(zip(fresh, encoder.solve(fresh)))
        return [b"".join(map(cache.__getitem__, words)) for words in parts]

    for batch in batches:
        at = batch.schema.names.index("_text")
        names = [n for n in batch.schema.names if n != "_text"]
        size = np.asarray(pc.binary_length(batch.column(at)).fill_null(0))
        cuts = np.searchsorted(np.cumsum(size), np.arange(1, 1 + size.sum() // SLICE) * SLICE) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            if lo >= hi:
                continue
            part = batch.slice(lo, hi - lo)
            out = encoded(part.column(at).to_pylist())
            sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))
            columns, made = [*(part.column(n) for n in names), ids], [*names, "_ids"]
            if check:
                back = read(ids)
                same = [got == (t or "").replace(SPACE_MARK, " ") for got, t in zip(back, part.column(at).to_pylist())]
                columns, made = [*columns, pa.array(same, pa.bool_())], [*made, "_same"]
            yield pa.RecordBatch.from_arrays(columns, made)


def _reader(model: Model):
    """A function from a column of id lists to texts."""
    import numpy as np
    import pyarrow.compute as pc

    mark = SPACE_MARK.encode()
    spelled = []
    for piece, kind in zip(model.pieces, model.types):
        if kind == _BYTE:
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif kind == _UNKNOWN:
            spelled.append(" ⁇ ".encode())
        else:
            spelled.append(b"" if kind == _CONTROL else piece.encode().replace(mark, b" "))

    def read(ids) -> list[str | None]:
        values = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
        texts, begin = [], 0
        for end, known in zip(ends.tolist(), ids.is_valid().to_pylist()):
            data = b"".join(map(spelled.__getitem__, values[begin:end].tolist()))
            begin = end
            if model.dummy_prefix and data[:1] == b" ":
                data = data[1:]
            texts.append(data.decode("utf-8", "replace") if known else None)
        return texts

    return read


def _decode(batches, model: Model):
    import pyarrow as pa

    read = _reader(model)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "_ids"]
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = pa.array(read(part.column("_ids")), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), texts], [*names, "_text"])


def _mapped(rows: DataFrame, column: str, inside: str, step, made: dict[str, str]) -> DataFrame:
    """``rows`` with columns made from one of them by a function over Arrow batches."""
    results = {kind.split()[0]: name for name, kind in made.items()}
    others = {n: f"_c{i}" for i, n in enumerate(rows.columns) if n not in made}
    plain = rows.select(*(F.col(f"`{n}`").alias(a) for n, a in others.items()), F.col(f"`{column}`").alias(inside))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != inside]
    done = plain.mapInArrow(step, ", ".join([*kinds, *made.values()]))
    return done.select(*(F.col(a).alias(n) for n, a in others.items()), *(F.col(i).alias(n) for i, n in results.items()))


def encode(rows: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """All rows and columns, and the ids of each text; null and empty texts have none.

    With ``check_col`` the ids are decoded again in place, and the column says whether that
    gives the text (the empty one for null). Columns named like results are replaced. A
    space mark in a text is the same as a space.
    """
    encoder = Encoder(model)
    made = {ids_col: "_ids array<int>"} | ({check_col: "_same boolean"} if check_col else {})
    return _mapped(rows, text_col, "_text", lambda b: _encode(b, encoder, bool(check_col)), made)


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows and columns, and the text of each list of ids; null ids give null."""
    return _mapped(rows, ids_col, "_ids", lambda b: _decode(b, model), {text_col: "_text string"})
