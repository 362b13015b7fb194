"""Periodic runs in word sequences, by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q, as long as ``min_length`` and
``min_exponent`` times q at least, that no neighbouring word extends with the same period.

* Ukkonen's algorithm builds the suffix tree of a stretch and of its reversal. An Euler
  tour, of which the leaves and the depth of the node between neighbouring leaves are
  kept, gives the depth of any two leaves' lowest common ancestor as a range minimum,
  looked up in two overlapping windows: longest common extensions in constant time, for
  whole arrays of places.
* Every run holds a Lyndon root that is the longest Lyndon word from its place, for the
  words' order or for the reversed one. The tour in each order ranks the suffixes, the
  longest Lyndon word at a place ends where the next smaller suffix begins, and each such
  root is extended to both sides.

Trees are built only where a run can be. A run with exponent e > 2 and length L holds
each of its phrases of ``L (e - 2) / e`` words twice, so words that no repeated phrase
covers cannot belong to one. Phrases are told apart by hashes; two that share a hash
only leave a stretch in that holds no run.

Work and memory of a document are bounded by its own words: about 0.5 kB for each word
of the longest stretch that repeats itself. Null and empty texts have no words and no runs;
repeated rows and rows without an id are each treated by themselves, in no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 24
MIN_EXPONENT = 3
BATCH_WORDS = 1_000_000

RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) + 1
        return code


class SuffixTree:
    """Suffix tree of a sequence of whole numbers from 1 on; 0 ends it."""

    def __init__(self, codes: list[int]):
        self.size = len(codes)
        self._grow([*codes, 0])

    def _grow(self, text: list[int]) -> None:
        """Ukkonen's algorithm. Edges are kept in one table, by node and first number."""
        n, width = len(text), max(text) + 1
        child: dict[int, int] = {}
        start, end, link, leaf = [0], [0], [0], [-1]
        node = edge = length = due = leaves = 0
        for at, code in enumerate(text):
            due += 1
            unlinked = 0
            while due:
                if not length:
                    edge = at
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(at), end.append(n), link.append(0), leaf.append(leaves)
                    leaves += 1
                    link[unlinked] = node
                    unlinked = 0
                else:
                    span = end[below] - start[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    middle = start[below] + length
                    if text[middle] == code:
                        length += 1
                        link[unlinked] = node
                        break
                    split = child[key] = len(start)
                    start.append(start[below]), end.append(middle), link.append(0), leaf.append(-1)
                    child[split * width + code] = split + 1
                    start.append(at), end.append(n), link.append(0), leaf.append(leaves)
                    leaves += 1
                    start[below] = middle
                    child[split * width + text[middle]] = below
                    link[unlinked] = split
                    unlinked = split
                link[0] = 0  # the root has none; it stands for no node waiting above
                due -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - due + 1
            link[0] = 0
        self._edges(child, width)
        self._span = [b - a for a, b in zip(start, end)]
        self._leaf = leaf

    def _edges(self, child: dict[int, int], width: int) -> None:
        """Children of each node in ascending order of their first number."""
        import numpy as np

        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        child.clear()
        order = np.argsort(keys)
        parents = keys[order] // width
        self._children = nodes[order].tolist()
        count = len(nodes) + 1
        self._first = np.searchsorted(parents, np.arange(count)).tolist()
        self._last = np.searchsorted(parents, np.arange(count), side="right").tolist()
        # Only the root and inner nodes have an edge that begins with the end mark.
        self._ends = (keys[order] % width == 0).tolist()

    def tour(self, descending: bool = False):
        """Leaves in the tour's order, and the depth at which it turns before each leaf.

        ``descending`` reverses the order of numbers; the end stays smallest.
        """
        children, first, last, ends, span, leaf = self._children, self._first, self._last, self._ends, self._span, self._leaf
        leaves, turns = [], []
        stack, turn = [(0, 0, -1)], 0
        while stack:
            node, depth, above = stack.pop()
            if above >= 0:
                turn = above
            depth += span[node]
            if leaf[node] >= 0:
                leaves.append(leaf[node])
                turns.append(turn)
                continue
            a, b = first[node], last[node]
            below = children[a:b]
            if descending:
                mark = int(ends[a])
                below = below[:mark] + below[mark:][::-1]
            for other in below[:0:-1]:
                stack.append((other, depth, depth))
            stack.append((below[0], depth, -1))
        return leaves, turns


class Extensions:
    """Longest common extensions of two places of a sequence."""

    def __init__(self, tree: SuffixTree):
        import numpy as np

        leaves, turns = tree.tour()
        self.size = tree.size
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        table = [np.array(turns, np.int32)]
        while 2 << len(table) - 1 < len(leaves):
            step, prev = 1 << len(table) - 1, table[-1]
            row = prev.copy()
            row[: len(prev) - step] = np.minimum(prev[: len(prev) - step], prev[step:])
            table.append(row)
        self._least = np.stack(table)
        self._log = np.frexp(np.arange(len(leaves) + 1))[1] - 1

    def at(self, i, j):
        """Common length from different places ``i`` and ``j`` on; the end is a place too."""
        import numpy as np

        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = self._log[b - a]
        return np.minimum(self._least[level, a], self._least[level, b - (1 << level)]).astype(np.int64)


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one whose suffix is smaller."""
    n = len(rank) - 1  # the last suffix is the empty one, the smallest
    following = [0] * n + [n]
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = following[j]
        following[i] = j
    return following[:n]


def runs_of(codes, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
    """Runs of a sequence of numbers, an array of (start, length, period) by start, then period."""
    import numpy as np

    n = len(codes)
    if n < max(min_length, 2):
        return np.zeros((0, 3), np.int64)
    dense = np.unique(codes, return_inverse=True)[1].ravel() + 1
    tree = SuffixTree(dense.tolist())
    forward = Extensions(tree)
    other = np.empty(n + 1, np.int64)
    other[tree.tour(descending=True)[0]] = np.arange(n + 1)
    del tree
    found = []
    backward = Extensions(SuffixTree(dense[::-1].tolist()))
    for rank in (forward.rank, other):
        i = np.arange(n)
        j = np.array(_next_smaller(rank.tolist()), np.int64)
        period = j - i
        left = backward.at(n - i, n - j)
        start = i - left
        length = j + forward.at(i, j) - start
        keep = (length >= min_exponent * period) & (length >= min_length)
        found.append(np.stack([start[keep], length[keep], period[keep]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _phrase_hashes(codes, size: int):
    """Hashes of the ``size`` numbers from each place on."""
    import numpy as np

    out = np.zeros(len(codes) - size + 1, np.uint64)
    for step in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[step : step + len(out)]
    return out ^ (out >> np.uint64(29))


def _stretches(codes, of, size: int, min_length: int):
    """Stretches ``[first, last)`` in which every phrase of ``size`` numbers occurs twice.

    ``of`` numbers the document of each place. Stretches that fall apart are looked at again
    by themselves.
    """
    import numpy as np

    from eventledger.llm.common import mix

    if len(codes) < size:
        return []
    phrases = _phrase_hashes(codes, size)
    places = np.flatnonzero(of[: len(phrases)] == of[size - 1 :])
    group = of[places].astype(np.uint64)
    while len(places):
        keys = phrases[places] + mix(group + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(places), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        whole, places, group = twice.all(), places[twice], group[twice]
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] != places[:-1] + 1) | (group[1:] != group[:-1])
        group = np.cumsum(new).astype(np.uint64)
        sizes = np.bincount(group.astype(np.int64))[group.astype(np.int64)] if len(group) else group
        long = sizes + size - 1 >= min_length
        places, group = places[long], group[long]
        if whole and long.all():
            break
    if not len(places):
        return []
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[at[1:], len(places)] - 1
    return list(zip(places[at].tolist(), (places[ends] + size).tolist()))


def _find(batches, min_length: int, min_exponent: int, extra: list[str]):
    """Rows with a text to rows with their runs; the first columns pass through."""
    import numpy as np
    import pyarrow as pa

    phrase = min_length * (min_exponent - 2) // min_exponent
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def results(docs):
        codes = _Codes()
        numbers = np.fromiter((codes[w] for words in docs for w in words), np.uint64)
        sizes = np.array([len(words) for words in docs], np.int64)
        begins = np.cumsum(sizes) - sizes
        if phrase > 0:
            spans = _stretches(numbers, np.repeat(np.arange(len(docs)), sizes), phrase, min_length)
        else:
            spans = list(zip(begins.tolist(), (begins + sizes).tolist()))
        runs: dict[int, list] = {}
        for first, last in spans:
            found = runs_of(numbers[first:last], min_length, min_exponent)
            if len(found):
                doc = int(np.searchsorted(begins, first, side="right")) - 1
                found[:, 0] += first - begins[doc]
                runs.setdefault(doc, []).append(found)
        for d, words in enumerate(docs):
            kept = words
            own = np.concatenate(runs[d]) if d in runs else np.zeros((0, 3), np.int64)
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            if len(own):
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 0] + own[:, 1], -1)
                kept = [w for w, g in zip(words, np.cumsum(gone)) if not g]
            yield len(words), [dict(zip(("start", "length", "period"), r)) for r in own.tolist()], b" ".join(kept).decode()

    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        at = 0
        while at < batch.num_rows:
            docs, held, first = [], 0, at
            while at < batch.num_rows and held < BATCH_WORDS:
                docs.append((texts[at].as_py() or "").encode().split())
                held += len(docs[-1])
                at += 1
            counts, runs, kept = zip(*results(docs))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(first, at - first) for c in range(batch.num_columns - 1)),
                    pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.string()),
                ],
                [*extra, "n_words", "runs", "collapsed"],
            )


def find_runs(
    documents: DataFrame,
    columns: list[str] | None = None,
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """``columns`` of each row, ``n_words``, its ``runs`` by start, then period, and
    ``collapsed``: its words without those that a run holds after its first period, joined
    by one space. One row for each input row; nothing is shuffled."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    columns = ["doc_id"] if columns is None else columns
    rows = documents.select(*columns, F.col(text_col).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) if columns else ""
    schema = f"{kept}, {RESULT}" if kept else RESULT
    return rows.mapInArrow(lambda batches: _find(batches, min_length, min_exponent, columns), schema)
