"""Operators written again in plain Python, for tests to compare with."""

import math
import re
from collections import Counter

import numpy as np
import xxhash

from eventledger.llm import rules, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def plain_kept(rows):
    """rows: (lang, text) -> verdicts, from shares counted in plain Python."""
    fold = lambda w: w.strip(".,;:!?\"'()[]").lower()

    def classes(text):
        counts = [0] * 8
        for c in text:
            if ord(c) > 127:
                counts[7] += 1
            else:
                kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\v\f\r" else None
                counts[kind if kind is not None else 4 if c in "#*$%&|<>" else 5 if 32 < ord(c) < 127 else 6] += 1
        return counts

    def divergence(p, q):
        h = lambda a, m: a * math.log2(a / m) if a else 0.0
        return sum(h(a, (a + b) / 2) + h(b, (a + b) / 2) for a, b in zip(p, q)) / 2

    words, chars = {}, {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(map(fold, WORD.findall(text or "")))
        chars[lang] = [a + b for a, b in zip(chars.get(lang, [0] * 8), classes(text or ""))]
    refs = {}
    for lang, counted in words.items():
        total = sum(counted.values())
        if total >= rules.MIN_REFERENCE:
            shares = {w: n / total for w, n in counted.items() if w and n >= rules.COMMON * total}
            refs[lang] = shares, [c / sum(chars[lang]) for c in chars[lang]]
    out = []
    for lang, text in rows:
        found = WORD.findall(text or "")
        kept, n = not plain_base(text)[-1], len(found)
        if n >= rules.MIN_WORDS and refs:
            options = []
            for shares, expected in [refs[lang]] if lang in refs else refs.values():
                own, counted = classes(text), Counter(map(fold, found))
                a = divergence([c / sum(own) for c in own], expected)
                bins = [counted[w] / n for w in shares]
                b = divergence([*bins, 1 - sum(bins)], [*shares.values(), 1 - sum(shares.values())])
                options.append((a + b, a, b, len(shares) + 1))
            _, a, b, size = min(options)
            kept &= a <= rules.CHAR_BOUND + rules.CHAR_NOISE / n and b <= rules.WORD_BOUND + rules.WORD_NOISE * size / n
        out.append(kept)
    return out


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    codes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def plain_components(rows, bits=4):
    """rows: (id, fingerprint); the smallest id that each row reaches."""
    ids = np.array([i for i, _ in rows])
    codes = np.array([c for _, c in rows], np.uint64)
    label = ids.copy()
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist()))
        label = new


def plain_passages(rows, window=20):
    """rows: (id, text); kept words of each row by the definition."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        key = substrings.NO_ID if i is None else i
        for p in range(len(words) - window + 1):
            passage = tuple(words[p : p + window])
            first[passage] = min(first.get(passage, (key, p)), (key, p))
    out = []
    for i, words in split:
        key = substrings.NO_ID if i is None else i
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (key, p):
                gone.update(range(p, p + window))
        out.append((i, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return sorted(out, key=str)
