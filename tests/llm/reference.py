"""Brute-force versions of the operators, in plain Python over whole small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = "\x20\t\n\x0b\x0c\r"


class Sets:
    """Union-find over any hashable; the smallest member names a class."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def _bucket(word, buckets):
    h = xxhash.xxh64_intdigest(word.encode("utf-8"), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def ratio_scores(docs, trusted, buckets):
    """Mean log ratio of each text; docs: list of (doc_id, text)."""
    raw, good = np.zeros(buckets), np.zeros(buckets)
    found = []
    for i, t in docs:
        b = np.array([_bucket(w, buckets) for w in words(t)], int)
        c = np.bincount(b, minlength=buckets)
        raw += c
        good += c * (i in trusted)
        found.append(b)
    if not good.sum():
        return [0.0] * len(docs)
    p = (raw + 1) / (raw.sum() + buckets)
    r = np.log((good / p + good.sum()) / (2 * good.sum()))
    return [float(r[b].mean()) if len(b) else 0.0 for b in found]


def ratio_threshold(scores, labels, rule):
    """The derived threshold from ``{doc_id: score}`` of documents past the base rules and all label rows."""
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    bad = {r.doc_id for r in labels if r.quality == 0}
    kinds = []
    for one, other, share in ((bad, good, 0.99), (good, bad, 0.01)):
        steps = sorted(int(np.floor(scores[i] * rule.STEPS)) for i in one - other if i in scores)
        if not steps:
            return rule.MIN_SCORE
        kinds.append(next(s for k, s in enumerate(steps, 1) if k >= share * len(steps)) / rule.STEPS)
    return kinds[0] + rule.MARGIN * (kinds[1] - kinds[0])


def character_shingles(line):
    s = " ".join(words(line))
    return {s[i:i + 5] for i in range(max(1, len(s) - 4))}


def dropped_lines(docs, threshold=0.8, shingles=character_shingles):
    """doc_id to the list of (line_no, class_doc, class_line) it loses."""
    first, places = {}, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(SPACE):
                places.append((i, n, line))
                first.setdefault(line, (i, n))
    sets, holders, classes = {}, defaultdict(list), Sets()
    for line in first:
        sets[line] = shingles(line)
        shared = Counter(o for g in sets[line] for o in holders[g])
        for o, k in shared.items():
            if k >= threshold * (len(sets[line]) + len(sets[o]) - k):
                classes.join(first[line], first[o])
        for g in sets[line]:
            holders[g].append(line)
    out = {i: [] for i, _ in docs}
    for i, n, line in places:
        kept = classes.find(first[line])
        if kept != (i, n) and (n, *kept) not in out[i]:
            out[i].append((n, *kept))
    return out


def fingerprint(text):
    w = [x for x in re.split(f"[{SPACE}]+".encode(), (text or "").encode().lower()) if x]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_classes(docs, bits=2):
    """doc_id to the smallest doc_id reachable over fingerprints within ``bits``."""
    ids = [i for i, _ in docs]
    fp = np.array([fingerprint(t) for _, t in docs], np.uint64)
    classes = Sets()
    for i in ids:
        classes.find(i)
    for a in range(len(fp)):
        near = np.bitwise_count(fp[a] ^ fp[a + 1:]) <= bits
        for b in np.flatnonzero(near) + a + 1:
            classes.join(ids[a], ids[b])
    return {i: classes.find(i) for i in ids}


def leak_words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def passage_edits(item, text):
    """Smallest edit distance in words between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def leaks(docs, items, share=0.2):
    """Pairs (doc_id, item_id) of items found in texts; texts without a common word pair with an
    item cannot hold it within the share and are passed over."""
    found = set()
    split = {j: leak_words(x) for j, x in items}
    for i, t in docs:
        w = leak_words(t)
        pairs = set(zip(w, w[1:]))
        for j, x in split.items():
            if x and len(pairs & set(zip(x, x[1:]))) >= max(1, (len(x) - 1) - 2 * int(share * len(x))) // 2:
                if passage_edits(x, w) <= int(share * len(x)):
                    found.add((i, j))
    return found
