"""Plain versions of the operators for small tables: rows (doc_id, text), repeated or null ids too."""

import hashlib
import re

LAST = (1 << 63) - 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_spans(rows, window=50):
    """(doc_id, n_words, n_removed, kept text), window by window."""
    split = [(LAST if i is None else i, words(t)) for i, t in rows]
    first = {}
    for i, w in sorted(split, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for (i, w), (doc_id, _) in zip(split, rows, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingles(text, k=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_components(rows):
    """(doc_id, n_shingles, component_id) by an inverted index and counted overlaps."""
    sets = [shingles(t) for _, t in rows]
    index, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in index.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            index[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def copies(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, sha(t or "")))
    return out
