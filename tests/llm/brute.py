"""Plain Python versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def windows(seqs, k):
    times = Counter(tuple(s[i : i + k]) if not isinstance(s, bytes) else s[i : i + k] for s in seqs for i in range(len(s) - k + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        end = 0
        for i in range(len(s) - k + 1):
            if times[s[i : i + k] if isinstance(s, bytes) else tuple(s[i : i + k])] > 1:
                for j in range(max(i, end), i + k):
                    gone[j] = True
                end = i + k
        out.append(gone)
    return out


def passages(rows, k):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), t, gone in zip(rows, texts, windows(texts, k)):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def word_windows(rows, k):
    texts = [WORD.findall(t or "") for _, t in rows]
    return [(d, len(t), sum(gone), sha(" ".join(w for w, g in zip(t, gone) if not g).encode())) for (d, _), t, gone in zip(rows, texts, windows(texts, k))]


def shingles(t, k=5):
    w = WORD.findall((t or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    for k, s in enumerate(sets):
        for o, n in Counter(o for x in s for o in at[x] if o < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                root[find(k)] = find(o)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), d), d)
    return [(d, len(s), low[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(FOLD)].append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, once = max(known) if known else None, False
        for d in ids:
            out.append((d, keep, len(ids), d == keep and not once, sha(t.encode())))
            once |= d == keep
    return out
