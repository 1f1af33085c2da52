"""Plain versions of the operators, on whole small tables in memory."""

import hashlib
import re

import numpy as np
import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text):
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(fps, most=3):
    x = np.array(fps, np.uint64)
    return [(i, int(j) + i + 1) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= most)]


def repeats(rows, length=20):
    """doc_id -> (words, removed, digest of the kept ones); rows are (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    seen, words, gone = {}, {}, {}
    for d, t in rows:
        w = words[d] = BLANK.findall(t or "")
        g = gone[d] = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i : i + length]), (d, i)) != (d, i):
                g[i : i + length] = [True] * length
    return {d: (len(w), sum(gone[d]), hashlib.sha256(" ".join(x for x, y in zip(w, gone[d], strict=True) if not y).encode()).hexdigest()) for d, w in words.items()}


def plain_words(text):
    text = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower())
    return text.encode().split()


def contained(rows, items, threshold=0.8, width=5):
    out = set()
    for d, t in rows:
        w = plain_words(t)
        sets = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in range(1, width + 1)}
        for item, text in items:
            v = plain_words(text)
            k = min(width, len(v))
            own = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            if own and len(own & sets[k]) >= threshold * len(own) - 1e-9:
                out.add((d, item, len(own), len(own & sets[k])))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text, phrases):
    words = LICENSE_WORD.findall(lower(text))
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_share(text, must, notice, threshold=0.8, slack=1.5):
    """The largest share of a notice's words in a block of at most slack times its length, if it meets the threshold."""
    words, own, need = LICENSE_WORD.findall(lower(text)), set(notice.split()), set(must.split())
    span = int(np.ceil(slack * len(notice.split()) - 1e-9))
    blocks = (set(words[i : i + span]) for i in range(len(words)))
    best = max((len(own & b) / len(own) for b in blocks if need <= b), default=0)
    return best if best >= threshold - 1e-9 else 0.0


def secrets(text, kinds):
    out, counts = [], []
    for rank, (kind, pattern, least, group) in enumerate(kinds):
        found = [m for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
        counts.append(len(found))
        out += [(m.start(), rank, kind, m.end()) for m in found]
    return *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out)).encode()).hexdigest()


def owned(rows, owners=2, repos=4):
    """Value -> live-looking; rows are (value, owner, repository)."""
    seen = {}
    for v, o, r in rows:
        seen.setdefault(v, (set(), set()))[0].add(o)
        seen[v][1].add((o, r))
    return {v: len(o) <= owners and len(r) <= repos for v, (o, r) in seen.items()}


def longest(rows, length=20):
    """doc_id -> the greatest of length, twice length .. of which a window starts earlier too."""
    rows, out = sorted(rows), {}
    words = {d: BLANK.findall(t or "") for d, t in rows}
    while True:
        seen, found = {}, False
        for d, _ in rows:
            for i in range(len(words[d]) - length + 1):
                if seen.setdefault(tuple(words[d][i : i + length]), (d, i)) < (d, i):
                    out[d], found = length, True
        if not found:
            return {d: out.get(d, 0) for d in words}
        length *= 2


def walked(trees, row):
    """Probability by going down each tree node by node."""
    total = trees.base
    for root in trees.roots:
        node = int(root)
        while trees.left[node] != node:
            node = int(trees.left[node]) + int(row[trees.feature[node]] > trees.threshold[node])
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def subsequences(word, letters=4, places=6, decay=0.6):
    """Weight of each common pattern of so many letters of a word with its ends marked, by its first letter's place fixed."""
    word, out = "\x02" + word + "\x03", {}
    from itertools import combinations

    for i in range(len(word)):
        for rest in combinations(range(1, places), letters - 1):
            if i + rest[-1] < len(word):
                s = word[i] + "".join(word[i + r] for r in rest)
                out.setdefault(s, []).append(decay ** (rest[-1] - letters + 1))
    return out


def kernel(a, b):
    """The subsequence kernel of two words, normalised by the root of the summed squares of single occurrences."""
    x, y = subsequences(a), subsequences(b)
    norm = lambda z: sum(w * w for v in z.values() for w in v) ** 0.5
    return sum(sum(x[s]) * sum(y[s]) for s in x.keys() & y.keys()) / (norm(x) * norm(y))
