"""Plain Python forms that several tests compare with."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def plain_set(text, n=3):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def plain_groups(rows, n=3, least=90):
    sets = [plain_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= least * max(len(a), len(b)):
                inter = len(a & b)
                if 100 * inter >= least * (len(a) + len(b) - inter):
                    up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(ids[root(i)])) for i, (d, _) in enumerate(rows))
