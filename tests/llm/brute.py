"""The operators' results by plain loops over small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def kept_after_repeats(texts, window):
    """For each text (words, kept words) when repeated windows go."""
    cut = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        left, until = [], 0
        for i, word in enumerate(w):
            if i + window <= len(w) and seen[tuple(w[i : i + window])] > 1:
                until = i + window
            if i >= until:
                left.append(word)
        out.append((w, left))
    return out


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(sets, percent):
    """Class of each set: the smallest position it is linked to."""
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]
