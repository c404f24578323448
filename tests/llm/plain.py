"""Plain Python forms that the operators are compared with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(links):
    """Smallest id that each linked id reaches."""
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}
