"""Plain versions of the operators, for small inputs."""

import collections
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def jaccard_components(rows, k, percent):
    """(id, set size, smallest id of the component) of each row."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            n = len(x & y)
            if n and 100 * n >= percent * (len(x) + len(y) - n):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def contamination(text, items, k):
    """(words, hit words, sorted items) of a text."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in [w] if 0 < len(w) < k else [w[j : j + k] for j in range(len(w) - k + 1)]:
            windows[tuple(s)].add(str(i))
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, got = [False] * len(w), set()
    for n in set(map(len, windows)):
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in windows:
                got |= windows[tuple(w[j : j + n])]
                hit[j : j + n] = [True] * n
    return len(w), sum(hit), sorted(got)


def repeated_windows(rows, k):
    """(id, words, removed, kept text) of rows in id order."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if key in seen:
                gone[j : j + k] = [True] * k
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_lines(rows, least):
    """(id, lines, removed, runs, kept text) of rows in id order: every run of at least `least` words that starts earlier goes."""
    seen, out = set(), []
    for i, t in sorted(rows):
        lines = [] if t is None else t.split("\n")
        gone = [False] * len(lines)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(SPACED.findall(x)) for x in lines[a:b]) >= least:
                    key = tuple(lines[a:b])
                    if key in seen:
                        gone[a:b] = [True] * (b - a)
                    seen.add(key)
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(lines), sum(gone), runs, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def secrets(text):
    """Base findings (kind, start, end)."""
    cased = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(cased, ("password", "passwd", "secret", "token"))) + "|" + cased("api") + "_?" + cased("key")
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def neighbours(vectors, query, k):
    """(id, distance) of the k nearest of {id: vector} to the query id."""
    q = vectors[query]
    return sorted((sum((a - b) ** 2 for a, b in zip(q, v)) ** 0.5, i) for i, v in vectors.items() if i != query)[:k]
