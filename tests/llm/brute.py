"""Brute-force versions of the operators, on lists of rows."""

import collections
import re

import numpy as np
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
INF = (1 << 63) - 1


def words(text):
    return re.findall(WORD, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def covered(n, starts, length):
    out = [False] * n
    for s in starts:
        out[s: s + length] = [True] * length
    return out


def runs(mask):
    return [(m.start(), m.end() - m.start()) for m in re.finditer("1+", "".join("01"[x] for x in mask))]


def substring(rows, k):
    all_words = [words(r["text"]) for r in rows]
    count = collections.Counter(tuple(w[i: i + k]) for w in all_words for i in range(len(w) - k + 1))
    for r, w in zip(rows, all_words):
        gone = covered(len(w), [i for i in range(len(w) - k + 1) if count[tuple(w[i: i + k])] > 1], k)
        yield r["doc_id"], len(w), sum(gone), runs(gone), " ".join(x for x, g in zip(w, gone) if not g)


def suffix(rows, k):
    least = {}
    for r in rows:
        b = (r["text"] or "").encode()
        d = INF if r["doc_id"] is None else r["doc_id"]
        for i in range(len(b) - k + 1):
            least[b[i: i + k]] = min(d, least.get(b[i: i + k], INF))
    for r in rows:
        b = (r["text"] or "").encode()
        d = INF if r["doc_id"] is None else r["doc_id"]
        gone = covered(len(b), [i for i in range(len(b) - k + 1) if least[b[i: i + k]] < d], k)
        yield r["doc_id"], len(b), sum(gone), runs(gone), bytes(x for x, g in zip(b, gone) if not g)


def lines(rows, k):
    order = sorted(range(len(rows)), key=lambda i: (INF if rows[i]["doc_id"] is None else rows[i]["doc_id"], xxhash.xxh64_intdigest((rows[i]["text"] or "").encode()) >> 1))
    seen, out = set(), {}
    for n in order:
        all_lines = (rows[n]["text"] or "").split("\n")
        own = [(i, " ".join(words(x))) for i, x in enumerate(all_lines) if words(x)]
        gone = set()
        for i in range(len(own) - k + 1):
            window = tuple(x for _, x in own[i: i + k])
            if window in seen:
                gone.update(j for j, _ in own[i: i + k])
            seen.add(window)
        out[n] = (rows[n]["doc_id"], len(own), len(gone), "\n".join(x for i, x in enumerate(all_lines) if i not in gone))
    return [out[n] for n in range(len(rows))]


def fingerprint(text, shingle=4):
    w = words(lower(text))
    parts = [" ".join(w[i: i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def classes(rows, distance=4, shingle=4):
    """(id, fingerprint, smallest id of the class), and the class number of each row."""
    marks = np.array([fingerprint(r["text"], shingle) for r in rows], np.uint64)
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(marks[i + 1:] ^ marks[i]) <= distance):
            group[top(i + 1 + int(j))] = top(i)
    number = [top(i) for i in range(len(rows))]
    least = {}
    for n, r in zip(number, rows):
        if r["doc_id"] is not None:
            least[n] = min(r["doc_id"], least.get(n, INF))
    return [(r["doc_id"], f"{int(m):016x}", least.get(n)) for r, m, n in zip(rows, marks, number)], number


def quality_counts(text):
    w = words(text)
    c = collections.Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    repeat = covered(len(w), [i for i in range(len(w) - 2) if c[tuple(w[i: i + 3])] > 1], 3)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * sum(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(repeat), failed


def license_base(text):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def edits_within(pattern, text):
    """Least edits between the pattern and any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)
