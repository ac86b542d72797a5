"""Plain single-machine versions of the operators' results."""

import hashlib
import re

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = LETTERS.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, found = LETTERS.findall(lower(t)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), tuple(sorted(found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def substrings(docs):
    most = 1 << 62
    words = [SPACE.findall(t or "") for _, t in docs]
    key = [most if d is None else d for d, _ in docs]
    first = {}
    for k, w in zip(key, words):
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            first[x] = min(first.get(x, k), k)
    out = []
    for (d, _), k, w in zip(docs, key, words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprint(text):
    w = SPACE.findall(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, names):
    """The least name (None last) reachable by links of 4 bits or fewer."""
    parent, x = list(range(len(prints))), np.array(prints, np.uint64)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4).tolist():
            parent[root(j)] = root(i)
    least = {}
    for i, n in enumerate(names):
        if n is not None:
            least[root(i)] = min(least.get(root(i), n), n)
    return [least.get(root(i)) for i in range(len(prints))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def line_dedup(docs, min_sites):
    """docs: (id, text, site); the text that stays, and the number of removed lines."""
    sites, first = {}, {}
    for d, t, s in docs:
        for p, line in enumerate(t.split("\n") if t is not None else ()):
            if line.strip(" \t\n\r\x0b\x0c"):
                sites.setdefault(line, set()).update([s] if s is not None else [])
                first[line] = min(first.get(line, (True, 0, 0)), (d is None, d or 0, p))
    out = []
    for d, t, _ in docs:
        if t is None:
            out.append((d, None, 0))
            continue
        kept = [x for p, x in enumerate(t.split("\n")) if len(sites.get(x, ())) < min_sites or first[x] == (d is None, d or 0, p)]
        out.append((d, "\n".join(kept), t.count("\n") + 1 - len(kept)))
    return out
