"""Plain single-process versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def union_find(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs, percent=85, size=5):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component)}"""
    sets = {}
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = union_find(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def decontaminate(docs, items, window=13):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = rx.findall(low(t))
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[s : s + k])].add(str(i))
    sizes = sorted({len(k) for k in wins})
    out = {}
    for d, t in docs:
        w = rx.findall(low(t))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeated_bytes(docs, length=400):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of the kept bytes)}"""
    seen = defaultdict(int)
    data = {i: (t or "").encode() for i, t in docs}
    for b in data.values():
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] += 1
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(docs, length=20):
    """{doc_id: (n_words, n_removed, sha of the kept words)}"""
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in sorted(docs)}
    for i, w in words.items():
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (i, p))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] != (i, p):
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_spans(text):
    """(counts by kind, joined spans)"""
    t, out = text or "", {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    out["ip"] = [m.span() for m in ips if all(int(x) <= 255 for x in m[0].split("."))]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    joined = ",".join(f"{k}:{s}:{e}" for k in ("email", "ip", "card", "phone") for s, e in out[k])
    return tuple(len(out[k]) for k in ("email", "ip", "card", "phone")), joined
