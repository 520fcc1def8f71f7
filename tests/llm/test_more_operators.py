"""Operators 11 to 13 against brute force, with odd rows; rows of one id with unlike contents in operators 4, 7 and 8."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import exact_combining, fm_index, radix_suffixes, sorted_projections, turn_alignment, zone_maps

from .conftest import CLASHING, frame

CLASH = [x.split()[0] for x in CLASHING.split(", ")]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# 11: clusters


def lloyd(rows, clusters=40, rounds=5):
    """[(vec_id, embedding)] -> [(vec_id, cluster, distance, cluster_inertia, inertia, centroid)] in whole numbers."""
    fine = lambda e: e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in e)
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if fine(e)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [r[1] for r in sorted((r for r in v if r[0] is not None), key=key)[:clusters]]
    near = lambda e: min((sum((x - y) ** 2 for x, y in zip(e, z)), k) for k, z in enumerate(c))
    if not c:
        return []
    for _ in range(rounds):
        own = [near(e)[1] for _, e in v]
        for k in set(own):
            mine = [e for (_, e), o in zip(v, own) if o == k]
            c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(e)) for i, e in v]
    total = sum(d for _, d, _ in got)
    return [(i, k, d, sum(y for _, y, z in got if z == k), total, ",".join(map(str, c[k]))) for i, d, k in got]


def vectors(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))


def test_clusters_like_lloyd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(64) * (0.1 if i % 3 else 4)).tolist(), 0) for i in range(150)]
    rows += [(200 + i, rows[5][1], 0) for i in range(60)]  # equal vectors, over more than a block
    rows += [(5, rows[5][1], 0), (6, rows[9][1], 0), (None, rows[7][1], 0)]  # repeated and missing ids
    rows += [(300, None, 0), (301, [], 0), (302, [1.0] * 63, 0), (303, [1.0] * 63 + [None], 0), (304, [math.nan] * 64, 0), (305, [math.inf] + [0.0] * 63, 0), (306, [1e30] * 64, 0), (307, [0.0] * 64, 0), (308, [5e5] * 64, 0), (309, [-5e5] * 64, 0)]
    df = vectors(spark, rows)
    got = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], ",".join(map(str, r["centroid"]))) for r in zone_maps.cluster(df, block=16).collect()]
    want = lloyd([r[:2] for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    digests = {r["vec_id"]: r["centroid_sha256"] for r in zone_maps.report(df).collect()}
    assert digests == {w[0]: hashlib.sha256(w[5].encode()).hexdigest() for w in want}
    few = vectors(spark, rows[:7])
    assert {r["cluster"] for r in zone_maps.cluster(few).collect()} == set(range(7))
    for none in (rows[:0], [(300, None, 0)], [(None, rows[0][1], 0)]):
        assert zone_maps.cluster(vectors(spark, none)).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [bytes(k) for k in zone_maps.hilbert(cells, bits)]
        along = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(keys)
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_boxes_lose_no_centroid():
    rng = np.random.default_rng(8)
    for _ in range(200):
        v, c = rng.integers(-40, 40, (9, 3)), rng.integers(-40, 40, (12, 3))
        c[7] = c[3]  # a tie
        near = zone_maps.candidates(v.min(0), v.max(0), c)
        d = ((v[:, None] - c) ** 2).sum(2)
        at, best = zone_maps.nearest(v, c[near])
        assert (near[at] == d.argmin(1)).all() and (best == d.min(1)).all()
    big = np.array([[(1 << 27) - 1] * 64, [-(1 << 27)] * 64])
    assert zone_maps.nearest(big, big[::-1])[0].tolist() == [1, 0] and zone_maps.nearest(big[:1], big[1:])[1][0] == 64 * ((1 << 28) - 1) ** 2


# 12: conversations


def cheapest(initials, faults):
    """Least (cost, audit) by search over (rows used, state); independent of tables and bands."""
    best, heap, n = {}, [(0, "", 0, "n")], len(initials)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = cost, audit
        if i == n and state in "na":
            return cost, audit
        want = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, want))
        if i < n:
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if faults[i] != "x":
                more = faults[i] == "t"
                heapq.heappush(heap, (cost + more + (0 if initials[i] == want else 2), audit + ("K" if initials[i] == want else "R"), i + 1, want))
                if state == "n" and initials[i] == "s":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s"))


def test_alignment_is_cheapest_and_least():
    for n in range(6):
        for initials in itertools.product("sua-", repeat=n):
            for faults in itertools.product("x.t", repeat=n) if n < 4 else [[random.Random(hash((n, initials))).choice("x.t") for _ in range(n)]]:
                one, two = "".join(initials), "".join(faults)
                assert turn_alignment._Table(one, two).solve() == cheapest(one, two), (one, two)
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(5, 40)
        one, two = "".join(rng.choice("uaua" if rng.random() < 0.8 else "s-") for _ in range(n)), "".join(rng.choice("x....t") for _ in range(n))
        assert turn_alignment.align(one, two) == cheapest(one, two), (one, two)


def test_alignment_in_stretches(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(turn_alignment, "STRETCH", 4)
    for _ in range(60):
        n = rng.randint(1, 80)
        one, two = "".join(rng.choice("uauas") for _ in range(n)), "".join(rng.choice("x...t") for _ in range(n))
        assert turn_alignment._Table(one, two).solve() == cheapest(one, two), (one, two)


def test_long_conversation_in_bounded_time():
    rng = random.Random(6)
    one = "s" + "".join(rng.choice("ua") if rng.random() < 0.1 else "ua"[k % 2] for k in range(12000))
    began = time.perf_counter()
    cost, audit = turn_alignment.align(one, "." * len(one))
    assert time.perf_counter() - began < 60 and len(audit) >= len(one) and cost == 2 * sum(c in "IR" for c in audit) + 3 * audit.count("D")


def repaired(rows):
    """[(conv_id, turn, role, text)] -> {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}."""
    out, blanks = {}, " \t\n\x0b\x0c\r"
    one = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = ["blank" if not t.strip(blanks) else "duplicate" if (r, t) in [x[1:] for x in mine[:k]] else "truncated" if t.rstrip(blanks)[-1] not in ".!?" else "" for k, (_, r, t) in enumerate(mine)]
        heads = [r[:1] for _, r, _ in mine]
        cost, audit = cheapest("".join(h or "-" for h in heads), "".join({"blank": "x", "duplicate": "x", "truncated": "t", "": "."}[f] for f in faults))
        lines, left = [], list(mine)
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (0, "", "")
            if edit != "D":
                want = {"u": "assistant"}.get(lines[-1][:1] if lines else "", "user")
                lines.append(f"{role if edit == 'K' else want}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))


def test_conversations_with_odd_rows(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Fine.", "Well", "é!", " \n", "", None, "Why? ", "x" * 3000, "日本。", "end.\x85"]
    rows = [(c, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (99, None, "user", "A."), (99, None, "user", "A."), (98, 2**62, "user", "B."), (98, -(2**61), "user", "B.")]
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone."), (97, 5, "system", "Only."), *((96, k, "user", "Same.") for k in range(30))]
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_alignment.report(conversations(spark, rows)).collect()}
    assert got == repaired(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_alignment.report(conversations(spark, rows[:0])).count() == 0


def test_repair_gives_conversations_that_fit(spark):
    rng = random.Random(10)
    rows = [(c, k, rng.choice(["user", "assistant", "system"]), f"Text {rng.randint(0, 3)}.") for c in range(40) for k in range(rng.randint(0, 9))]
    for r in turn_alignment.repair(conversations(spark, rows)).collect():
        heads = "".join(x["role"][0] for x in r["repaired"])
        assert turn_alignment.align(heads, "." * len(heads))[0] == 0


# 13: exact copies


def kept_rows(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i, k))
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, best[2], len(g), k == best[3], hashlib.sha256(norm.encode()).hexdigest()) for _, _, i, k in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, table, weak):
    rows = table + [(1000 + k, " a b ") for k in range(40)] + [(2000, " a  b "), (1999, "a  b  "), (2001, " a b"), (2002, "a\x1cb"), (2003, "AB"), (2004, "é"), (2005, "é")]
    rows += [(7, "a b"), (7, "ab"), (7, "ab"), (None, "ab"), (None, "a" + " " * 20 + "b"), (None, None), (5, "only by id"), (5, "only by id"), (-(2**63), "x"), (2**63 - 1, "x")]
    digest = (lambda sha: F.substring(sha, 1, 0)) if weak else (lambda sha: sha)
    got = exact_combining.deduplicate(frame(spark, rows), digest).collect()
    assert sorted((tuple(r) for r in got), key=str) == kept_rows(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_combining.deduplicate(frame(spark, []), digest).count() == 0


def test_exact_copies_of_some_digests_only(spark, table):
    """Digests of one byte: some are shared by unlike texts, others are not."""
    rows = table + [(1000 + k, f"text {k // 3}") for k in range(120)]
    got = exact_combining.deduplicate(frame(spark, rows), lambda sha: F.substring(sha, 1, 1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == kept_rows(rows)


def test_exact_copies_are_groups_on_either_side(spark, monkeypatch, table):
    monkeypatch.setattr(exact_combining, "SHARE", 20)
    rows = table + [(1000 + k, f"text {k // 3 if k > 60 else 0}") for k in range(120)]
    assert sorted((tuple(r) for r in exact_combining.deduplicate(frame(spark, rows)).collect()), key=str) == kept_rows(rows)


# rows of one id


def test_unlike_texts_of_one_id(spark):
    rng = random.Random(2)
    some = lambda n: " ".join("".join(rng.choice("abdeginorst") for _ in range(5)) for _ in range(n))
    a, b, shared = some(240), some(240), some(100)
    bytes_of = lambda rows: {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in radix_suffixes.remove_repeats(frame(spark, rows)).collect()}
    words_of = lambda rows: {(r["doc_id"], r["n_words"]): r["n_removed"] for r in fm_index.remove_repeats(frame(spark, rows)).collect()}
    rows = [(1, a), (1, b + " x"), (2, a + " tail")]
    assert bytes_of(rows) == {(1, len(a)): len(a), (1, len(b) + 2): 0, (2, len(a) + 5): len(a)}
    assert words_of(rows) == {(1, 240): 0, (1, 241): 0, (2, 241): 240}
    rows = [(1, f"{some(30)} {shared} {some(30)}"), (1, "short"), (1, None), (2, f"{shared} {some(20)}"), (None, shared)]
    got = radix_suffixes.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"] >= len(shared) and r["n_bytes"] > 400, r["n_bytes"] in (0, 5)) for r in got) == [(1, False, True), (1, False, True), (1, True, False), (2, True, False)]
    got = words_of(rows)
    assert got[1, 0] == got[1, 1] == got[1, 160] == 0 and got[2, 120] == 100
    # copies of a text under one id are one document, under two ids they are copies
    rows = [(1, a), (1, a), (3, b + " x"), (3, a)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in fm_index.remove_repeats(frame(spark, rows)).collect()) == [(1, 0), (1, 0), (3, 0), (3, 240)]


def test_unlike_vectors_of_one_id(spark):
    x, y = [1.0] * 8, [-1.0, 1.0] * 4
    rows = [(3, x), (1, x), (1, y), (2, [-1.1, 1.0] * 4), (4, None), (4, [2.0] * 8), (None, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in sorted_projections.near_duplicates(df, block=8).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 2, 1, False)]
