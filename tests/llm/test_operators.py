"""The ten operators against brute force, round trips and held-out accuracy, with odd rows among the documents."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import benchmark_suffixes, crf_language, fm_index, nb_svm_quality, packing, radix_suffixes, repair, sanitise, sorted_projections, superminhash, window_passes
from attestra.llm.common import components, table
from attestra.llm.tokens import PieceEncoder, public_file

from . import brute
from .conftest import frame


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark, table):
    return frame(spark, table).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1: language


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return crf_language.train(table(spark, sf_dir, "documents"), 150)


def test_language_held_out(spark, sf_dir, field):
    d = table(spark, sf_dir, "documents")
    got = crf_language.identify(d, field).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(docs, empty, field, table):
    got = by_id(crf_language.identify(docs, field), "lang_pred", "score")
    assert len(got) == len(table)
    for i, t in table:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
    assert crf_language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in crf_language.identify(docs).collect()} == {"und"}  # no labels
    kept = crf_language.keep_identified(docs, 0.0, field)
    assert kept.columns == docs.columns and kept.count() == sum(v[0] != "und" for v in got.values())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    em, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    got = crf_language.posteriors(em, np.array([2, 7]), moves, chunk=3)
    for s, n in ((0, 2), (2, 7)):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            # the chain starts from any label with equal weight
            w = np.exp(sum(em[s + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) * np.exp(moves[:, path[0]]).sum()
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[s : s + n], want / want.sum(axis=1, keepdims=True))


def test_gradient_is_that_of_the_enumerated_likelihood(monkeypatch):
    monkeypatch.setattr(crf_language, "STRETCH", 4)
    rng = np.random.default_rng(5)
    rows = [([b"ab", b"cd", b"ab", b"ef", b"gh"], "x"), ([b"cd", b"gh"], "y"), ([b"ef"], "z"), ([b"ab", b"gh", b"gh"], "y")]
    data = crf_language.sequences(rows)
    assert data.sizes.tolist() == [4, 1, 2, 1, 3]
    k = 3
    field = crf_language.Field(data.languages, rng.normal(size=(1 << crf_language.TABLE_BITS, k)) * 0.2, rng.normal(size=(k, k)))

    def likelihood():
        em, out, at = field.emissions(data.vocabulary)[data.word], 0.0, 0
        for n, label in zip(data.sizes, data.label):
            score = lambda path: sum(em[at + i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])) + np.log(np.exp(field.moves[:, path[0]]).sum())  # noqa: E731, B023
            out += score([label] * n) - np.log(sum(np.exp(score(path)) for path in np.ndindex(*[k] * n)))
            at += n
        return out / len(data.word)

    weights, moves = data.gradient(field)
    for x, grad, places in ((field.moves, moves, np.ndindex(k, k)), (field.weights, weights, [(int(s), j) for s in data.slot[:5] for j in range(k)])):
        for place in places:
            kept = x[place]
            x[place] = kept + 1e-5
            up = likelihood()
            x[place] = kept - 1e-5
            down = likelihood()
            x[place] = kept
            assert abs((up - down) / 2e-5 - grad[place]) < 1e-6


def test_code_switched_text_has_runs(spark, field, sf_dir):
    d = {r["lang"]: r["text"] for r in table(spark, sf_dir, "documents").where("length(text) > 600").collect()}
    mixed = " ".join(d["en"].split()[:40] + d["de"].split()[:40])
    runs = crf_language.language_runs(frame(spark, [(1, mixed)], False), field).orderBy("word").collect()
    assert {"en", "de"} <= {r["lang"] for r in runs if r["n_words"] > 15}


# 2: quality


def test_quality_held_out(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = nb_svm_quality.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9


def test_quality_odd_rows(spark, docs, empty, table):
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(len(table))] + [(3, 0)], "doc_id long, quality int")
    got = by_id(nb_svm_quality.classify(docs, labels), "score", "predicted")
    assert len(got) == len(table) and all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert got[0] == got[1]
    assert nb_svm_quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in nb_svm_quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}


# 3: personal data


def test_base_spans(docs, empty, table):
    got = by_id(sanitise.report(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in table:
        n, joined = brute.base_spans(t)
        assert got[i][:5] == (*n, hashlib.sha256(joined.encode()).hexdigest()) and got[i][5].startswith(joined)
    assert sanitise.report(empty).count() == 0


def test_base_spans_of_random_strings(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab1234.@+- ()_é\n25") for _ in range(rng.randint(0, 60)))) for i in range(800)]
    rows += [(900, "1" * 5000), (901, "a" * 5000 + "@"), (902, "1.2.3.4." * 300), (903, "a@b.c_d@e.f x@y.z.w@q.r +1 234-567-8901.")]
    got = by_id(sanitise.report(frame(spark, rows, False)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    for i, t in rows:
        n, joined = brute.base_spans(t)
        assert got[i] == (*n, hashlib.sha256(joined.encode()).hexdigest()), t


def test_disclosing_terms_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdgklmn") + rng.choice("aeiou") for _ in range(4))
    rows = [(i, f"{' '.join(word() for _ in range(8))}\nmister Zorblatt writes from q.z@mail.org the {word()}") for i in range(4)]
    rows += [(i, f"mister the writes from {' '.join(word() for _ in range(9))}") for i in range(4, 60)]
    df = frame(spark, rows)
    spans = by_id(sanitise.report(df), "n_term", "spans")
    assert all(spans[i][0] == 1 for i in range(4)) and all(spans[i] == (0, "") for i in range(4, 60))
    clean = by_id(sanitise.sanitise(df), "text", "n_chars", "_cuts")
    assert "Zorblatt" not in clean[0][0] and "[email]" in clean[0][0] and "mister" in clean[0][0] and clean[0][1] == len(clean[0][0]) and clean[0][2] == "clash"
    assert clean[7][0] == rows[7][1]


def test_disclosing_terms_go_from_anywhere_in_the_text(spark):
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choice("bdgklmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))
    rows = [(i, f"Zorblatt\n{some(40)}\nq.z@mail.org {some(30)} Quuxley") for i in range(4)] + [(i, some(9)) for i in range(4, 60)]
    clean = by_id(sanitise.sanitise(frame(spark, rows)), "text")
    assert all("Zorblatt" not in clean[i][0] and "Quuxley" not in clean[i][0] for i in range(4))
    assert all(clean[i][0] == t.replace("Zorblatt", "").replace("Quuxley", "").replace("q.z@mail.org", "[email]") for i, t in rows)


def test_shares_are_those_of_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bdgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(25)]
    mails = ["a@b.org", "c@d.org", "e@f.org"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(12)) + "".join(f" {m}" for m in mails if rng.random() < 0.2)) for i in range(80)]
    rows += [(80 + k, rows[k][1]) for k in range(10)]
    df = frame(spark, rows, False)
    got = {(r["entity"], r["term"]): r["share"] for r in sanitise.disclosing(df, sanitise.base_spans(df), support=2, threshold=-9.0).collect()}
    words = {i: {w for w in re.split(r"[^a-z]+", t) if len(w) >= sanitise.TERM_LETTERS} for i, t in rows}
    want = {}
    for m in mails:
        holds = [i for i, t in rows if m in t]
        for w in set().union(*(words[i] for i in holds)):
            both = [i for i in holds if w in words[i]]
            if len({rows[i][1] for i in both}) >= 2:
                n_term = sum(w in words[i] for i, _ in rows)
                want["email:" + m, w] = np.log2(len(rows) * len(both) / (n_term * len(holds))) / np.log2(len(rows) / len(holds))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_spans_in_one_text_take_linear_time(spark):
    text = "".join(f"é{k}x@mail{k % 7}.org 日本 {k} " for k in range(8000))
    rows = [(i, text + str(i)) for i in range(3)] + [(i, "other words") for i in range(3, 40)]
    began = time.monotonic()
    got = by_id(sanitise.sanitise(frame(spark, rows, False)), "text")
    assert time.monotonic() - began < 60
    assert all(got[i][0].count("[email]") == 8000 and "@" not in got[i][0] for i in range(3)) and got[5][0] == "other words"


# 4 and 8: repeats


@pytest.mark.parametrize("hot", [512, 2, 1])
def test_repeated_bytes(docs, empty, table, hot, monkeypatch):
    monkeypatch.setattr(window_passes, "HOT_HULLS", hot)
    assert by_id(radix_suffixes.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(table)
    if hot > 1:
        assert radix_suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [512, 2, 1])
def test_repeated_words(docs, empty, table, hot, monkeypatch):
    monkeypatch.setattr(window_passes, "HOT_HULLS", hot)
    assert by_id(fm_index.remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(table)
    if hot > 1:
        assert fm_index.remove_repeats(empty).count() == 0


def test_blocks_settle_small_alphabets():
    rng = random.Random(2)
    rows = []
    for k in range(120):
        u = np.array([rng.choice([3, 5]) for _ in range(rng.randint(6, 12))], np.uint64)
        rows.append((0, k // 3, (k % 3) * 50, len(u) - 5, False, u.tobytes()))
    seen, want = {}, set()
    for _, d, lo, n, _, b in rows:
        for p in range(n):
            w = b[8 * p : 8 * (p + 6)]
            if w in seen:
                want.add((d, lo + p))
            seen.setdefault(w, (d, lo + p))
    assert {(d, p) for d, lo, n in fm_index.settle(rows, 6) for p in range(lo, lo + n)} == want


def test_radix_groups_are_exact():
    rng = random.Random(1)
    text = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(4000)), np.uint8)
    start = np.arange(4000 - 12)
    row, group = radix_suffixes.equal_groups(radix_suffixes._eights(text), start, np.zeros(len(start), np.int64), 12)
    count = {}
    for s in start:
        count.setdefault(text[s : s + 12].tobytes(), []).append(int(s))
    want = sorted(sorted(v) for v in count.values() if len(v) > 1)
    got = {}
    for r, g in zip(row.tolist(), group.tolist()):
        got.setdefault(g, []).append(r)
    assert sorted(sorted(v) for v in got.values()) == want


# 5 and 10: tokens


def ids_of(encoder, rows, end):
    out = encoder.library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return {i: e.ids + [end] for (i, _), e in zip(rows, out)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_the_library(name, table):
    rng = random.Random(7)
    odd = ["", " ", "a  b", " lead", "trail ", "a\n b", " x y", "don't I'll", "<|endoftext|> a <|endoftext|>b", "İ ΣΑΣ", "é a", "a\x1cb c", "it. ﬁ, ǅ! µ"]
    odd += ["".join(rng.choice("ab zÉ. ,!?'\n\t1２Σß\x85") for _ in range(rng.randint(1, 25))) for _ in range(800)]
    rows = list(enumerate([t for _, t in table if t] + odd))
    e = PieceEncoder(public_file(name), pieces=50)
    for _ in range(2):  # from an empty table, and from a full one
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for _, t in rows])] == [x[:-1] for x in ids_of(e, rows, 0).values()]


def test_packing(docs, empty, table):
    want = ids_of(PieceEncoder(public_file("byte_bpe_50k.json")), table, 1)
    rows = packing.pack(docs, public_file("byte_bpe_50k.json"), capacity=256).collect()
    covered, sequences = {i: [0] * len(x) for i, x in want.items()}, {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        for k in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"]][k] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(set(c) == {1} for c in covered.values())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(map(len, want.values()))
    assert len(sequences) <= total // 256 + 3
    assert packing.pack(empty, public_file("byte_bpe_50k.json")).count() == 0


def test_fill_finds_the_closest_sum():
    rng = random.Random(9)
    for _ in range(200):
        counts, room = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}, rng.randint(0, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        got = packing.fill(counts, room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got.items())


def test_token_files(docs, empty, table):
    path = public_file("word_bpe_49k.json")
    want, at, out = ids_of(PieceEncoder(path), table, 2), 0, {}
    for i in sorted(want):
        out[i] = (at, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        at += len(want[i])
    blocks = repair.write(docs, path, block_ids=700)
    assert by_id(repair.read(blocks), "start", "n_tokens", "ids_crc32") == out
    for b in blocks.collect():
        block = repair.Block(bytes(b["payload"]))
        for k, i in enumerate(block.doc_ids.tolist()):
            assert block.document(k).tolist() == want[i]
    assert repair.read(repair.write(empty, path)).count() == 0


def test_grammar_round_trips():
    rng = np.random.default_rng(3)
    for ids in ([], [5], [7] * 400, rng.integers(0, 3, 3000), np.tile(rng.integers(0, 70000, 50), 40)):
        ids = np.array(ids, np.uint32)
        ends = np.array(sorted({len(ids) // 3, len(ids) // 2, len(ids)}))
        data = repair.compress(ids, np.arange(len(ends)), ends)
        assert (repair.Block(data).all() == ids).all()
    assert len(data) < ids.nbytes


# 6: near-duplicates


def test_near_duplicates(docs, empty, table):
    got = by_id(superminhash.near_duplicates(docs), "n_shingles", "component_id")
    assert got == brute.near_duplicates(table)
    assert superminhash.near_duplicates(empty).count() == 0


def test_near_duplicates_over_small_blocks(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[:j] + [f"x{k}"] + words[j + 1 :])) for k, j in enumerate(rng.sample(range(200), 40))] + [(40, " ".join(words))]
    got = by_id(superminhash.near_duplicates(frame(spark, rows), block=4), "n_shingles", "component_id")
    assert got == brute.near_duplicates(rows)


def test_chained_clusters_are_compared_by_bands(spark):
    words = [f"w{k}" for k in range(400)]
    # each text is like its neighbours only
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(40)]
    df = frame(spark, rows)
    got = by_id(superminhash.near_duplicates(df, block=4), "n_shingles", "component_id")
    assert got == brute.near_duplicates(rows) and len({c for _, c in got.values()}) < 5
    member = spark.createDataFrame([(k, 0, [k // 2, 100 + (k + 1) // 2]) for k in range(40)], "node long, root long, bands array<long>")
    places = superminhash._places(member, 4).collect()
    assert len(places) == 40 and all(p["blocks"] == 1 for r in places for p in r["places"]) and sum(len(r["places"]) for r in places) < 80
    one = spark.createDataFrame([(k, 0, [7, 8]) for k in range(40)], "node long, root long, bands array<long>")
    assert all([p["of"] for p in r["places"]] == ["0"] for r in superminhash._places(one, 4).collect())


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(pool[:600]), np.unique(pool[300:900]), np.unique(pool[:5])]
    sig = superminhash.signatures(sets, 256)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.09
    assert all(len(set((s >> np.uint64(32)).tolist())) >= 1 for s in sig) and (sig != np.iinfo(np.uint64).max).all()


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.union_find({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got or want[k] == k for k in want)


# 7: vectors


def test_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [rng.normal(size=16) for _ in range(150)]
    rows += [rows[k % 10] + rng.normal(size=16) * 0.12 for k in range(60)] + [rows[3] * 2, rows[3] * 2, rows[3]]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(rows)]
    odd = [(900, None, "x"), (901, [], "x"), (902, [0.0] * 16, "x"), (903, [1.0, None] + [0.0] * 14, "x"), (904, [float("nan")] * 16, "x"), (905, [1e308] * 16, "x"), (906, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, block string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in sorted_projections.near_duplicates(df, block=32).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = brute.union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    links = sum(got[i][0] for i in range(len(x)))
    assert all(got[i][0] <= near[i].sum() for i in range(len(x))) and links >= 0.98 * near.sum()
    assert sum(got[i][1] == root[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all(got[k] == (0, k) for k in range(900, 907))
    assert sorted_projections.near_duplicates(df.limit(0)).count() == 0


def test_long_runs_of_one_key_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    v = np.ones(8) + rng.normal(size=(90, 8)) * 1e-4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in sorted_projections.near_duplicates(df, block=8).collect()} == {(89, 0)}


def test_dense_cone_loses_no_link(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[:600] = 3.1 * np.ones(32) / np.sqrt(32) + 0.17 * rng.normal(size=(600, 32))  # mutual cosine about 0.91
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in sorted_projections.near_duplicates(df, block=8).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert want.sum() > 200_000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.998 * want.sum()


def test_passes_meet_the_measured_density():
    assert sorted_projections.cheapest({10: 1_000_000}, 12) == 12
    assert sorted_projections.cheapest({10: 500_000, 20: 500_000}, 12) == 20
    assert sorted_projections.cheapest({10: 1_000_000, 250: 500}, 12) == 12


# 9: benchmark


def test_benchmark(spark, docs, empty, table):
    some = [t for _, t in table if t and len(t.split()) > 60]
    items = [(1, " ".join(some[0].split()[5:30])), (2, "four WORDS are"), (3, None), (4, ""), (5, "mail me-at A"), (6, some[-1]), (7, "never seen anywhere here"), (6, some[-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.decontaminate(table, items)
    assert by_id(benchmark_suffixes.decontaminate(docs, bench), *names) == want
    assert by_id(benchmark_suffixes.decontaminate(docs, bench, block_bytes=40), *names) == want
    assert not any(v[4] for v in by_id(benchmark_suffixes.decontaminate(docs, bench.limit(0)), *names).values())
    assert benchmark_suffixes.decontaminate(empty, bench).count() == 0


def test_benchmark_rows_stay_apart_in_every_form(spark, monkeypatch):
    monkeypatch.setattr(benchmark_suffixes, "STRETCH_ROWS", 1)
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    df = frame(spark, [(1, a), (1, b + " more"), (1, "none"), (None, a), (None, "none at all"), (None, a)]).coalesce(1)
    row = lambda r: (r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])
    for size in (benchmark_suffixes.BLOCK_BYTES, 40):
        got = sorted(row(r) for r in benchmark_suffixes.decontaminate(df, bench, block_bytes=size).collect())
        assert got == [(0, 3, 0, 0, False), (0, 30, 30, 1, True), (0, 30, 30, 1, True), (1, 1, 0, 0, False), (1, 30, 30, 1, True), (1, 31, 30, 1, True)]


def test_longest_matches(spark):
    text = " ".join(f"w{k}" for k in range(60))
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10, 40)))], "item_id long, text string")
    got = benchmark_suffixes.matches(frame(spark, [(5, "x " + text)]), bench).where("item_id is not null").collect()
    assert [(r["doc_start"], r["item_start"], r["n_matched"]) for r in got] == [(11, 0, 30)]


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(1, t), (1, t), (2, t), (None, t)]
    df = frame(spark, rows)
    assert sorted((r["doc_id"], r["n_removed"]) for r in fm_index.remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 60)]
    assert sorted((r["doc_id"], r["component_id"]) for r in superminhash.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert packing.pack(df, public_file("byte_bpe_50k.json")).count() == 4
    assert [r["start"] for r in repair.read(repair.write(df, public_file("word_bpe_49k.json"))).orderBy("start").collect()][0] == 0
    assert sanitise.report(df).count() == 4


def test_samples_are_bounded(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ids = d.where(F.col("lang").isNotNull() & ~crf_language.held_out(F.col("doc_id"))).count()
    assert ids > 20 and crf_language.train(d, 20).languages
