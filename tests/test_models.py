"""Two-covariance fits, back ends that are saved, staged commits, enrolment, nested texts, labelled scans, array scores."""

from __future__ import annotations

import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import nested
from attestra.functions.likelihood import circumstances_prior, restricted_prior
from attestra.operators import latent, metrics, pair_arrays, pairs, plda, profiles
from attestra.operators import text as op
from attestra.operators.backend import BackEnd, BackEndModel
from attestra.operators.governance import verify_chain
from attestra.sources import files
from attestra.sources.store import Conflict, DuplicateKey, Store
from attestra.streaming import enrolment

# -- two covariances


def speakers(counts, seed=0, dims=3):
    rng = np.random.default_rng(seed)
    b, w = np.diag([4.0, 1.0, 0.2])[:dims, :dims], np.diag([0.5, 1.0, 1.5])[:dims, :dims]
    out = []
    for s, n in enumerate(counts):
        y = rng.multivariate_normal(np.zeros(dims), b)
        out += [(f"s{s}", (y + rng.multivariate_normal(np.zeros(dims), w) + 1).tolist()) for _ in range(n)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "speaker string, v array<double>").repartition(3)


def em_by_speaker(rows, rounds):
    """The same rounds speaker by speaker."""
    x = np.array([v for _, v in rows])
    mean, d = x.mean(0), x.shape[1]
    total = (x - mean).T @ (x - mean)
    b = w = total / len(x) / 2 + 1e-8 * np.trace(total) / len(x) / d * np.eye(d)
    ridge = 1e-8 * np.trace(total) / len(x) / d * np.eye(d)
    groups = {}
    for s, v in rows:
        groups.setdefault(s, []).append(np.array(v) - mean)
    for _ in range(rounds):
        nb, nw = np.zeros((d, d)), np.zeros((d, d))
        for own in groups.values():
            cov = np.linalg.inv(np.linalg.inv(b) + len(own) * np.linalg.inv(w))
            y = cov @ np.linalg.inv(w) @ np.sum(own, 0)
            nb += cov + np.outer(y, y)
            nw += sum(np.outer(v - y, v - y) + cov for v in own)
        b, w = nb / len(groups) + ridge, nw / len(x) + ridge
    return b, w


def observed(rows, mean, b, w):
    total, groups = 0.0, {}
    for s, v in rows:
        groups.setdefault(s, []).append(np.array(v) - mean)
    for own in groups.values():
        n, d = len(own), len(mean)
        c = np.kron(np.ones((n, n)), b) + np.kron(np.eye(n), w)
        x = np.concatenate(own)
        total -= 0.5 * (n * d * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + x @ np.linalg.solve(c, x))
    return total


def test_two_covariance_rounds(spark):
    rows = speakers([1, 2, 3, 3, 5] * 8)
    s = plda.statistics(vectors(spark, rows + [(None, [9.0, 9.0, 9.0])]), "speaker", "v", 3)
    assert (s.n, s.speakers, {n: k for n, (k, _) in s.by_count.items()}) == (len(rows), 40, {1: 8, 2: 8, 3: 16, 5: 8})
    model = plda.fit(s)
    b, w = em_by_speaker(rows, len(model.trace) - 1)
    assert np.allclose(model.between, b, atol=1e-7) and np.allclose(model.within, w, atol=1e-7)
    assert all(y >= x - 1e-9 * abs(x) for x, y in zip(model.trace, model.trace[1:])) and model.converged
    assert model.trace[-1] == pytest.approx(observed(rows, model.mean, b, w))


def test_two_covariances_are_recovered(spark):
    rows = speakers([4] * 1500, seed=1)
    model = plda.fit(plda.statistics(vectors(spark, rows), "speaker", "v", 3))
    # with equal numbers of recordings the moments are the answer
    x = np.array([v for _, v in rows]).reshape(1500, 4, 3)
    within = np.einsum("sni,snj->ij", x - x.mean(1, keepdims=True), x - x.mean(1, keepdims=True)) / (1500 * 3)
    between = np.cov(x.mean(1).T, bias=True) - within / 4
    assert np.allclose(model.within, within, atol=0.02) and np.allclose(model.between, between, atol=0.05)
    t, psi = model.axes()
    assert np.allclose(t.T @ model.within @ t, np.eye(3), atol=1e-6) and np.allclose(t.T @ model.between @ t, np.diag(psi), atol=1e-6)
    d = model.diagnostics()
    assert d["psi_1"] == pytest.approx(8, rel=0.15) and d["n_above_inert"] == 3 and d["psi_ratio"] == pytest.approx(d["psi_1"] / d["psi_2"]) and d["n_recordings"] == 6000


def test_two_covariances_need_ground(spark):
    for rows in ([], speakers([3] * 5), speakers([1] * 40)):
        with pytest.raises(plda.TooFewSpeakers):
            plda.fit(plda.statistics(vectors(spark, rows), "speaker", "v", 3))


# -- back end


def test_back_end_is_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, *(float(round(rng.normal() + 3 * (i % 2), 2)) if rng.random() > p else None for p in (0, 0.3))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, label int, x double, y double")
    model = BackEnd(["x", "y"]).fit(df)
    model.save(str(tmp_path / "model"))
    again = BackEndModel.load(str(tmp_path / "model"))
    got, kept = ([tuple(r) for r in m.transform(df).orderBy("i").collect()] for m in (model, again))
    assert got == kept
    (slope, shift), (low, high) = model.getOrDefault("lines")[0], model.getOrDefault("bounds")[0]
    assert (slope, shift) == pytest.approx(metrics.fit_logistic(df.select(F.col("x").alias("score"), "label")))
    assert all(r[4] == pytest.approx(min(max(slope * r[2] + shift, low), high)) and (r[5] is None) == (r[3] is None) and r[6] is not None for r in got)
    costs = [metrics.cllr(model.transform(df).select(F.col(c).alias("score"), "label").where("score is not null")).first()["cllr"] for c in ("x_log_lr", "fused_log_lr")]
    assert costs[1] < costs[0]
    BackEnd(["x", "y"]).save(str(tmp_path / "estimator"))
    assert BackEnd.load(str(tmp_path / "estimator")).getOrDefault("streams") == ["x", "y"]
    with pytest.raises((metrics.TooFewTrials, latent.TooFewRows)):
        BackEnd(["x"]).fit(df.limit(20))


# -- commits

TABLES, KEYS = {"a": "k int, v string", "b": "k int"}, {"a": "k", "b": "k"}


def test_commits_are_seen_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path, TABLES, KEYS)
    rows = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string")
    see = lambda t: sorted(r["k"] for r in Store(spark, path, TABLES, KEYS).read(t).collect())
    assert see("a") == [] and store.manifest()["version"] == 0
    with store.begin() as work:
        work.add("a", rows(1, 2))
        work.add("b", rows(7).select("k"))
        assert see("a") == []  # staged only
        assert work.commit() == 1
    assert (see("a"), see("b")) == ([1, 2], [7])
    with pytest.raises(RuntimeError), store.begin() as work:
        work.add("a", rows(3))
        raise RuntimeError("killed")
    with store.begin() as work:
        work.add("a", rows(4))  # never committed
    assert see("a") == [1, 2]
    # files of a commit that died before its manifest are not read
    rows(9).write.parquet(f"{path}/data/a/dead")
    assert see("a") == [1, 2]
    with store.begin() as work:
        for bad in (rows(1), rows(5, 5)):
            with pytest.raises(DuplicateKey):
                work.add("a", bad)
        work.add("a", rows(5, 6))
        with pytest.raises(DuplicateKey):
            work.add("a", rows(6))
        work.delete("a", rows(1, 6, 99))
        assert [r["k"] for r in work.exists("a", rows(2, 5)).collect()] == [2]
        work.commit()
    assert see("a") == [2, 5] and see("b") == [7]
    one, other = store.begin(), store.begin()
    one.add("a", rows(10))
    other.add("a", rows(11))
    one.commit()
    with pytest.raises(Conflict):
        other.commit()
    assert see("a") == [2, 5, 10]


# -- enrolment

INCIDENT = "incident_id string, case_reference string, submitted_by string, role string, submitted_at timestamp, amount double, phone string"


def incident(i, role="enrolment_officer", amount=1.0, phone="p"):
    return (i, "ABC-2024-0001", "officer", role, datetime.datetime(2024, 1, 1), amount, phone)


def broken(_):
    raise KeyError("no such model")


EXTRACTORS = {"transactional": lambda df: F.to_json(F.struct("amount")), "device": lambda df: F.col("phone"), "acoustic": broken, "temporal": lambda df: F.col("missing_column")}


def test_enrolment(spark, tmp_path):
    store = enrolment.open_store(spark, str(tmp_path / "store"))
    frame = lambda *rows: spark.createDataFrame(rows, INCIDENT)
    failed = enrolment.enrol(store, frame(incident("i1"), incident("i2", phone=None), incident("i3", "investigator"), incident("i1"), incident(None)), EXTRACTORS, number=0)
    assert set(failed) == {"acoustic", "temporal"} and failed["acoustic"] == "KeyError"
    state = lambda: {t: sorted(map(str, store.read(t).collect())) for t in enrolment.TABLES}
    before = state()
    assert {r["incident_id"]: len(r["warnings"]) for r in store.read("incidents").collect()} == {"i1": 2, "i2": 2}
    assert {r["evidence_id"]: r["payload"] for r in store.read("evidence").collect()} == {"i1/transactional": '{"amount":1.0}', "i1/device": "p", "i2/transactional": '{"amount":1.0}'}
    log = [r["body"] for r in store.read("audit").orderBy("sequence").collect()]
    assert sorted(b.split('"outcome":"')[1].split('"')[0] for b in log) == ["failed: already enrolled", "failed: no incident", "failed: not authorised", "ok", "ok"]
    # the same batch again changes nothing
    assert enrolment.enrol(store, frame(incident("i9")), EXTRACTORS, number=0) == {} and state() == before
    enrolment.enrol(store, frame(incident("i2"), incident("i4")), EXTRACTORS, number=1)
    assert {r["incident_id"] for r in store.read("incidents").collect()} == {"i1", "i2", "i4"} and store.read("audit").count() == 7
    chain = verify_chain(store.read("audit"), enrolment.GENESIS).first()
    assert chain["is_intact"] and chain["n_entries"] == 7
    spoilt = store.read("audit").withColumn("body", F.when(F.col("sequence") == 4, "x").otherwise(F.col("body")))
    assert verify_chain(spoilt, enrolment.GENESIS).first()["first_broken"] == 4


def test_enrolment_of_a_stream(spark, tmp_path):
    store, arriving = enrolment.open_store(spark, str(tmp_path / "store")), str(tmp_path / "in")

    def run():
        incoming = spark.readStream.schema(INCIDENT).option("maxFilesPerTrigger", 1).parquet(arriving)
        query = enrolment.enrolling(incoming, store, EXTRACTORS).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None

    spark.createDataFrame([incident("a"), incident("b")], INCIDENT).coalesce(1).write.mode("append").parquet(arriving)
    run()
    spark.createDataFrame([incident("b"), incident("c")], INCIDENT).coalesce(1).write.mode("append").parquet(arriving)
    run()
    run()
    assert sorted(r["incident_id"] for r in store.read("incidents").collect()) == ["a", "b", "c"] and store.read("audit").count() == 4
    assert verify_chain(store.read("audit"), enrolment.GENESIS).first()["is_intact"]
    assert store.manifest()["batches"] == {"enrolment": 1}


# -- nested texts


def test_phrases_at_any_depth(spark):
    schema = "id int, top string, s struct<a: string, deep: array<struct<note: string, n: int>>>, m map<string, array<string>>, k map<string, int>, blob binary"
    rows = [
        (1, "fine", ("ok", [("ok", 1)]), {"x": ["ok"]}, {"ok": 1}, b"guilty"),
        (2, "They matched", None, None, None, None),
        (3, None, ("ok", [("ok", 1), None, ("is the same person", 2)]), {"x": ["ok", None, "voiceprint"], "proven": None}, {"guilty": 1}, None),
        (4, None, None, {}, {}, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: sorted((x["origin"], x["phrase"]) for x in r["v"]) for r in df.select("id", nested.structure_violations(df).alias("v")).collect()}
    assert got == {1: [], 2: [("top", "matched")], 3: sorted([("s.deep[2].note", "is the same person"), ("m.x[2]", "voiceprint"), ("m.key", "proven"), ("k.key", "guilty")]), 4: []}
    assert nested.assert_structure_permitted(df.where("id in (1, 4)")).count() == 2
    with pytest.raises(Exception, match="prohibited phrase at m.key|prohibited phrase at s.deep|prohibited phrase at"):
        nested.assert_structure_permitted(df).collect()
    named = spark.createDataFrame([(("x",),)], "s struct<identified: string>")
    assert [tuple(x) for x in named.select(nested.structure_violations(named).alias("v")).first()["v"]] == [("s.key", "identified")]
    assert spark.range(2).select(nested.structure_violations(spark.range(2)).alias("v")).where(F.size("v") > 0).count() == 0


# -- scans


def test_labelled_and_unlabelled_scans(spark, tmp_path):
    root, back = tmp_path / "lab", tmp_path / "back"
    root.mkdir(), back.mkdir()
    names = ["01-200101-101010_bem_1.wav", "01-200101-101010_bem_2.wav", "01-200101-101010_bem_3.wav", "01-200202-101010_bem_1.wav", "02-200101-101010_bem_1.wav", "99-200101-101010_x.wav", "99-200102-101010_x.wav", "200701-160335_bem_d16_elicit_40.wav", "notes.txt", "03-2001-10_bem.wav"]
    for n in names:
        (root / n).write_bytes(b"not audio")
    (back / "b1.one.wav").write_bytes(b"x")
    (tmp_path / "roster.txt").write_text("| id | sex | n | time |\n| 01 | F | 4 | 0:01:05 |\n| 02 | M | 1 | 0:00:05 |\n")
    roster = files.roster(spark, str(tmp_path / "roster.txt"))
    got = files.scan_labelled(spark, str(root), roster).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == names[:2] + [names[3]] and {r["speaker"] for r in got} == {"01"} and all(r["length"] == 9 for r in got)
    assert len(files.scan_labelled(spark, str(root), roster, most=1, least_sessions=1).collect()) == 3
    bg = files.scan_unlabelled(spark, [str(back), str(root)])
    assert {r["recording"] for r in bg.collect()} >= {"bg-back-b1.one", "bg-lab-200701-160335_bem_d16_elicit_40"} and bg.count() == 10
    with pytest.raises(ValueError):
        files.reject_unlabelled(bg)
    name = spark.createDataFrame([(n,) for n in names], "n string").select(files.labelled_name(F.col("n")).alias("x")).where("x is null").count()
    assert name == 3


# -- priors


def test_priors_need_a_reason(spark):
    df = spark.createDataFrame([(5, 2.0, "because", "jane"), (1, -1.0, "because", "jane"), (5, 2.0, "  ", "jane"), (5, 2.0, None, "jane"), (5, 2.0, "because", "system")], "n int, odds double, why string, who string")
    got = df.select(restricted_prior(F.col("n"), F.col("why"), F.col("who")).alias("r"), circumstances_prior(F.col("odds"), F.col("why"), F.col("who")).alias("c")).collect()
    assert got[0]["r"]["log_odds"] == pytest.approx(-math.log(4)) and got[0]["c"]["log_odds"] == pytest.approx(math.log(2)) and got[0]["c"]["search_mode"] == "verification"
    assert all(r["r"] is None and r["c"] is None for r in got[1:])


# -- array scores and languages in place


def test_array_scores_are_those_of_maps(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(e), f"c{int(c)}", int(n)) for e in range(0, 120) if e % 7 for c, n in zip(rng.choice(30, 6, False), rng.integers(1, 5, 6))]
    counted = spark.createDataFrame(rows, "entity long, category string, n long")
    values = spark.createDataFrame([(int(e), float(rng.normal())) for e in range(120) if e % 5 for _ in range(3)], "entity long, v double")
    freq = profiles.background(counted.where("category <> 'c3'"))  # one is unknown to the background
    moments, prior = profiles.moments(values, "entity", F.col("v")), profiles.normal_prior(values, F.col("v"))
    table = spark.range(120).withColumnRenamed("id", "entity").join(pairs.with_weights(counted, freq, 20.0, "kind"), "entity", "left").join(pairs.with_marginals(moments, prior, "v"), "entity", "left")
    old = {(r["a"], r["b"]): (r["x"], r["y"]) for r in pairs.probe_pairs(table).select(*pairs.sides(), pairs.multinomial("kind", 20.0).alias("x"), pairs.normal("v").alias("y")).collect()}
    for probes, entries in ((2000, 10**6), (1, 37)):
        monkeypatch.setattr(pair_arrays, "PROBES", probes)
        monkeypatch.setattr(pair_arrays, "ENTRIES", entries)
        new = pair_arrays.scored(spark.range(120).select(F.col("id").alias("entity"), (F.col("id") * 2).alias("more")), {"kind": pair_arrays.Counts(counted, freq, 20.0)}, {"v": pair_arrays.Values(moments, prior)}).collect()
        assert {(r["p"]["entity"], r["q"]["entity"]) for r in new} == set(old) and len(new) == len(old)
        for r in new:
            assert r["q"]["more"] == 2 * r["q"]["entity"]
            for got, want in zip((r["kind"], r["v"]), old[r["p"]["entity"], r["q"]["entity"]]):
                assert (got is None) == (want is None) and (want is None or got == pytest.approx(want, abs=1e-7))


def test_languages_in_place_and_by_joins(spark, monkeypatch):
    texts = [("x", "the cat sat on the mat and the dog"), ("y", "le chat est sur la table et le chien"), ("x", "a dog ran over the hill"), ("y", "la vie est belle et le ciel bleu")]
    model = op.language_model(op.characters(spark.createDataFrame(texts, "lang string, text string"), "lang", "text", 4), "lang")
    parts = op.windows(spark.createDataFrame([(1, "the dog sat. le chat est là"), (2, "zzz qqq"), (3, "Le chien et la table"), (4, "")], "k0 int, text string"), "k0", "text", 3)
    rows = lambda: sorted((r["k0"], r["k"], r["language"], round(r["confidence"], 9)) for r in op.identified(parts, "k0", model, "lang", 4).collect())
    here = rows()
    monkeypatch.setattr(op, "MODEL_ROWS", 0)
    assert here == rows() and len(here) == 6 and {r[2] for r in here} == {"x", "y"}
    empty = model.limit(0)
    assert op.identified(parts, "k0", empty, "lang", 4).count() == 0
