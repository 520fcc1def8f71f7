"""Each stage against its own input."""

from __future__ import annotations

import corpus_pipeline
from attestra.llm.common import table

from . import brute
from .conftest import frame


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := str(tmp_path / str(k)))
        out = spark.read.parquet(path)
        if name != "pack":
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert all(before[i] is None or not any(c.isalpha() for c in before[i]) for i in before.keys() - after.keys())
        elif name == "near_dedup":
            root = brute.near_duplicates(list(before.items()), 80)
            assert set(after) == {i for i, (_, c) in root.items() if i == c}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(after) == {i for i, v in brute.decontaminate(list(before.items()), items).items() if not v[4]}
        elif name == "pii":
            assert set(after) == set(before)
            assert all(brute.base_spans(t)[0][0] == 0 for t in after.values())
            assert all(after[i] == before[i] for i in before if not any(brute.base_spans(before[i])[0]))
        else:
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(before)
        docs = out


def test_run_gives_the_stages_rows(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_with_odd_rows(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    item = next(r["text"] for r in table(spark, sf_dir, "benchmark").collect() if len(r["text"].split()) >= 20)
    plain = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, plain), (2, plain), (2, plain), (None, plain), (3, item), (None, item), (4, None), (None, None), (5, ""), (6, " \n "), (7, "write to a@b.org or a@b.org"), (7, "write to a@b.org or a@b.org"), (None, "c@d.org")]
    docs = frame(spark, rows)
    kept = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()), key=str)
    want = lambda test: sorted(((i or 0, t) for i, t in rows if test(i, t)), key=str)
    assert kept(stages["near_dedup"](spark, docs, sf_dir)) == want(lambda i, t: i != 2)
    assert kept(stages["decontaminate"](spark, docs, sf_dir)) == want(lambda i, t: i != 3)
    clean = stages["pii"](spark, docs, sf_dir)
    assert kept(clean) == sorted(((i or 0, t and t.replace("a@b.org", "[email]").replace("c@d.org", "[email]")) for i, t in rows), key=str)
    assert {r["node"] for r in clean.collect()} == {"clash"}
    packed = stages["pack"](spark, docs, sf_dir).collect()
    assert len(packed) == len(rows) and sum(r["doc_id"] is None for r in packed) == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
