from __future__ import annotations

import random

import pytest

#: Names that operators use inside; a table may have them as further columns.
CLASHING = "node string, root string, block string, bands string, key string, hull1 string, runs string, text_hash string, _cuts string, _id string, lo string, n string, score string, held_out string"


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Crafted documents: nulls, empty, white space, very long, copies, near copies, shared passages, runs, personal data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    base, passage, long_ = some(120), some(70), some(6000)
    ws = base.split()
    near = [" ".join(ws[:k] + ["changed"] + ws[k + 1 :]) for k in (3, 60, 117)]
    rows = [None, "", " \n\t ", "one", "four words are few", "four words are few", base, base, base.upper(), *near, long_, long_ + " " + some(50)]
    rows += [f"{some(30)} {passage} {some(30)}" for _ in range(4)] + [f"{passage}\n{passage}"]
    rows += ["ho " * 300, "ho " * 300 + "hi", "ab" * 500, "é" * 450, "日本 語 テスト " * 40, "!!! 123 ...", "x" * 401]
    rows += [f"{some(5)} mail me at a.b+c@ex-am.ple.org, or 10.0.0.256 10.0.0.25 tel +49 (30) 1234-567 card 4111 1111 1111 1111 {some(3)}"]
    rows += [f"{some(20)}. {some(20)}" for _ in range(6)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def table():
    return texts()


def frame(spark, rows, more: bool = True):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {CLASHING}" if more else "")
    width = len(CLASHING.split(",")) if more else 0
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), *(["clash"] * width)) for i, t in rows], schema).repartition(3)
