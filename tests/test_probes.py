from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sievemill import config
from sievemill.operators import governance, metrics, probes, sampling, trees

FAMILY = probes.Family("f", "s", "en", "test", "choice", 2, ("native?", "english?"), {"0": ("null", "zero"), "1": ("eins", "one")})


def test_items_are_drawn_evenly_or_not_at_all(spark):
    rows = spark.createDataFrame([(i, f"text {i}", str(i % 2)) for i in range(9)] + [(20, None, "0"), (21, " ", "1"), (22, "x", "other")], "row long, text string, label string")
    got = probes.build([FAMILY], {"f": rows}).collect()
    assert sorted(r["gold_en"] for r in got) == ["one", "one", "zero", "zero"] and all(r["q_native"]["question"]["criteria"][int(r["gold_en"] == "one")]["key"] == r["gold_native"] for r in got)
    with pytest.raises(Exception, match="class too small"):
        probes.items(FAMILY, rows.where("label = '0' OR row < 2")).collect()


def test_sets_that_are_not_aligned_end_with_an_error(spark):
    side = lambda labels: spark.createDataFrame([(i, "p", "h", x) for i, x in enumerate(labels)], "row long, premise string, hypothesis string, label string")
    names = {"0": ("a", "b"), "1": ("c", "d")}
    got = probes.parallel(side("010"), side("010"), "x", names, ("?", "?")).orderBy("id").collect()
    assert [(r["gold_native"], r["gold_en"]) for r in got] == [("a", "b"), ("c", "d"), ("a", "b")]
    with pytest.raises(Exception, match="not aligned"):
        probes.parallel(side("010"), side("011"), "x", names, ("?", "?")).collect()


def test_typed_decisions_and_nesting(spark):
    cases = spark.createDataFrame([("c", "s", '{"q": {"type": "score", "criteria": ["a", "b"]}}', '{"q": {"label": "1", "probabilities": [0.2, 0.8], "score": 0.8}}'), ("d", "s", "no json", "{}"), ("e", None, None, None)], "id string, state string, questions string, gold string")
    got = probes.typed_decisions(cases).collect()
    assert [(r["id"], r["gold"], r["gold_soft"], r["criteria"]) for r in got] == [("c/q", "1", [0.2, 0.8], ["a", "b"])]
    rows = spark.createDataFrame([(1, [(["x", "y"], 7), ([], 8)]), (2, [])], "k int, outer array<struct<inner: array<string>, n: int>>")
    assert [tuple(r) for r in probes.flattened(rows, "outer", "inner").orderBy("j").collect()] == [(1, 0, 7, 0, "x"), (1, 0, 7, 1, "y")]


def test_exact_p_of_very_large_counts(spark):
    df = spark.createDataFrame([(10**9, 10**9 + 60_000), (3 * 10**9, 10), (0, 0), (None, 1)], "b long, c long")
    p = [r["p"] for r in df.select(metrics.mcnemar("b", "c").alias("p")).collect()]
    n = 2 * 10**9 + 60_000
    assert p[0] == pytest.approx(math.erfc((60_000 - 1) / math.sqrt(2 * n)), rel=1e-3) and p[1] == 0 and p[2] == 1 and p[3] is None


def test_carry_matches_a_plain_pass(spark):
    rows = [(g, i, None if (i * 7 + g) % 5 else f"v{i}") for g in (1, 2) for i in range(60)] + [(None, 1, "n"), (None, 2, None)]
    df = spark.createDataFrame(rows, "g int, i int, v string")
    got = {(r["g"], r["i"]): r["c"] for r in trees.carry_forward(df, ["g"], ["i"], F.col("v"), "c", F.floor(F.col("i") / 10)).collect()}
    want = {}
    for g in (1, 2, None):
        last = None
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[g, i] = last
            last = v or last
    assert got == want


def test_negatives_fit_even_where_few_do(spark):
    rows = spark.createDataFrame([(f"r{i}", "g", [f"e{j}" for j in range(40) if j != 7 and j != i % 3 + 20], "e7" if i % 2 else "") for i in range(30)] + [("none", "h", ["a"], "")], "id string, g string, own array<string>, text string")
    pool = spark.createDataFrame([("g", f"e{j}") for j in range(40)] + [("h", "a"), ("g", None)], "g string, entry string")
    got = {r["id"]: r["negative"] for r in sampling.negatives(rows, pool, "g", "own", "text", "s").collect()}
    assert set(got) == {f"r{i}" for i in range(30)} and all(v in ("e7", f"e{int(k[1:]) % 3 + 20}") and not (v == "e7" and int(k[1:]) % 2) for k, v in got.items())


def test_release_gates_and_card(spark):
    r = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "source string, split string")
    d = spark.createDataFrame([("a", "ok", None), ("c", "bad", None)], "key string, license string, role string")
    lic = spark.createDataFrame([("ok", "ALLOW", False), ("bad", "EXCLUDE", False)], "key string, class string, share_alike boolean")
    bad = governance.publish_problems(r, d, lic, least=3)
    assert {r["problem"] for r in bad.collect()} == {"b: not listed", "trial run"} and governance.publish_problems(r.where("source = 'a'"), d, lic, least=1).count() == 0
    assert "not for publication: b: not listed; trial run" in governance.card("T", r, d, bad)
    s = lambda rows: spark.createDataFrame(rows, "name string, kind string")
    assert {tuple(r) for r in governance.structure(s([("x", "int"), ("y", None), ("z", "a")]), s([("x", "long"), ("y", None), ("w", "b")])).collect()} == {("x", "is long, not int"), ("z", "missing"), ("w", "extra")}


def test_settings_that_decide_on_going_on():
    base = {"train": {"rate": 1, "folder": "a", "new": 0}}
    same = {"train": {"rate": 1, "folder": "b"}}
    h = lambda c: config.resume_hash(c, {"train.folder"}, {"train.new": 0})
    assert h(base) == h(same) != h({"train": {"rate": 1, "new": 1}}) and h(base) != h({"train": {"rate": 2}})
    assert config.train_rows({"a": 5}, "a", 3) == 5 and config.train_rows({}, "a", 3) == 3
    assert config.split_note({"a": "by hash"}, {"a": 1000}, "a") == "by hash; training draw of 1,000 rows"
