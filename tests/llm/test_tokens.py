from __future__ import annotations

import random
from collections import Counter, defaultdict

from sievemill.llm import mixing, packing, token_budget

MERGES = [("e", "a"), ("a", "t"), ("ea", "t"), ("B", "ea"), ("s", "s"), ("ss", "s")]
DATASETS = "key string, lang string, domain string, enabled boolean"
RECORDS = "id string, source string, lang string, context string, domain string, n_tokens long, text string"


def merges(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MERGES)], "merge_rank int, left_piece string, right_piece string")


def test_merging_follows_the_ranks():
    t = token_budget.Tokenizer(MERGES)
    assert t.encode("eat") == ["eat"] and t.encode("Beat") == ["B", "eat"] and t.encode("Beas") == ["Bea", "s"]
    assert t.encode("sssss") == ["ss", "sss"]
    assert t.count(["eat  Beas!", "你好 x_1", None, "", " 　"]).tolist() == [4, 5, 0, 0, 0]


def test_long_runs_are_counted_like_short_ones():
    rnd = random.Random(1)
    t = token_budget.Tokenizer(MERGES)
    for _ in range(500):
        w = "".join(rnd.choice("eatBs") for _ in range(rnd.randint(1, 40)))
        assert token_budget._long(w, t.words.ranks) == len(t.encode(w))
    assert t.count(["eat" * 5000]).tolist() == [5000]


def test_update_equals_a_fresh_count_and_encodes_only_what_is_new(spark):
    tok = token_budget.Tokenizer(MERGES)
    ds = spark.createDataFrame([("s", "en", "law", True), ("t", "zh", None, True)], DATASETS)
    rec = lambda rows: spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], RECORDS)
    doc = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, domain string, text string")
    one = token_budget.deliveries(rec([("a", "s", "eng", "eat eat"), ("b", "s", None, "gone"), ("c", "t", "zh_Hans", None), ("c", "t", "zh_Hans", None), (None, "t", "zh", "x")]), doc([(1, "s", "en-US", None, "Beat")]), ds)
    two = token_budget.deliveries(rec([("a", "s", "eng", "eat eat eat"), ("c", "t", "zh_Hans", None), ("d", "s", "en", "eat eat")]), doc([(1, "s", "en-US", "web", "Beat"), (2, "u", None, None, "")]), ds)
    old, new = token_budget.first_ledger(one, tok), None
    assert {tuple(r) for r in token_budget.budget(old).collect()} == {("record", "s", "en", "law", 2, 6), ("record", "t", "zh", None, 1, 0), ("document", "s", "en", None, 1, 2)}
    new = token_budget.update(old, two, tok)
    fresh = token_budget.first_ledger(two, tok)
    cube = token_budget.updated(token_budget.budget(old), token_budget.deltas(old, new))
    assert {tuple(r) for r in cube.collect()} == {tuple(r) for r in token_budget.budget(fresh).collect()}
    assert token_budget.deltas(new, fresh).count() == 0
    assert token_budget.budget(token_budget.first_ledger(two.limit(0), tok)).count() == 0


def test_packing_keeps_every_item_whole(spark):
    rnd = random.Random(2)
    sizes = {f"d{i}": rnd.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, 300]) for i in range(3000)}
    items = spark.createDataFrame([*sizes.items(), ("d0", sizes["d0"]), (None, 5), ("null", None)], "id string, n_tokens long").selectExpr("*", "1 AS container", "'x' AS spec_name")
    specs = spark.createDataFrame([("a", 100), ("b", 1000), ("none", None), ("zero", 0)], "spec_name string, capacity_tokens int")
    got = packing.pack(items, specs).collect()
    caps = {"a": 100, "b": 1000}
    fill, per = Counter(), defaultdict(list)
    for r in got:
        fill[r["spec_name"], r["container"]] += r["n"]
        per[r["spec_name"], r["id"]].append(r)
    assert {s for s, _ in fill} == set(caps) and all(n <= caps[s] for (s, _), n in fill.items())
    for s, cap in caps.items():
        for i, n in {**sizes, "null": 0}.items():
            pieces = per[s, i]
            assert sum(p["n"] for p in pieces) == n and sorted(p["piece"] for p in pieces) == list(range(len(pieces)))
            assert len(pieces) == max(1, -(-n // cap))
    total = sum(sizes.values())
    for r in packing.fill(packing.pack(items, specs), specs).collect():
        assert r["n_tokens"] == total and r["unused_share"] < 0.05
    assert packing.pack(items.limit(0), specs).count() == 0 and packing.pack(items, specs.limit(0)).count() == 0


def test_many_partitions_merge_their_leftovers(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 100)
    items = spark.range(4000).selectExpr("CAST(id AS STRING) AS id", "1 + id % 37 AS n_tokens")
    specs = spark.createDataFrame([("a", 100)], "spec_name string, capacity_tokens int")
    row = packing.fill(packing.pack(items, specs), specs).collect()[0]
    assert row["n_tokens"] == sum(1 + i % 37 for i in range(4000)) and row["unused_share"] < 0.03


def test_subset_reaches_the_best_sum():
    rnd = random.Random(4)
    for _ in range(200):
        lengths = rnd.sample(range(1, 40), rnd.randint(1, 5))
        counts = [rnd.randint(0, 4) for _ in lengths]
        budget = rnd.randint(0, 120)
        sums = {0}
        for a, n in zip(lengths, counts):
            sums = {s + a * k for s in sums for k in range(n + 1)}
        take = mixing.subset(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_mixture_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 50)
    rnd = random.Random(6)
    rows = [(f"{s}{i}", s, lang, "word " * rnd.randint(1, 9), None, 1, "clash") for s, n, lang in (("big", 900, "en"), ("small", 60, "EN"), ("zh", 300, None)) for i in range(n)]
    rows += [rows[0], ("x1", "other", "en", "word", None, 1, ""), ("x2", "big", "fr", "word", None, 1, ""), ("x3", "big", "en", None, None, 1, ""), (None, "big", "en", "word", None, 1, "")]
    targets = spark.createDataFrame([("big", "en", 0.5, 1), ("small", "en", 0.2, 5), ("zh", "zh", 0.25, None), ("empty", "en", 0.05, 2)], "source string, lang string, target_share double, max_repeats int")
    records = spark.createDataFrame(rows, RECORDS)
    used, shares = mixing.mixture(records, targets, merges(spark), shortfall=0.0)
    u, s = used.collect(), {r["source"]: r for r in shares.collect()}
    assert len({r["id"] for r in u}) == len(u) and not {"x1", "x2", "x3"} & {r["id"] for r in u}
    got = Counter()
    for r in u:
        assert 1 <= r["times"] <= {"big": 1, "small": 5, "zh": 1}[r["source"]]
        got[r["source"]] += r["times"] * r["n_tokens"]
    total = sum(got.values())
    for k, share in (("big", 0.5), ("small", 0.2), ("zh", 0.25)):
        assert s[k]["n_tokens"] == got[k] and abs(s[k]["actual_share"] - got[k] / total) < 1e-9
        assert abs(got[k] / total - share / 0.95) < 0.01
    assert s["empty"]["n_tokens"] == 0 and s["empty"]["actual_share"] == 0
    again = mixing.mixture(records.orderBy("context"), targets, merges(spark), shortfall=0.0)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in u}
    none, report = mixing.mixture(records.limit(0), targets, merges(spark))
    assert none.count() == 0 and {r["n_tokens"] for r in report.collect()} == {0}
