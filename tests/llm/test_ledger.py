from __future__ import annotations

from sievemill.llm import queries, token_budget

SF = "/root/testdata/sf0.001"


NEW = "kind string, id string, source string, lang string, domain string, text string"


def test_each_unseen_content_is_encoded_once(spark, monkeypatch, tmp_path):
    rows = [("record", str(i), "s", "en", None, f"word {i % 3}") for i in range(12)] + [("record", "none", "s", "en", None, None), ("record", "empty", "s", "en", None, "")]
    new = spark.createDataFrame([*rows, rows[0]], NEW)
    tok = token_budget.Tokenizer([("w", "o")])
    counts = []
    encoded = token_budget.encoded
    monkeypatch.setattr(token_budget, "encoded", lambda df, *a: counts.append(df.count()) or encoded(df, *a))
    ledger = token_budget.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.rows() is None and ledger.totals() is None
    ledger.update(new.where("id < '2'"), tok)
    seen = ledger.counts(tok).count()
    total = token_budget.Ledger(spark, str(tmp_path / "ledger")).update(new, tok)
    assert counts == [seen, 3 - seen] and [tuple(r) for r in total.collect()] == [("record", "s", "en", None, 14, 48)]
    got = token_budget.Ledger(spark, str(tmp_path / "ledger")).rows()
    assert sorted((r["id"], r["n_tokens"]) for r in got.collect()) == sorted([*((str(i), 4) for i in range(12)), ("none", 0), ("empty", 0)])
    token_budget.Ledger(spark, str(tmp_path / "ledger")).update(new, tok)
    assert counts[2] == 0


def test_another_tokenizer_counts_anew_and_what_vanishes_leaves(spark, tmp_path):
    new = spark.createDataFrame([("record", str(i), f"s{i % 2}", "en", None, "woo") for i in range(4)], NEW)
    ledger = token_budget.Ledger(spark, str(tmp_path / "ledger"))
    ledger.update(new, token_budget.Tokenizer([("w", "o")]))
    got = ledger.update(new.where("source = 's0'"), token_budget.Tokenizer([]))
    assert [tuple(r) for r in got.collect()] == [("record", "s0", "en", None, 2, 6)]
    assert ledger.versions() == [1, 2]
    assert ledger.update(new.limit(0), token_budget.Tokenizer([])).count() == 0


def test_totals_in_two_steps_with_withdrawn_rows(spark):
    tok = token_budget.Tokenizer.of(queries.table(spark, SF, "tok_merges"))
    new = token_budget.deliveries(*(queries.table(spark, SF, t) for t in ("records", "documents", "datasets"))).dropDuplicates(["kind", "id"])
    want = sorted(map(str, token_budget.budget(token_budget.encoded(new, tok)).collect()))
    assert sorted(map(str, queries.p4_token_budget(spark, SF).collect())) == want
    assert sorted(map(str, queries.p4_updated_budget(spark, SF).collect())) == want
