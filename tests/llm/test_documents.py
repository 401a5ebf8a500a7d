from __future__ import annotations

import random

import pytest

from sievemill.llm import fm_index, shared_spans
from sievemill.llm.letters import codes, letters

DOCS = "doc_id long, text string, cid long, run long, start int"
ITEMS = "item_id long, passage string, doc_id long"


def docs(spark, data):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], DOCS)


def covered(texts, passages):
    """By brute force: the letters of each text under a window of more than half of each passage."""
    out = {}
    for ti, t in enumerate(texts):
        for pi, p in enumerate(passages):
            k = len(p) // 2 + 1
            for j in range(len(p) - k + 1):
                at = t.find(p[j : j + k])
                while at >= 0:
                    out.setdefault((ti, pi), set()).update(range(at, at + k))
                    at = t.find(p[j : j + k], at + 1)
    return out


def test_suffix_array_is_exact():
    rnd = random.Random(3)
    for _ in range(40):
        text = codes("".join(rnd.choice("abc\0") for _ in range(rnd.choice([0, 1, 5, 30, 200]))) + "\0")
        index = fm_index.Index(text)
        s = index.symbols(text)
        bits = max(2, (len(index.alphabet) + 2).bit_length())
        assert fm_index.suffix_array(s, bits).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize(("short", "shard", "seed", "together"), [(64, 20, 1 << 12, 64), (0, 20, 1 << 12, 0), (3, 6, 4, 3), (0, 7, 1, 64)])
def test_leaks_match_brute_force(monkeypatch, short, shard, seed, together):
    """Also with tiny shards and blocks, so that texts and passages are longer than a shard."""
    for name, value in (("SHORT", short), ("SHARD_BITS", shard), ("SEED", seed), ("TOGETHER", together)):
        monkeypatch.setattr(fm_index, name, value)
    rnd = random.Random(short)
    for _ in range(60):
        alphabet = rnd.choice(["a", "ab", "abcdefgh"])
        make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
        passages = list({make(rnd.choice([1, 2, 5, 9, 30, 150])) for _ in range(6)})
        texts = [make(rnd.choice([0, 1, 5, 30, 60])) + rnd.choice(passages)[rnd.randint(0, 3) :] + make(rnd.choice([0, 7])) for _ in range(1 if shard < 20 else rnd.randint(1, 8))]
        phrases = [fm_index.Phrases(passages[:3], [0, 1, 2][: len(passages[:3])]), fm_index.Phrases(passages[3:], list(range(3, len(passages))))]
        got = {}
        for t, p, a, b in zip(*(x.tolist() for x in fm_index.leaks(texts, lambda: phrases))):
            assert not got.get((t, p), set()) & set(range(a, b))
            got.setdefault((t, p), set()).update(range(a, b))
        assert got == covered(texts, passages)


PASSAGE = "A passage of the evaluation set, which nobody should train on."


def test_leaked_spans(spark):
    data = [
        (1, "Before it. " + PASSAGE + " After it."),
        (2, "x" + PASSAGE[: len(PASSAGE) // 2 + 12].upper().replace(" ", "-") + "y"),
        (3, PASSAGE[:20]),
        (4, None),
        (5, ""),
        (None, PASSAGE),
        (6, "?!"),
        (7, PASSAGE + PASSAGE),
    ]
    data.append(data[0])
    items = spark.createDataFrame([(10, PASSAGE, 1), (11, PASSAGE, 1), (12, None, 1), (13, "", 1), (None, PASSAGE, 1), (14, "elsewhere altogether", 1)], ITEMS)
    spans = fm_index.leaked_spans(docs(spark, data), items)
    assert {(r["item_id"], r["doc_id"]) for r in spans.collect()} == {(i, d) for i in (10, 11) for d in (1, 2, 7)}
    cut = {(r["doc_id"], r["start"], r["stop"]) for r in fm_index.removal_spans(spans).collect()}
    n = len(letters([PASSAGE])[0])
    assert (1, 8, 8 + n) in cut and (7, 0, 2 * n) in cut
    assert fm_index.leaked_spans(docs(spark, []), items).count() == 0
    assert fm_index.leaked_spans(docs(spark, data), items.limit(0)).count() == 0


def test_a_text_longer_than_a_shard(spark):
    big = "abcdefghij" * 60_000
    data = [(1, big[:520_000] + PASSAGE + big + PASSAGE)]
    spans = fm_index.leaked_spans(docs(spark, data), spark.createDataFrame([(10, PASSAGE, 1)], ITEMS))
    n = len(letters([PASSAGE])[0])
    got = {(r["start"], r["stop"]) for r in fm_index.removal_spans(spans).collect()}
    assert got == {(520_000, 520_000 + n), (520_000 + n + 600_000, 520_000 + 2 * n + 600_000)}


def test_many_blocks_of_passages_and_one_longer_than_a_shard(spark, monkeypatch):
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    long_ = make((1 << 20) + 5)
    passages = {1: long_, 2: make(200), 3: make(50), 4: make(50)}
    monkeypatch.setattr(fm_index, "BLOCK", 60)
    data = [(1, make(99) + long_ + make(99)), (2, long_[300:] + passages[2]), (3, passages[3][:26] + "x" + passages[4][:25]), (4, long_[: (1 << 19) - 9])]
    items = spark.createDataFrame([(i, p, 1) for i, p in passages.items()] + [(5, passages[2].upper(), 1)], ITEMS)
    got = {(r["item_id"], r["doc_id"], r["start"], r["stop"]) for r in fm_index.leaked_spans(docs(spark, data), items).collect()}
    n = len(long_)
    assert got == {(1, 1, 99, 99 + n), (1, 2, 0, n - 300), (2, 2, n - 300, n - 100), (5, 2, n - 300, n - 100), (3, 3, 0, 26)}


def brute(texts, least):
    out = set()
    for a, x in texts.items():
        for b, y in texts.items():
            if a < b and x and y and {x[i : i + least] for i in range(len(x) - least + 1)} & {y[i : i + least] for i in range(len(y) - least + 1)}:
                out.add((a, b))
    return out


@pytest.mark.parametrize("alphabet", ["abcdefghij klmno.", "ab", "abc .", "。一二三四五", "a"])
def test_sharing_pairs_match_brute_force(spark, alphabet):
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = {i: make(rnd.randint(150, 700)) for i in range(20)}
    for i in range(20, 60):
        s = texts[rnd.randrange(20)]
        at, n = rnd.randint(0, max(0, len(s) - 150)), rnd.randint(180, 260)
        texts[i] = make(rnd.randint(0, 200)) + s[at : at + n] + make(rnd.randint(0, 200))
    texts |= {60: None, 61: "", 62: texts[0], 63: texts[0]}
    data = [*texts.items(), (None, texts[0]), (3, texts[3])]
    got = [tuple(r) for r in shared_spans.sharing_pairs(docs(spark, data)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 200)


@pytest.mark.parametrize("stock", [165, 185, 199, 200, 230])
def test_hot_runs_are_refined(spark, monkeypatch, stock):
    monkeypatch.setattr(shared_spans, "HOT", 5)
    rnd = random.Random(stock)
    make = lambda n: "".join(rnd.choice("abcdefgh .") for _ in range(n))
    phrase = make(stock)
    texts = {i: make(rnd.randint(20, 90)) + phrase + make(rnd.randint(30, 90)) for i in range(30)}
    texts |= {30 + i: make(20) + phrase + texts[i][-60:] for i in range(10)}
    df = docs(spark, list(texts.items()))
    runs = df.selectExpr("doc_id AS cid", "text").mapInArrow(shared_spans._runs(200), "run long, cid long").groupBy("run").count()
    assert stock < 199 or runs.where("count > 5").count()
    got = {tuple(r) for r in shared_spans.sharing_pairs(df).collect()}
    assert got == brute(texts, 200) and (stock < 200 or len(got) == 40 * 39 // 2)


def test_every_shared_stretch_holds_a_run():
    """A stretch of LEAST characters has a run in common wherever it stands."""
    import numpy as np

    rnd = random.Random(2)
    for trial in range(150):
        alphabet = rnd.choice(["abcdefghij klmno.", "ab", "abc .", "。一二三四五", "a", "..a"])
        make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))  # noqa: E731, B023
        stretch, hashes = make(200), []
        for _ in range(2):
            text = make(rnd.choice([0, 1, 70])) + stretch + make(rnd.choice([0, 1, 70]))
            a = codes(text)
            begin, end, h = shared_spans.runs_of(a, np.array([0]), np.array([len(a)]), 200, {})
            assert all(129 <= e - b < 161 for b, e in zip(begin, end))
            hashes.append(set(h.tolist()))
        assert hashes[0] & hashes[1], trial


def brute_windows(texts, least):
    """Per document the windows that stand in another one, and those that stand in a smaller one."""
    where = {}
    for d, t in texts.items():
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = {}
    for d, t in texts.items():
        shared = [i for i in range(len(t or "") - least + 1) if len(where[t[i : i + least]]) > 1]
        out[d] = shared, [i for i in shared if min(where[t[i : i + least]]) < d]
    return out


def joined(places, least):
    out = []
    for i in places:
        if out and i <= out[-1][1]:
            out[-1][1] = i + least
        else:
            out.append([i, i + least])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("alphabet", ["abcdefghij klmno.", "ab.", "a"])
def test_spans_shares_and_links_match_brute_force(spark, alphabet):
    rnd = random.Random(len(alphabet))
    make = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = {i: make(rnd.randint(150, 600)) for i in range(12)}
    for i in range(12, 40):
        s = texts[rnd.randrange(12)]
        at = rnd.randint(0, max(0, len(s) - 200))
        texts[i] = make(rnd.randint(0, 150)) + s[at : at + rnd.randint(190, 400)] + make(rnd.randint(0, 150)) + (s[:230] if i % 3 == 0 else "")
    texts |= {50: texts[13], 51: None, 52: "", 53: texts[0]}
    df = docs(spark, [*texts.items(), (None, texts[0]), (13, texts[13])])
    want = brute_windows(texts, 200)
    spans = {}
    for r in shared_spans.spans(df).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    assert {d: sorted(s) for d, s in spans.items()} == {d: joined(w, 200) for d, (w, _) in want.items() if w}
    got = {r["doc_id"]: tuple(r)[1:] for r in shared_spans.shares(df).collect()}
    size = lambda places: sum(b - a for a, b in joined(places, 200))
    assert got == {d: (len(texts[d]), size(w), size(late)) for d, (w, late) in want.items() if w}
    kept = {r["doc_id"]: r["text_kept"] for r in shared_spans.deduplicated(df).collect()}
    cut = {d: "" if min(e for e in texts if texts[e] == texts[d]) < d else shared_spans.without(texts[d], joined(late, 200)) for d, (_, late) in want.items() if late}
    assert kept == {d: t for d, t in cut.items() if t != texts[d]}
    pairs = brute(texts, 200)
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in shared_spans.links(df).collect()}
    assert links == {d: (min(e for e in texts if texts[e] == t), sum(d in p for p in pairs)) for d, t in texts.items() if t and len(t) >= 200}


def test_sentences_under_spans_go():
    assert shared_spans.without("One. Two!? Three", [(4, 10)]) == "One. Three"
    assert shared_spans.without("One. Two!? Three", [(5, 16)]) == "One. Two!?"
    assert shared_spans.without("One. Two", [(0, 2), (2, 4)]) == " Two"
    assert shared_spans.without("", []) == ""


def test_shares(spark):
    rnd = random.Random(9)
    a, b, c = ("".join(rnd.choice("abcdefgh .") for _ in range(300)) for _ in range(3))
    got = {r["doc_id"]: tuple(r)[1:] for r in shared_spans.shares(docs(spark, [(1, a + b), (2, c + b), (3, c), (4, c), (5, "short"), (6, None)])).collect()}
    assert got[1] == (600, 300, 0) and got[2] == (600, 600, 300)
    assert got[3] == (300, 300, 300) and got[4] == (300, 300, 300) and set(got) == {1, 2, 3, 4}
    for f in (shared_spans.shares, shared_spans.spans, shared_spans.links, shared_spans.deduplicated):
        assert f(docs(spark, [])).count() == 0
