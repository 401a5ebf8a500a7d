from __future__ import annotations

import random

import pytest

from sievemill.llm import cosine_join, format_dups, lookalike
from sievemill.llm.letters import letters

SCHEMA = "id string, source string, split string, question string, options array<string>, context string, cid long, key string, norm string, n int"


def rows(spark, data):
    """Records with further columns whose names the operators use inside."""
    full = [(r.get("id"), r.get("source", "s"), r.get("split", "train"), r.get("question", "q"), r.get("options"), r.get("context"), 1, "k", "x", 2) for r in data]
    return spark.createDataFrame(full, SCHEMA)


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_distance_is_exact_up_to_the_bound():
    rnd = random.Random(1)
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 25)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 25)))
        d, most = distance(a, b), rnd.randint(0, 12)
        got = cosine_join.edit_distance(a, b, most)
        assert got == d if d <= most else got > most


def _sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def _edited(rnd, t, edits):
    t = list(t)
    for _ in range(edits):
        at = rnd.randrange(len(t))
        what = rnd.choice("ird")
        t[at : at + (what != "i")] = [] if what == "d" else [rnd.choice("abcdefghij")]
    return "".join(t)


def test_near_pairs_match_brute_force(spark):
    rnd = random.Random(7)
    data, train = [], []
    for i in range(60):
        t = _sentence(rnd, rnd.randint(10, 40))
        train.append(t)
        data.append({"id": f"s/train/{i}", "context": t})
    for i in range(40):
        t = rnd.choice(train)
        n = len(letters([t])[0])
        data.append({"id": f"s/{rnd.choice(['dev', 'test'])}/{i}", "split": rnd.choice(["dev", "test"]), "context": _edited(rnd, t, rnd.choice([0, 1, n // 30, n // 16, n // 5]))})
    data += [{"id": "s/dev/n", "split": "dev"}, {"id": None, "context": train[0]}, {"id": "s/dev/e", "split": "dev", "context": ""}, {"id": "s/x/1", "split": None, "context": train[0]}, data[3], data[70]]
    zh = "".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳") for _ in range(80))
    data += [{"id": "z/train/1", "context": zh}, {"id": "z/test/1", "split": "test", "context": zh[:40] + "换" + zh[42:]}]
    long_ = _sentence(rnd, 4000)
    data += [{"id": "l/train/1", "context": long_}, {"id": "l/test/1", "split": "test", "context": _edited(rnd, long_, 100)}]
    got = {tuple(r) for r in cosine_join.near_pairs(rows(spark, data)).select("id_eval", "id_train").distinct().collect()}
    want = set()
    texts = {d["id"]: (d.get("split", "train"), t) for d, t in zip(data, letters([d.get("context") for d in data])) if d["id"] and d.get("split", "train")}
    for a, (sa, x) in texts.items():
        for b, (sb, y) in texts.items():
            if sa != "train" and sb == "train" and min(len(x), len(y)) >= 40:
                most = max(len(x), len(y)) // 10
                if cosine_join.edit_distance(x, y, most) <= most:
                    want.add((a, b))
    assert ("l/test/1", "l/train/1") in want and ("z/test/1", "z/train/1") in want and len(want) > 20
    assert got == want


def test_texts_that_repeat_themselves_are_found(spark):
    texts = ["ab" * 300, "x" * 500, "哈" * 400, "abc" * 100, "ab" * 290, "x" * 44, "x" * 40]
    data = [{"id": f"s/{side}/{i}", "split": side, "context": t} for side in ("train", "test") for i, t in enumerate(texts)]
    got = {tuple(r) for r in cosine_join.near_pairs(rows(spark, data)).select("id_eval", "id_train").collect()}
    assert got == {(f"s/test/{i}", f"s/train/{j}") for i in range(7) for j in range(7) if i == j or {i, j} in ({0, 4}, {5, 6})}


def test_hot_terms_are_split_and_links_counted(spark, monkeypatch):
    """Most texts are made of the same phrases, so that hot terms must enter the lists."""
    rnd = random.Random(11)
    phrases = [_sentence(rnd, 4) for _ in range(2)]
    data = []
    for i in range(120):
        t = " ".join(rnd.choice(phrases) for _ in range(3)) + " " + _sentence(rnd, rnd.randint(0, 1))
        data.append({"id": f"s/{'train' if i % 3 else 'dev'}/{i}", "split": "train" if i % 3 else "dev", "context": _edited(rnd, t, rnd.randint(0, 3))})
    cut = []
    weights = cosine_join.weights
    monkeypatch.setattr(cosine_join, "weights", lambda classes, tenth, buckets: cut.append(weights(classes, tenth, 400)) or cut[0])
    df = rows(spark, data + data[:3])
    norm = dict(zip([d["id"] for d in data], letters([d["context"] for d in data])))
    want = set()
    for a in data[::3]:
        for b in data:
            x, y = norm[a["id"]], norm[b["id"]]
            most = max(len(x), len(y)) // 10
            if b["split"] == "train" and min(len(x), len(y)) >= 40 and cosine_join.edit_distance(x, y, most) <= most:
                want.add((a["id"], b["id"]))
    got = cosine_join.near_pairs(df).collect()
    assert cut[0][1].max() > 4
    assert {(r["id_eval"], r["id_train"]) for r in got} == want and len(want) > 100
    assert all(0 < r["cosine"] <= 1 for r in got)
    per = {r["id"]: (r["class_id"], r["n_links"]) for r in cosine_join.links(df).collect()}
    assert len(per) == 120 and all(per[i][0] == min(j for j in norm if norm[j] == norm[i] and j.split("/")[1] == i.split("/")[1]) for i in per)
    assert all(n == sum(i in p for p in want) for i, (_, n) in per.items())


def test_a_tenth_of_evenly_spaced_edits_is_found(spark):
    """Exactly as many edits as allowed, as far from each other as possible: no 12 letters in a row are left."""
    rnd = random.Random(5)
    data = []
    for i in range(200):
        n = rnd.randint(40, 400)
        for alphabet, source in (("abcdefghijklmnopqrstuvwxyz", "en"), ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳", "zh")):
            t = [rnd.choice(alphabet) for _ in range(n)]
            edited = list(t)
            for j in range(n // 10):
                edited[min((2 * j + 1) * n // (2 * (n // 10)), n - 1)] = "9"
            data += [{"id": f"{source}/train/{i}", "context": "".join(t)}, {"id": f"{source}/test/{i}", "split": "test", "context": "".join(edited)}]
    got = {tuple(r) for r in cosine_join.near_pairs(rows(spark, data)).select("id_eval", "id_train").collect()}
    assert got == {(f"{s}/test/{i}", f"{s}/train/{i}") for s in ("en", "zh") for i in range(200)}


@pytest.mark.parametrize(("low", "high"), [(40, 59), (60, 99), (100, 199), (200, 400)])
def test_a_tenth_of_edits_matches_brute_force(spark, low, high):
    """Per band of length, edits of a tenth and just over, at random places and evenly spaced."""
    rnd = random.Random(low)
    data = []
    for i in range(40):
        t = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(low, high)))
        k, n = len(t) // 10, len(t)
        even = list(t)
        for j in range(k):
            even[(2 * j + 1) * n // (2 * k)] = "9"
        # Insertions lengthen a text, and with it the bound; deletions do the opposite.
        longer = list(t)
        for at in sorted(rnd.sample(range(n), (n + n // 9) // 10), reverse=True):
            longer.insert(at, rnd.choice("0123456789"))
        shorter = [c for j, c in enumerate(t) if j not in set(range(n // (2 * k), n, n // k)[:k])]
        texts = [_edited(rnd, t, k), _edited(rnd, t, k), _edited(rnd, t, k + 1), "".join(even), "".join(longer), "".join(shorter)]
        data += [{"id": f"s/train/{i}", "context": t}, *({"id": f"s/test/{i}-{j}", "split": "test", "context": x} for j, x in enumerate(texts))]
    got = {tuple(r) for r in cosine_join.near_pairs(rows(spark, data)).select("id_eval", "id_train").collect()}
    want = set()
    for a in (d for d in data if d.get("split") == "test"):
        for b in (d for d in data if "split" not in d):
            x, y = a["context"], b["context"]
            most = max(len(x), len(y)) // 10
            if min(len(x), len(y)) >= 40 and cosine_join.edit_distance(x, y, most) <= most:
                want.add((a["id"], b["id"]))
    assert len(want) > 140
    assert got == want


def test_near_pairs_of_nothing(spark):
    assert cosine_join.near_pairs(rows(spark, [])).count() == 0
    assert cosine_join.near_pairs(rows(spark, [{"id": "a", "context": "x" * 50}])).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｗｉｄｅ", "wide", True),
        ("café", "café", True),
        ("ze​ro", "zero", True),
        ("a b", "a b", True),
        ("ае", "ae", True),
        ("ﬁne", "fine", True),
        ("⼦，", "子,", True),
        ("a\r\nb", "a\nb", True),
        ("A", "a", False),
        ("é", "e", False),
        ("m²", "m2", False),
        ("①", "1", False),
        ("a  b", "a b", False),
        ("！", "。", False),
        ("", "​", True),
    ],
)
def test_visible_form(a, b, same):
    assert (lookalike.form(a) == lookalike.form(b)) is same


def test_full_form_folds_case_and_compatibility():
    assert lookalike.form("Ｓtraße ① m²", False) == "strasse 1 m2"
    assert lookalike.form(None) is None and lookalike.form(None, False) is None


def test_alike_pairs(spark):
    data = [
        {"id": "a", "source": "s1", "context": "wide text", "options": ["x", None]},
        {"id": "b", "source": "s2", "context": "ｗide text", "options": ["x", None]},
        {"id": "c", "source": "s2", "context": "wide text", "options": ["x", None]},  # equal to a: no case with it
        {"id": "d", "source": "s3", "context": "wide text", "options": ["ｘ", None]},
        {"id": "e", "source": "s3", "context": "wide text", "options": ["x", ""]},
        {"id": "f", "source": "s3", "context": "wide text"},
        {"id": "g", "source": "s4"},
        {"id": "h", "source": "s5"},
        {"id": "i", "source": "s1", "split": "dev", "context": "ｗide text", "options": ["x", None]},
        {"id": None, "source": "s9", "context": "ｗide text", "options": ["x", None]},
        {"id": "j", "source": None, "context": "ｗide text", "options": ["x", None]},
        {"id": "k", "source": "s1", "options": ["ñ"]},
        {"id": "l", "source": "s2", "options": ["ñ"]},
    ]
    data.append(dict(data[1]))
    got = {tuple(r) for r in lookalike.alike_pairs(rows(spark, data)).collect()}
    # b and c share a source; a and c are written alike.
    assert got == {("a", "b"), ("a", "d"), ("b", "d"), ("c", "d"), ("k", "l")}
    assert lookalike.alike_pairs(rows(spark, [])).count() == 0


def test_consistent_form_keeps_nulls_and_ids(spark):
    got = {r["id"]: (r["context_form"], r["options_form"]) for r in lookalike.consistent(rows(spark, [{"id": "a", "context": "Ａ", "options": ["Ｂ", None]}, {"id": "a", "context": "Ａ", "options": ["Ｂ", None]}, {"id": "b"}])).collect()}
    assert got == {"a": ("a", ["b", None]), "b": (None, None)}


def test_consistent_form_keeps_records_without_id(spark):
    got = lookalike.consistent(rows(spark, [{"context": "Ａ"}, {"context": "Ｂ"}, {"context": "Ｂ"}, {"id": "a", "context": "Ｃ"}])).collect()
    assert sorted((r["id"] or "", r["context_form"]) for r in got) == [("", "a"), ("", "b"), ("", "b"), ("a", "c")]


LONG = "The quick brown fox jumps over the lazy dog, again and again."


def test_copies(spark):
    j1 = '{"title": "A story of some length to be sure", "keywords": ["One", "two"], "year": 1990}'
    j2 = '{\n "year": 1990.0, "keywords": ["one", "Two."],\n "title": "a STORY of some length, to be sure"}'
    j3 = '{"title": "A story of some length to be sure", "keywords": ["two", "One"], "year": 1990}'
    data = [
        {"id": "b", "context": LONG},
        {"id": "a", "context": LONG.upper().replace(" ", "  ")},
        {"id": "c", "context": "".join(ch for ch in LONG if ch.isalpha())},
        {"id": "d", "context": LONG, "question": "other"},
        {"id": "e", "context": LONG, "options": ["x"]},
        {"id": "f", "context": LONG, "source": "other"},
        {"id": "g", "context": "short"},
        {"id": "h", "context": "short"},
        {"id": "j1", "context": j1},
        {"id": "j2", "context": j2},
        {"id": "j3", "context": j3},
        {"id": "n1"},
        {"id": "n2"},
        {"id": None, "context": LONG},
        {"id": "q1", "context": LONG, "question": None, "source": None},
        {"id": "q2", "context": LONG.lower(), "question": None, "source": None},
        {"id": "s1", "context": LONG * 3000},
        {"id": "s2", "context": LONG.lower() * 3000},
        {"id": "bad", "context": "{" + LONG},
    ]
    data.append(dict(data[0]))
    got = {tuple(r) for r in format_dups.copies(rows(spark, data)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("bad", "b")} - {("bad", "b")} | {("j1", "j2"), ("q1", "q2"), ("s1", "s2"), *([("a", "bad")])}
    n = {r["keep_id"]: r["n_copies"] for r in format_dups.counted(rows(spark, data)).collect()}
    assert n == {"a": 4, "j1": 2, "q1": 2, "s1": 2}
    assert format_dups.copies(rows(spark, [])).count() == 0


def test_a_hot_key_goes_through_both_levels(spark):
    df = spark.range(30_000).selectExpr("concat('id', lpad(id, 6, '0')) AS id", "'s' AS source", "'train' AS split", "'q' AS question", "CAST(NULL AS ARRAY<STRING>) AS options", f"CASE WHEN id % 2 = 0 THEN '{LONG}' ELSE concat(id, '{LONG}') END AS context")
    got = format_dups.counted(df).collect()
    assert [(r["keep_id"], r["n_copies"]) for r in got] == [("id000000", 15_000)]
    assert format_dups.copies(df).count() == 14_999
