from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import arrays as A
from sievemill.functions import hashing as H
from sievemill.functions import text as X

TEXTS = [None, "", " ", "a\r\n\r\n\r\n\r\nb  c", " x　y z ", "ｗｉｄｅ ² ﬁne STRASSE straße", "é — café", "_under_score_", "句子A：你好！\n句子B：再见。", "a" * 50_000, "\n\n line \n\t two \n\n\n\n"]


def one(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_clean(spark):
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t or "").replace("\r", "")).strip() for t in TEXTS]
    assert one(spark, TEXTS, X.clean) == want


def test_clean_keep_lines(spark):
    def lines(t):
        t = unicodedata.normalize("NFC", t or "").replace("\r", "")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"\s+", " ", x).strip() for x in t.split("\n"))).strip()

    assert one(spark, TEXTS, X.clean_keep_lines) == [lines(t) for t in TEXTS]


def test_norm_key(spark):
    want = [re.sub(r"[\s\W_]+", "", unicodedata.normalize("NFKC", t or "").casefold()) for t in TEXTS]
    assert one(spark, TEXTS, X.norm_key) == want


def test_truncate_and_question(spark):
    assert one(spark, ["abcd", "abcde", None], lambda c: X.truncate(c, 4)) == ["abcd", "abc…", None]
    assert one(spark, ["is it so", "is it?? ", "", None], X.question_form) == ["Is it so?", "Is it?", "", None]


def test_uniform_matches_python(spark):
    keys = ["a", "b:c", "数", ""]
    want = [int.from_bytes(hashlib.sha256(f"split:{k}".encode()).digest()[:8], "big") / 2**64 for k in keys]
    assert one(spark, keys, lambda c: H.uniform("split", c)) == want
    assert one(spark, keys, lambda c: H.hash_split(c, 0.5, 0.25)) == ["test" if u < 0.5 else "dev" if u < 0.75 else "train" for u in want]


def arrays(spark, rows):
    return spark.createDataFrame(rows, "p array<double>, gold int, qtype string")


def test_scores_match_numpy(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(50):
        k = rnd.randint(2, 6)
        rows.append(([rnd.random() for _ in range(k)], rnd.randrange(k), "noul" if k == 2 else "choice"))
    rows.append(([0.0, 0.0], 1, "noul"))
    p = A.renormalised(F.col("p"))
    got = arrays(spark, rows).select(p.alias("out"), A.predicted(p, F.col("qtype")).alias("d"), A.brier(p, F.col("gold")).alias("b"), A.nll(p, F.col("gold")).alias("n")).collect()
    for (raw, gold, qtype), r in zip(rows, got):
        q = np.array(raw) / sum(raw) if sum(raw) > 0 else np.full(len(raw), 1 / len(raw))
        assert r["out"] == pytest.approx(q.tolist())
        assert r["d"] == (int(q[1] >= 0.5) if qtype == "noul" else int(q.argmax()))
        assert r["b"] == pytest.approx(((q - np.eye(len(q))[gold]) ** 2).sum())
        assert r["n"] == pytest.approx(-math.log(max(q[gold], 1e-6)))


def test_targets(spark):
    df = spark.createDataFrame([(2, 5), (0, 3), (1, 2)], "g int, k int")
    hot = [r[0] for r in df.select(A.onehot(F.col("g"), F.col("k"), 0.1)).collect()]
    assert hot[1] == pytest.approx([0.9 + 0.1 / 3, 0.1 / 3, 0.1 / 3])
    soft = [r[0] for r in df.select(A.ordinal(F.col("g"), F.col("k"))).collect()]
    assert soft[0] == pytest.approx([0, 0.1, 0.8, 0.1, 0]) and soft[1] == pytest.approx([0.8 / 0.9, 0.1 / 0.9, 0])


def test_level_and_softmax(spark):
    df = spark.createDataFrame([(0.99, 2), (1.0, 3), (0.4, 1), (None, 2)], "v double, c int")
    assert [r[0] for r in df.select(A.level(F.col("v"), F.col("c"))).collect()] == [4, 4, None, None]
    z = arrays(spark, [([1000.0, 1001.0], 0, "x")]).select(A.softmax(F.col("p"))).first()[0]
    assert z == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
