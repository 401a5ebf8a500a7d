from __future__ import annotations

import gzip
import hashlib
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievemill.sources import convert, readers, sinks
from sievemill.streaming import incremental


def test_text_formats(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nof two lines '), (2, None), (3, ""), (4, "\ttab")]
    df = spark.createDataFrame(rows, "i int, t string")
    for sep in (",", "\t"):
        path = f"{tmp_path}/csv{ord(sep)}"
        sinks.csv(df, path, sep)
        assert sorted(map(tuple, readers.csv(spark, path, "i int, t string", sep, "\\N").collect())) == rows
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"i": 1, "t": "x"}\n\n{"i": 2}\n')
    assert sorted(map(tuple, readers.jsonl(spark, f"{tmp_path}/x.jsonl.gz", "i int, t string").where("i IS NOT NULL").collect())) == [(1, "x"), (2, None)]


def test_zip_footer_listing_ledger(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.json", json.dumps([{"i": 1}, {"i": 2}]))
        z.writestr("b.json", json.dumps({"k": {"i": 3}, "l": {"i": 4}}))
        z.writestr("c.json", json.dumps({"i": 5}))
        z.writestr("d.txt", "no")
    assert sorted(r["i"] for r in readers.zipped_json(spark, f"{tmp_path}/d.zip", "i int").collect()) == [1, 2, 3, 4, 5]
    meta = {"huggingface": json.dumps({"info": {"features": {"label": {"names": ["no", "yes"]}}}})}
    pq.write_table(pa.table({"label": [0, 1]}).replace_schema_metadata(meta), tmp_path / "f.parquet")
    assert readers.class_names(f"{tmp_path}/f.parquet", "label") == ["no", "yes"] and readers.class_names(f"{tmp_path}/f.parquet", "other") == []
    (tmp_path / "l.json").write_text(json.dumps({"a": {"enabled": True}, "b": {"enabled": False}}))
    assert sorted(map(tuple, readers.listing(spark, f"{tmp_path}/l.json", "key string, enabled boolean").collect())) == [("a", True), ("b", False)]
    h = hashlib.sha256((tmp_path / "d.zip").read_bytes()).hexdigest()
    assert readers.checked(spark, f"{tmp_path}/d.zip", h).endswith("d.zip")
    with pytest.raises(ValueError, match="digest"):
        readers.checked(spark, f"{tmp_path}/d.zip", "0" * 64)


def test_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 2 = 0 THEN 'train' ELSE 'test' END AS split", "'s' AS source", "id AS _x")
    sinks.corpus(df, f"{tmp_path}/c")
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    sinks.corpus(df.where("split = 'test'").limit(2), f"{tmp_path}/c")
    assert readers.corpus(spark, f"{tmp_path}/c", "id string", "test").count() == 2 and readers.corpus(spark, f"{tmp_path}/c", "id string", "train", ["s"]).count() == 50
    sinks.corpus(df.where("split = 'test'"), f"{tmp_path}/c", clean=True)
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"split=test"}
    for n in (100, 3, 2, 1):
        sinks.replace(df.limit(n), f"{tmp_path}/r")
        assert sinks.current(spark, f"{tmp_path}/r").count() == n
    with pytest.raises(Exception, match="odd"):
        sinks.replace(df.withColumn("id", F.raise_error(F.lit("odd"))), f"{tmp_path}/r")
    assert sinks.current(spark, f"{tmp_path}/r").count() == 1
    sinks.append(df, f"{tmp_path}/a")
    assert "_x" not in spark.read.parquet(f"{tmp_path}/a").columns
    calls = sinks.keyed(df, f"{tmp_path}/k", "one").count(), sinks.keyed(df.limit(1), f"{tmp_path}/k", "one").count()
    assert calls == (100, 100)
    sinks.jsonl(df.selectExpr("CAST(id AS INT) AS id"), f"{tmp_path}/j", ["id"])
    lines = [json.loads(x)["id"] for p in sorted((tmp_path / "j").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == list(range(100)) and sinks.sums(spark, f"{tmp_path}/j").count() > 0
    assert "| 1 |" in sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string"), "T")


def build(spark, spec, rows, schema):
    return {r["id"]: r for r in convert.convert(spec, spark.createDataFrame(rows, schema + ", split string, row string")).collect()}


def test_pair_and_passage(spark):
    s = convert.declared("p", "zh", "pair", {"a": "a", "b": "b", "label": "y"}, questions=("同义吗？",))
    got = build(spark, s, [("一", "二", "1", "train", "1"), ("一", " ", "1", "train", "2"), ("一", "二", "x", "train", "3"), (None, None, None, None, None)], "a string, b string, y string")
    assert set(got) == {"p/train/1"} and got["p/train/1"]["context"] == "句子A：一\n句子B：二" and got["p/train/1"]["units"] == ["一", "二"]
    s = convert.declared("b", "en", "passage", {"text": "t", "question": "q", "label": "y"})
    got = build(spark, s, [("T", "is it", True, "test", "1"), ("T", "is it", None, "test", "2")], "t string, q string, y boolean")
    assert got["b/test/1"]["question"] == "Is it?" and len(got) == 1


def test_labelled_branches(spark):
    names = tuple(f"n{i}" for i in range(15))
    s = convert.declared("l", "en", "labelled", {"text": "t", "label": "y"}, names, full=0.3, subset=0.3)
    got = build(spark, s, [(f"t{i}", str(i % 15) if i % 2 else f"n{i % 15}", "test" if i < 10 else "train", str(i)) for i in range(300)], "t string, y string")
    assert len(got) == 300
    kinds = {"full": 0, "some": 0, "noul": 0}
    for k, r in got.items():
        i = int(k.rsplit("/", 1)[1])
        if r["type"] == "choice":
            assert r["options"][r["label"]] == f"n{i % 15}" and len(set(r["options"])) == len(r["options"])
            kinds["full" if len(r["options"]) == 15 else "some"] += 1
            assert r["split"] != "test" or len(r["options"]) == 15
        else:
            kinds["noul"] += 1
            assert (r["view"]["arg"] == f"n{i % 15}") == bool(r["label"]) and r["view"]["arg"] in r["question"]
    assert min(kinds.values()) > 50


def test_other_shapes(spark):
    s = convert.declared("m", "en", "multiple_choice", {"question": "q", "options": "o", "label": "y"})
    got = build(spark, s, [("q", ["a", "b"], "B", "test", "1"), ("q", ["a", "b"], "1", "test", "2"), ("q", ["a", "a"], "A", "test", "3"), ("q", ["a", "b"], "9", "test", "4"), ("q", ["one", "two"], "two", "test", "5")], "q string, o array<string>, y string")
    assert {k: r["label"] for k, r in got.items()} == {"m/test/1": 1, "m/test/2": 0, "m/test/5": 1}
    s = convert.declared("c", "en", "binned", {"text": "t", "number": "x"}, ("a", "b", "c", "d", "e"), edges=(0.1, 0.3, 0.5, 0.8))
    got = build(spark, s, [("t", x, "test", str(i)) for i, x in enumerate([0.0, 0.1, 0.29, 0.5, 0.8, None])], "t string, x double")
    assert [got[f"c/test/{i}"]["label"] for i in range(5)] == [0, 1, 1, 3, 4] and len(got) == 5
    s = convert.declared("n", "en", "nli", {"a": "a", "b": "b", "label": "y"}, ("e", "n", "c"), full=0.5)
    got = build(spark, s, [("p", "h", i % 4, "train", str(i)) for i in range(80)], "a string, b string, y int")
    assert len(got) == 60 and {r["type"] for r in got.values()} == {"choice", "noul"}
    s = convert.declared("r", "en", "rated", {"prompt": "p", "reply": "r", "value": "v", "count": "c"}, ("0", "1", "2", "3", "4"), cuts=(5, 5))
    got = build(spark, s, [("prompt", "reply", 0.99, 2, "train", "1"), ("prompt", "reply", 0.5, 1, "train", "2")], "p string, r string, v double, c int")
    assert len(got) == 1 and got["r/train/1"]["context"] == "User: prom…\n\nAssistant: reply" and got["r/train/1"]["label"] == 4


def test_answers_by_number_key_and_column(spark):
    s = convert.declared("x", "zh", "multiple_choice", {"question": "q", "label": "y"}, choices=("a", "b"), base=0)
    got = build(spark, s, [("q", "one", "two", 0, "test", "1"), ("q", "one", "two", 1, "test", "2"), ("q", "one", "two", 2, "test", "3"), ("q", "one", None, 0, "test", "4")], "q string, a string, b string, y int")
    assert {k: (r["label"], r["options"]) for k, r in got.items()} == {"x/test/1": (0, ["one", "two"]), "x/test/2": (1, ["one", "two"])}
    s = convert.declared("k", "en", "multiple_choice", {"question": "q", "options": "c.text", "keys": "c.label", "label": "y"})
    got = build(spark, s, [("q", (["X", "Y"], ["one", "two"]), "Y", "test", "1")], "q string, c struct<label: array<string>, text: array<string>>, y string")
    assert got["k/test/1"]["label"] == 1 and got["k/test/1"]["options"] == ["one", "two"]


def test_ratings_on_their_own_scale_and_skew(spark):
    s = convert.declared("h", "en", "rated", {"prompt": "p", "reply": "r"}, ("0", "1", "2", "3", "4"), second=("a", "b"), scale=(0.0, 4.0), first=1.0, question="By {}?")
    got = build(spark, s, [("p", "r", x, None, "train", str(x)) for x in range(5)] + [("p", "r", None, 3, "train", "b"), ("p", "r", None, None, "train", "none")], "p string, r string, a int, b int")
    assert {k: r["label"] for k, r in got.items()} == {**{f"h/train/{x}": x for x in range(5)}, "h/train/b": 3} and got["h/train/b"]["question"] == "By b?"
    s = convert.declared("o", "en", "rated", {"prompt": "p", "reply": "r", "ratings": "x", "group": "g"}, ("0", "1"), second=("a", "b", "c"), extras=True)
    x = lambda b: [("a", 0.1, 2), ("b", b, 2), ("c", 0.2, 2), ("d", 0.1, 9)]
    got = build(spark, s, [("p", "r", x(0.9 if i else 0.1), "tree", "train" if i < 9 else "test", str(i)) for i in range(10)], "p string, r string, x array<struct<name: string, value: double, count: int>>, g string")
    # Nearly all of b's ratings are of the top level, so it isn't among the further attributes.
    assert set(got) == {f"o/train/{i}{t}" for i in range(9) for t in ("", "/c")} | {"o/test/9"}
    assert got["o/train/1"]["grp"] == "tree" and got["o/test/9"]["grp"] is None


def test_names_samples_and_bins(spark):
    with pytest.raises(ValueError, match="names"):
        build(spark, next(s for s in convert.SOURCES if s.source == "banking77_en"), [("t", "1", "train", "1")], "text string, label string")
    s = convert.named(convert.declared("l", "en", "labelled", {"text": "t", "label": "y"}, sample={"train": 7}), ("a", "b"))
    got = build(spark, s, [(f"t{i}", "ab"[i % 2], "train" if i < 20 else "test", str(i)) for i in range(25)], "t string, y string")
    assert sum("train" in k for k in got) == 7 and sum("test" in k for k in got) == 5
    s = convert.declared("c", "en", "binned", {"text": "t", "number": "x"}, ("low", "high"), edges=(0.5,), per_bin={"train": 3}, cuts=(2, 4))
    got = build(spark, s, [("t" * (1 + i % 2 + i % 3), i / 30, "train", str(i)) for i in range(30)], "t string, x double")
    assert 0 < len(got) <= 6 and all(2 <= len(r["context"]) <= 4 for r in got.values())


def test_declared_sources_are_well_formed():
    assert len({s.source for s in convert.SOURCES}) == len(convert.SOURCES) == 27
    assert all(s.shape in convert.SHAPES for s in convert.SOURCES)


@pytest.mark.parametrize("source", [s.source for s in convert.SOURCES])
def test_every_declared_source_converts(spark, source):
    """Rows with just the declared columns give records, whatever the branch."""
    s = next(x for x in convert.SOURCES if x.source == source)
    if s.shape in ("labelled", "intents", "dialogue", "topical", "paper", "emotions"):
        s = convert.named(s, tuple(f"n{i}" for i in range(14)), ("s1", "s2", "s3", "s4", "s5"))
    kinds = {"label": "string", "labels": "array<string>", "second": "string", "domains": "array<string>", "slots": "array<string>", "keywords": "array<string>", "ratings": "array<struct<name: string, value: double, count: int>>", "number": "double"}
    cell = {"label": lambda i: "1", "labels": lambda i: ["n1"], "second": lambda i: "s1", "domains": lambda i: ["n1"], "slots": lambda i: ["s1"] if i % 2 else [], "keywords": lambda i: [f"k{i % 3}"], "ratings": lambda i: [("quality", 0.5, 2), ("humor", 0.3, 3)], "number": lambda i: i / 40}
    roles = {r: c for r, c in s.columns.items() if "." not in c}
    schema = [f"`{c}` {kinds.get(r, 'string')}" for r, c in roles.items()] + [f"`{c}` string" for c in s.choices]
    row = lambda i: [cell.get(r, lambda i: f"the text of {r} no {i}")(i) for r in roles] + [f"{c}{i}" for c in s.choices]
    if any("." in c for c in s.columns.values()):
        schema.append("choices struct<label: array<string>, text: array<string>>")
    if s.shape == "passage":
        schema = [x.replace("`answer` string", "`answer` boolean") for x in schema]
    if s.shape == "rated" and "ratings" not in s.columns:
        schema += [f"`{a}` int" for a in s.second]
    rows = []
    for i in range(24):
        r = row(i)
        if s.shape == "passage":
            r = [True if c == "answer" else v for c, v in zip(roles.values(), r)]
        if any("." in c for c in s.columns.values()):
            r.append((["0", "1"], [f"a{i}", f"b{i}"]))
        if s.shape == "rated" and "ratings" not in s.columns:
            r += [i % 5] * len(s.second)
        rows.append((*r, ("train", "dev", "test")[i % 3], str(i)))
    got = convert.convert(s, spark.createDataFrame(rows, ", ".join([*schema, "split string", "row string"]))).collect()
    assert got and all(r["id"].startswith(s.source) and (r["options"] is None or 0 <= r["label"] < len(r["options"])) for r in got)


def test_stream_drops_copies_and_leaks(spark, tmp_path):
    cols = "id string, source string, split string, question string, options array<string>, context string, loaded_at timestamp"
    rows = [(str(i), "s", "train", "q", None, f"some long context {i % 5}", None) for i in range(20)]
    df = spark.createDataFrame(rows, cols).selectExpr("id", "source", "split", "question", "options", "context", "TIMESTAMP '2026-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS loaded_at")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = incremental.records_stream(spark, f"{tmp_path}/in", df.schema, 1)
    incremental.run_once(incremental.dedup(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    units = spark.createDataFrame([("somelongcontext3",)], "unit string")
    incremental.run_once(incremental.without_leaks(incremental.records_stream(spark, f"{tmp_path}/in", df.schema), units), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 16
