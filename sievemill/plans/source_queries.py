"""Sources and sinks: every table written in a format and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievemill.plans.registry import query
from sievemill.session import shared_dir
from sievemill.sources import readers, sinks


def _place(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT ord, source, split FROM records WHERE split = 'dev'")
def source_parquet(t):
    return readers.parquet(t.spark, f"{t.sf_dir}/records.parquet", ["ord", "source", "split"]).where("split = 'dev'")


@query("SELECT doc_id, text, lang FROM documents")
def source_csv(t):
    path = _place(t, "csv")
    sinks.csv(t.documents.select("doc_id", "text", "lang"), path)
    return readers.csv(t.spark, path, "doc_id long, text string, lang string", null="\\N")


@query("SELECT event_id, user_id, event_type, props FROM events")
def source_tsv(t):
    path = _place(t, "tsv")
    sinks.csv(t.events.select("event_id", "user_id", "event_type", "props"), path, "\t")
    return readers.tsv(t.spark, path, "event_id long, user_id long, event_type string, props string", null="\\N")


@query("SELECT ord, id, question, options, context, label FROM records")
def source_jsonl(t):
    path = _place(t, "jsonl")
    sinks.jsonl(t.records.select("ord", "id", "question", "options", "context", "label"), path, ["ord"])
    return readers.jsonl(t.spark, path, "ord long, id string, question string, options array<string>, context string, label int")


@query("SELECT message_id, parent_id, text, role FROM messages")
def source_jsonl_gz(t):
    path = _place(t, "jsonl-gz")
    sinks.jsonl(t.messages.select("message_id", "parent_id", "text", "role"), path, compression="gzip")
    return readers.jsonl(t.spark, path, "message_id string, parent_id string, text string, role string")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def source_nested_json(t):
    return t.events.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("SELECT source, split, count(*) AS n FROM records GROUP BY ALL")
def sink_partitioned(t):
    path = _place(t, "corpus")
    sinks.corpus(t.records, path)
    return t.spark.read.schema("id string, source string, split string").json(path).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT id, gold FROM predictions UNION ALL SELECT id, gold FROM predictions WHERE qtype = 'noul'")
def sink_append(t):
    path = _place(t, "preds")
    sinks.append(t.predictions.select("id", "gold", F.lit(1).alias("_drop")), path)
    sinks.append(t.predictions.where("qtype = 'noul'").select("id", "gold", F.lit(1).alias("_drop")), path)
    return t.spark.read.parquet(path)


@query("SELECT key, enabled FROM datasets WHERE enabled")
def sink_replace(t):
    path = _place(t, "replace")
    sinks.replace(t.datasets.select("key", "enabled"), path)
    sinks.replace(t.datasets.where("enabled").select("key", "enabled"), path)
    return sinks.current(t.spark, path)


@query("SELECT source, split, count(*) AS n FROM records WHERE split <> 'dev' OR source LIKE '%en' GROUP BY ALL")
def sink_partitions_kept(t):
    """The dev split written anew without the sources of one language: of it these go, all other partitions stay."""
    path = _place(t, "corpus")
    sinks.corpus(t.records, path)
    for s in ("train", "test"):
        sinks.corpus(t.records.where(F.col("split") == s), path)
    dev = readers.corpus(t.spark, path, "id string, ord long", "dev").where("source LIKE '%en'")
    again = _place(t, "corpus")
    sinks.corpus(dev, again)
    sinks.corpus(t.records.where("split <> 'dev'").select("id", "ord", "split", "source"), again)
    return t.spark.read.schema("id string, source string, split string").json(again).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT ord, id, source FROM records WHERE split = 'test' AND source IN (SELECT key FROM datasets WHERE role = 'eval_only')")
def source_split(t):
    """One split of some sources, read back from the corpus's folders."""
    path = _place(t, "corpus")
    sinks.corpus(t.records, path)
    only = [r["key"] for r in t.datasets.where("role = 'eval_only'").select("key").collect()]  # a list written by hand
    return readers.corpus(t.spark, path, "id string, ord long", "test", only).select("ord", "id", "source")


@query("SELECT unnest(['added', 'changed', 'missing']) AS problem, unnest([1, 1, 1]) AS n")
def sink_checksums(t):
    """A sealed folder of three files, of which one is then changed, one removed and one added."""
    path = _place(t, "sums")
    for name in ("a", "b", "c"):
        sinks.write_text(t.spark, f"{path}/{name}.txt", name)
    sinks.seal(t.spark, path)
    sound = sinks.broken(t.spark, path).count()
    sinks.write_text(t.spark, f"{path}/a.txt", "other")
    sinks.write_text(t.spark, f"{path}/d.txt", "d")
    p, fs = sinks._fs(t.spark, f"{path}/b.txt")
    fs.delete(p, False)
    return sinks.broken(t.spark, path).groupBy("problem").agg((F.count("*") + sound).cast("int").alias("n"))


@query("SELECT source, count(*) AS n FROM records GROUP BY source")
def sink_keyed(t):
    path = _place(t, "keyed")
    df = t.records.groupBy("source").agg(F.count("*").alias("n"))
    sinks.keyed(df, path, "a")
    return sinks.keyed(df, path, "a")


@query("SELECT f AS file, length(f) AS bytes, sha256(f) AS sha256 FROM (SELECT unnest(['first', 'second', '第三']) AS f)".replace("length(f)", "strlen(f)"))
def source_ledger(t):
    """Name, size and digest of files whose content is their name."""
    path = _place(t, "ledger")
    for name in ("first", "second", "第三"):
        sinks.write_text(t.spark, f"{path}/{name}", name)
    return readers.ledger(t.spark, path).where(~F.col("file").startswith("."))


@query("SELECT key, enabled, role FROM datasets")
def source_zip(t):
    """A hand-written list inside an archive, read back."""
    import io
    import json
    import zipfile

    rows = [r.asDict() for r in t.datasets.select("key", "enabled", "role").collect()]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("list.json", json.dumps(rows, ensure_ascii=False))
        z.writestr("readme.txt", "no rows")
    path = _place(t, "zip")
    sinks.write_bytes(t.spark, f"{path}/list.zip", data.getvalue())
    return readers.zipped_json(t.spark, path, "key string, enabled boolean, role string")


@query("SELECT key, license, lang FROM datasets")
def source_listing(t):
    """The same as a listing by key."""
    import json

    rows = {r["key"]: {"license": r["license"], "lang": r["lang"]} for r in t.datasets.collect()}
    path = _place(t, "listing")
    sinks.write_text(t.spark, f"{path}/list.json", json.dumps(rows, ensure_ascii=False))
    return readers.listing(t.spark, f"{path}/list.json", "key string, license string, lang string")


@query("SELECT item_id, q_native.question.instructions AS value FROM probe_items WHERE q_native.question.instructions IS NOT NULL UNION ALL SELECT item_id, q_en.question.instructions FROM probe_items WHERE q_en.question.instructions IS NOT NULL")
def nested_instructions(t):
    """Instructions at any depth of a JSON text."""
    from sievemill.operators.nested import instructions

    j = t.probe_items.select("item_id", F.to_json(F.struct("q_native", F.array("q_en").alias("more"))).alias("j"))
    return instructions(j, "j").select("item_id", "value")
