"""Readers: Parquet, CSV, TSV, JSON lines plain or gzipped, JSON inside ZIP archives, class names in Parquet footers, lists in
YAML or JSON, and a ledger of the files read. Schemas are given, never inferred; each reader leaves out blank lines."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "") -> DataFrame:
    """Quoted fields may hold separators, quotes (doubled) and line ends. `null` is how a file writes a null; where that isn't
    the empty field, an empty field is the empty text."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("nullValue", null).option("emptyValue", "").csv(path)


def tsv(spark: SparkSession, path: str, schema: str, null: str = "") -> DataFrame:
    return csv(spark, path, schema, "\t", null)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; gzip by the file's ending."""
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str, schema: str, split: str, sources: list[str] | None = None) -> DataFrame:
    """One split of a corpus written by split and source, of some sources if given; folders of others aren't read."""
    df = spark.read.schema(f"{schema}, split string, source string").json(path).where(F.col("split") == split)
    return df.where(F.col("source").isin(*sources)) if sources is not None else df


def zipped_json(spark: SparkSession, path: str, schema: str, member: str = ".json") -> DataFrame:
    """The rows of every member whose name ends so: an array of objects, one object, or an object of objects. Archives are
    spread over tasks, one archive being read by one."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.endswith(member)):
                        data = json.loads(z.read(m))
                        rows = data if isinstance(data, list) else list(data.values()) if data and all(isinstance(v, dict) for v in data.values()) else [data]
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{m}"] * len(rows)), pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())], names=["file", "json"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, json string")
    return raw.select(F.from_json("json", schema).alias("r")).select("r.*")


def class_names(path: str, column: str) -> list[str]:
    """Names of a class-coded column from the Hugging Face entry of a Parquet footer; empty if there is none."""
    import pyarrow.parquet as pq

    meta = (pq.read_schema(path).metadata or {}).get(b"huggingface")
    feature = json.loads(meta)["info"]["features"].get(column, {}) if meta else {}
    return list(feature.get("names") or (feature.get("feature") or {}).get("names") or [])


def listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A hand-written list of entries by key, in YAML where its reader is installed or in JSON: {key: {field: value}}."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    rows = [json.dumps({"key": k, **v}, ensure_ascii=False, default=str) for k, v in data.items()]
    return spark.createDataFrame([(r,) for r in rows], "json string").select(F.from_json("json", schema).alias("r")).select("r.*")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, once its one file is known to have this digest."""
    got = [r["sha256"] for r in ledger(spark, path).select("sha256").limit(2).collect()]
    if got != [sha256]:
        raise ValueError(f"{path}: digest {got}, expected {sha256}")
    return path
