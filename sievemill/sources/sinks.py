"""Writers: JSON lines in order, one part per split and source, append, replace in one step, checksums, Markdown."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.sources.readers import ledger


def jsonl(df: DataFrame, path: str, order: list[str] | None = None, compression: str = "none") -> None:
    """UTF-8, nulls left out, each file in order; rows are range-partitioned first, so the files are too."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", True).option("compression", compression).json(path)


def csv(df: DataFrame, path: str, sep: str = ",", null: str = "\\N") -> None:
    """With a header, every field quoted, white space kept, and nulls told apart from empty texts."""
    w = df.write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').option("nullValue", null).option("emptyValue", "")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def corpus(records: DataFrame, path: str, clean: bool = False) -> None:
    """One folder per split and source. Only the partitions written are replaced, whatever the session's setting; clean=True replaces everything under
    the path."""
    out = records.repartition("split", "source", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "static" if clean else "dynamic")
    out.partitionBy("split", "source").json(path)


def append(predictions: DataFrame, path: str) -> None:
    """Columns that begin with an underscore are left out."""
    predictions.select(*(c for c in predictions.columns if not c.startswith("_"))).write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, there whole or not at all: written beside and renamed over in one step."""
    jvm, tmp = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    (src, fs), (dst, _) = _fs(spark, tmp), _fs(spark, path)
    out = fs.create(src, True)
    out.write(data)
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(src), fs.makeQualified(dst), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


POINTER = "_CURRENT"


def replace(df: DataFrame, path: str) -> None:
    """A new version of a table in a folder of its own; the pointer then moves to it in one step. A reader sees the old version or the new, and a
    failed write changes nothing. The version before stays for who reads it now, older ones go."""
    spark, before = df.sparkSession, read_text(df.sparkSession, f"{path}/{POINTER}")
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    write_text(spark, f"{path}/{POINTER}", name)
    p, fs = _fs(spark, path)
    for f in fs.listStatus(p):
        if f.getPath().getName().startswith("version-") and f.getPath().getName() not in (name, before):
            fs.delete(f.getPath(), True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that `replace` wrote last."""
    return spark.read.parquet(f"{path}/{read_text(spark, f'{path}/{POINTER}')}")


def sums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and name of the data files under a path."""
    return ledger(spark, path).where(~F.col("file").rlike(r"^[._]")).select("sha256", "file")


SUMS = "_SHA256SUMS"  # readers of the folder pass over it


def seal(spark: SparkSession, path: str) -> str:
    """Writes the checksums of the files under a path beside them, a line '<digest>  <name>' each in order of name, and gives the digest of that
    list. It has a line per file, so it is as long as a listing of the folder."""
    rows = sums(spark, path).orderBy("file").collect()
    text = "".join(f"{r['sha256']}  {r['file']}\n" for r in rows)
    write_text(spark, f"{path}/{SUMS}", text)
    return hashlib.sha256(text.encode()).hexdigest()


def broken(spark: SparkSession, path: str) -> DataFrame:
    """file and what is wrong ('missing', 'added', 'changed') with the files under a sealed path."""
    lines = [x.split("  ", 1) for x in (read_text(spark, f"{path}/{SUMS}") or "").splitlines()]
    listed = spark.createDataFrame([(f, h) for h, f in lines], "file string, listed string")
    found = sums(spark, path).where(F.col("file") != SUMS)
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "added").when(F.col("listed") != F.col("sha256"), "changed")
    return listed.join(found, "file", "full").select("file", problem.alias("problem")).where("problem IS NOT NULL")


def keyed(df: DataFrame, path: str, key: str) -> DataFrame:
    """df as stored under this key before, else computed and stored: a cache that outlives the session."""
    where = f"{path}/{key}"
    p, fs = _fs(df.sparkSession, f"{where}/_SUCCESS")
    if not fs.exists(p):
        df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def markdown(df: DataFrame, title: str) -> str:
    """A report table of an aggregated result. It is for people, so it takes a result of at most a few thousand rows."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a report table has at most 10,000 rows")
    cell = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
