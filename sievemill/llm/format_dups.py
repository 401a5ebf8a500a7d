"""Records that differ only in the formatting of their context, collapsed into one each, with the number of copies.

The canonical key of a record is a 128-bit hash of source, split, question, options and the letters and digits of the
context. A context that is a JSON object enters as its fields sorted by name, string values as their letters and digits.

Hot keys are found exactly from partial counts. Fewer than HOT keys can be hot, so their table is broadcast, and their rows are parted from
the others before anything is shuffled by key: they are salted into a two-level aggregation, all others take one shuffle. The
representative is the smallest id.

Nulls in source, split, question or options are values of their own; records without id or context, and those whose
context has too few letters and digits, stand for themselves and form no group. Repeated ids count once.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.letters import letters
from sievemill.session import stored

HOT = 500  #: a key is hot if it holds more than 1/HOT of the rows


def _object(text: str) -> dict | None:
    if text.lstrip()[:1] != "{":
        return None
    try:
        out = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _texts(x, out: list[str]) -> None:
    if isinstance(x, str):
        out.append(x)
    elif isinstance(x, dict):
        for k in sorted(x):
            _texts(x[k], out)
    elif isinstance(x, list):
        for v in x:
            _texts(v, out)


def _shape(x, of) -> object:
    if isinstance(x, str):
        return next(of)
    if isinstance(x, dict):
        return {k: _shape(x[k], of) for k in sorted(x)}
    if isinstance(x, list):
        return [_shape(v, of) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def canonical(texts: list[str]) -> tuple[list[str], list[int]]:
    """The comparable form of each text and how many letters and digits it has."""
    plain = letters(texts)
    size = [len(t) for t in plain]
    for i, t in enumerate(texts):
        if (d := _object(t)) is not None:
            values: list[str] = []
            _texts(d, values)
            plain[i] = "{" + json.dumps(_shape(d, iter(letters(values))), ensure_ascii=False, sort_keys=True)
            size[i] = len(letters([plain[i]])[0])
    return plain, size


def _keyed(least: int):
    def run(batches):
        for b in batches:
            form, size = canonical(b["context"].to_pylist())
            keep = [i for i, n in enumerate(size) if n >= least]
            rest = b.select(["source", "split", "question", "options"]).to_pylist()
            keys = [hashlib.blake2b(repr((*rest[i].values(), form[i])).encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in keep]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep, pa.int32())), pa.array(keys, pa.binary())], names=["id", "key"])

    return run


SALTS = 64


def groups(records: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, id) of all records that take part; the hot keys; (key, keep_id, n, hot) of every group of two or more ids."""
    rows = records.select("id", "source", "split", "question", "options", "context").where("id IS NOT NULL AND context IS NOT NULL")
    keyed = stored(rows.mapInArrow(_keyed(least), "id string, key binary").distinct(), "p5-keys")
    total = keyed.count()  # from the footers of what was just written
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > total // HOT).where("n > 1").select("key"), "p5-hot")
    salted = keyed.join(F.broadcast(hot), "key", "left_semi").groupBy("key", (F.crc32("id") % SALTS).alias("salt")).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    two = salted.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).withColumn("hot", F.lit(True))
    one = keyed.join(F.broadcast(hot), "key", "left_anti").groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").withColumn("hot", F.lit(False))
    return keyed, hot, two.unionByName(one)


def copies(records: DataFrame, least: int = 40) -> DataFrame:
    """keep_id and copy_id: one row for each id of a group but the smallest."""
    keyed, hot, found = groups(records, least)
    found = stored(found, "p5-groups")
    parts = [keyed.join(F.broadcast(found.where("hot").select("key", "keep_id")), "key"), keyed.join(F.broadcast(hot), "key", "left_anti").join(found.where("NOT hot").select("key", "keep_id"), "key")]
    return parts[0].unionByName(parts[1]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def counted(records: DataFrame, least: int = 40) -> DataFrame:
    """keep_id and n_copies of every group of two or more ids."""
    return groups(records, least)[2].select("keep_id", F.col("n").alias("n_copies"))
