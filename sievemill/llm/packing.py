"""Items of varying length packed into containers of fixed capacity.

Bounded-space online packing: every partition keeps OPEN containers open, places each item best-fit among them, and emits
the fullest one when none fits. What is still open at a partition's end is merged afterwards: the leftover containers of up to
GROUP partitions are packed into each other, fullest first. An item longer than the capacity, and only such a one, is split
into full pieces and a rest; the rest is packed like an item.

Items arrive in the order of a hash of their id, so the result depends on neither file layout nor arrival. Null ids are out;
a null size counts as 0, and items of size 0 take no space but get a container. Repeated ids count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.session import stored

OPEN, GROUP = 128, 64
ITEMS = 200_000  #: about so many items share a partition


class Bounded:
    """The open containers of one capacity, as (space left, number) in ascending order."""

    def __init__(self, capacity: int, most: int | None):
        self.capacity, self.most, self.free, self.made = capacity, most, [], 0

    def place(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            left, k = self.free.pop(at)
        else:
            if self.most and len(self.free) >= self.most:
                self.free.pop(0)
            left, k = self.capacity, self.made
            self.made += 1
        insort(self.free, (left - size, k))
        return k


def _pack(batches):
    open_: dict[str, Bounded] = {}
    task = None
    for b in batches:
        where, kind, out = [], [], []
        if task is None:
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
        for spec, cap, size in zip(*(b[c].to_pylist() for c in ("spec_name", "capacity", "n"))):
            bins = open_.get(spec) or open_.setdefault(spec, Bounded(cap, OPEN))
            where.append(f"{spec}/{task}/{bins.place(size)}")
        kind = [False] * len(where)
        out = [b["spec_name"], b["capacity"], b["id"], b["piece"], b["n"], pa.array(where, pa.string()), pa.array(kind, pa.bool_())]
        yield pa.RecordBatch.from_arrays(out, names=_NAMES)
    left = [(spec, bins.capacity, bins.capacity - space, f"{spec}/{task}/{k}") for spec, bins in open_.items() for space, k in bins.free]
    if left:
        spec, cap, used, name = map(list, zip(*left))
        none = [None] * len(left)
        yield pa.RecordBatch.from_arrays([pa.array(spec), pa.array(cap, pa.int64()), pa.array(none, pa.string()), pa.array(none, pa.int32()), pa.array(used, pa.int64()), pa.array(name), pa.array([True] * len(left))], names=_NAMES)


_NAMES = ["spec_name", "capacity", "id", "piece", "n", "container", "left_open"]
_SCHEMA = "spec_name string, capacity long, id string, piece int, n long, container string, left_open boolean"


def _merge(batches):
    """Leftovers of one group in descending order of their size; each goes best-fit, without a bound on open ones."""
    open_: dict[tuple, tuple[Bounded, list[str]]] = {}
    for b in batches:
        to = []
        for spec, group, cap, used, name in zip(*(b[c].to_pylist() for c in ("spec_name", "group", "capacity", "n", "container"))):
            bins, names = open_.get((spec, group)) or open_.setdefault((spec, group), (Bounded(cap, None), []))
            k = bins.place(used)
            if k == len(names):
                names.append(name)
            to.append(names[k])
        yield pa.RecordBatch.from_arrays([b["container"], pa.array(to, pa.string())], names=["container", "final"])


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, id, piece, n, container for items (id string, n_tokens) and specs (spec_name, capacity_tokens)."""
    chosen = specs.where("spec_name IS NOT NULL AND capacity_tokens > 0").dropDuplicates(["spec_name"]).orderBy("spec_name").collect()  # one row per kind of container
    if not chosen:
        return items.sparkSession.createDataFrame([], "spec_name string, id string, piece int, n long, container string")
    items = items.where("id IS NOT NULL").select("id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("size")).dropDuplicates(["id"])
    spec = F.explode(F.array(*(F.struct(F.lit(r["spec_name"]).alias("spec_name"), F.lit(int(r["capacity_tokens"])).cast("long").alias("capacity")) for r in chosen)))
    each = items.select("id", "size", spec.alias("s")).select("id", "size", "s.*")
    full = F.floor(F.col("size") / F.col("capacity")).cast("int")
    long_ = each.where("size > capacity").select("spec_name", "id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("capacity").alias("n"))
    long_ = long_.withColumn("container", F.concat_ws("/", "spec_name", F.lit("whole"), "id", "piece"))
    rest = each.where("size <= capacity OR size % capacity > 0").select(
        "spec_name", "capacity", "id", F.when(F.col("size") > F.col("capacity"), full).otherwise(0).alias("piece"), F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")).alias("n")
    )
    parts = max(len(chosen), -(-items.count() * len(chosen) // ITEMS))
    placed = stored(rest.repartition(parts, F.pmod(F.xxhash64("id"), F.lit(max(1, parts // len(chosen)))), "spec_name").sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(_pack, _SCHEMA), "p6-placed")
    group = F.floor(F.split("container", "/")[F.size(F.split("container", "/")) - 2].cast("int") / GROUP).alias("group")
    left = placed.where("left_open").select("spec_name", group, "capacity", "n", "container")
    final = left.repartition(max(1, parts // GROUP), "spec_name", "group").sortWithinPartitions("spec_name", "group", F.desc("n"), "container").mapInArrow(_merge, "container string, final string")
    small = placed.where("NOT left_open").join(final, "container", "left").select("spec_name", "id", "piece", "n", F.coalesce("final", "container").alias("container"))
    return small.unionByName(long_)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind of container: how many, the tokens in them and the share of their space that stays unused."""
    per = packed.groupBy("spec_name", "container").agg(F.sum("n").alias("n")).groupBy("spec_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    out = per.join(specs.dropDuplicates(["spec_name"]), "spec_name")
    return out.select("spec_name", "capacity_tokens", "n_containers", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
