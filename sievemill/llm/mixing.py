"""Records of several sources mixed so that each source has its share of the whole in tokens.

The size of the whole is the largest at which the sources together fall short of their shares by at most `shortfall`, as a
source yields at most max_repeats times its tokens (sources without any record are left out of that sum), unless it is
given. Each source then has a budget. As many full passes over its records as the budget allows come first. For what remains its
records are counted by exact length; of every length the same fraction is taken, and of the budget then left the last part, a few times the longest
length, is filled by dynamic programming over the numbers still free of each length: the reachable sums are the bits of one integer, a length
with count c enters in powers of two up to c. Which records of a length are taken is decided by a seeded hash.

A group of one source and length may hold most of the rows: it is cut by hash into parts of about PART records, whole
parts are taken by their counts, and only one part is ranked. Records without tokens can't fill a budget and are out, as are
those whose language isn't the target's; a null language counts as the source's. Repeated ids count once. Targets without
records appear in the report with nothing reached; share_of_present is the target among those that have records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.llm.token_budget import Tokenizer, encoded, language
from sievemill.session import stored

PART = 50_000
REACH = 16  #: the dynamic programme fills so many times the longest length


def subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes close to the budget and never passes it. The longest are taken first until REACH times the
    longest one is left, so the table of reachable sums is as long as lengths are and not as the budget is; the rest is the largest sum reachable with what is
    free then."""
    take = [0] * len(lengths)
    room = REACH * max(lengths, default=0)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = min(counts[k], max(0, budget - room) // lengths[k])
        take[k] += n
        budget -= n * lengths[k]
    budget = min(budget, sum(size * (c - t) for size, c, t in zip(lengths, counts, take)))
    mask = (1 << budget + 1) - 1
    reach, steps = 1, []
    for k, (size, free) in enumerate(zip(lengths, counts)):
        free, lot = min(free - take[k], budget // size), 1
        while free > 0 and not reach >> budget & 1:
            lot = min(lot, free)
            steps.append((k, lot, reach))
            reach |= reach << size * lot & mask
            free -= lot
            lot *= 2
    at = reach.bit_length() - 1
    for k, lot, before in reversed(steps):
        if not before >> at & 1:
            take[k] += lot
            at -= lot * lengths[k]
    return take


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: source, lang, n_tokens, n, budget of one source; adds the full passes and the number to take once more."""
    rows = rows.sort_values("n_tokens", ignore_index=True)
    lengths, counts, budget = rows["n_tokens"].tolist(), rows["n"].tolist(), int(rows["budget"].iloc[0])
    total = sum(a * b for a, b in zip(lengths, counts))
    passes = min(budget // total, int(rows["max_repeats"].iloc[0]))
    left = budget - passes * total if passes < rows["max_repeats"].iloc[0] else 0
    take = [left * c // total for c in counts]
    left -= sum(a * b for a, b in zip(take, lengths))
    more = subset(lengths, [c - t for c, t in zip(counts, take)], left)
    rows["passes"], rows["extra"] = passes, [a + b for a, b in zip(take, more)]
    return rows[["source", "lang", "n_tokens", "n", "passes", "extra"]]


def whole(targets: list[tuple[float, int]], shortfall: float) -> int:
    """The largest size of the mixture, of (share, tokens at most) per source, by bisection."""
    there = [(s, c) for s, c in targets if s > 0 and c > 0]
    lo, hi = 0, sum(int(c / s) for s, c in there)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(max(0.0, s * mid - c) for s, c in there) <= shortfall * mid:
            lo = mid
        else:
            hi = mid - 1
    return lo


def mixture(records: DataFrame, targets: DataFrame, merges: DataFrame, size: int | None = None, shortfall: float = 0.02, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(id, source, lang, n_tokens, times) of the records used, and the report of shares per target."""
    spark = records.sparkSession
    targets = targets.where("source IS NOT NULL AND target_share IS NOT NULL").dropDuplicates(["source", "lang"])
    small = targets.select("source", F.col("lang").alias("own")).dropDuplicates(["source"])
    rows = records.where("id IS NOT NULL").select("id", "source", "lang", F.col("context").alias("text")).join(F.broadcast(small), "source")  # targets are a list written by hand
    rows = rows.select("id", "source", language(F.col("lang"), F.col("own")).alias("lang"), "text")
    rows = stored(encoded(rows, Tokenizer.of(merges)).where("n_tokens > 0").dropDuplicates(["id"]), "p3-rows")
    lengths = stored(rows.groupBy("source", "lang", "n_tokens").agg(F.count("*").alias("n")), "p3-lengths")
    have = lengths.groupBy("source", "lang").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n_records"))
    goal = targets.select("source", "lang", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).join(have, ["source", "lang"], "left")
    known = goal.collect()  # one row per target
    size = size if size is not None else whole([(r["target_share"], (r["tokens"] or 0) * r["max_repeats"]) for r in known], shortfall)
    plan = spark.createDataFrame([(r["source"], r["lang"], r["max_repeats"], min(int(r["target_share"] * size), (r["tokens"] or 0) * r["max_repeats"])) for r in known], "source string, lang string, max_repeats int, budget long")
    fitted = lengths.join(F.broadcast(plan), ["source", "lang"]).groupBy("source", "lang").applyInPandas(_fit, "source string, lang string, n_tokens long, n long, passes long, extra long")
    fitted = stored(fitted, "p3-plan")

    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1)
    cut = F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("long")
    parted = rows.join(fitted, ["source", "lang", "n_tokens"]).select(*rows.columns, "passes", "extra", u.alias("u"), F.floor(u / F.lit(2.0**63) * cut).alias("part"))
    once = parted.where("extra > 0")
    keys = ["source", "lang", "n_tokens"]
    sizes = once.groupBy(*keys, "part").agg(F.count("*").alias("in_part"))
    before = sizes.withColumn("before", F.sum("in_part").over(W.partitionBy(*keys).orderBy("part")) - F.col("in_part"))
    placed = once.join(before, [*keys, "part"])
    certain = placed.where("before + in_part <= extra").select("id")
    edge = placed.where("before < extra AND before + in_part > extra").withColumn("rn", F.row_number().over(W.partitionBy(*keys, "part").orderBy("u", "id"))).where("before + rn <= extra").select("id")
    extra = certain.unionByName(edge).withColumn("more", F.lit(1))
    used = parted.join(extra, "id", "left").select("id", "source", "lang", "n_tokens", (F.col("passes") + F.coalesce("more", F.lit(0))).cast("int").alias("times")).where("times > 0")

    got = fitted.groupBy("source", "lang").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("passes") + F.col("extra"))).alias("got"), F.sum(F.col("n") * F.col("passes") + F.col("extra")).alias("uses"))
    total = got.agg(F.sum("got").alias("total"))
    report = goal.join(got, ["source", "lang"], "left").crossJoin(F.broadcast(total))  # one row
    present = sum(r["target_share"] for r in known if r["tokens"])
    share = F.coalesce(F.col("got") / F.col("total"), F.lit(0.0))
    of_present = F.when(F.col("tokens") > 0, F.col("target_share") / F.lit(present or 1.0))
    return used, report.select("source", "lang", "target_share", of_present.alias("share_of_present"), share.alias("actual_share"), F.coalesce("got", F.lit(0)).alias("n_tokens"), F.coalesce("uses", F.lit(0)).alias("n_uses"), F.coalesce("n_records", F.lit(0)).alias("n_records"), "max_repeats")
