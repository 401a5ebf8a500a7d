"""Deterministic samples: every choice follows the order of a seeded digest, so a larger sample contains a smaller one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.functions.hashing import digest, uniform

BUCKETS = 4096


def sample(df: DataFrame, n: int, key: Column, *salt: str) -> DataFrame:
    """n rows by digest: a distributed top-n."""
    return df.withColumn("_h", digest(*salt, key)).orderBy("_h").limit(n).drop("_h")


def sample_per(df: DataFrame, n: int, by: list[str], key: Column, *salt: str) -> DataFrame:
    """At most n rows of each group by digest. Spark keeps n per group and task before the shuffle, so a hot group is small
    by then. Rows with a null in `by` are a group of their own."""
    w = W.partitionBy(*by).orderBy(digest(*salt, key), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def balanced(df: DataFrame, n: int, by: list[str], key: Column, *salt: str, strict: bool = False) -> DataFrame:
    """Exactly n rows of each class; classes with fewer are left out, or end the query with an error if strict."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    if strict:
        ok = F.when(F.col("_n") >= n, True).otherwise(F.raise_error(F.concat(F.lit("class too small: "), F.concat_ws("/", *by))).cast("boolean"))
    else:
        ok = F.col("_n") >= n
    return sample_per(df.join(sizes.where(ok).select(*by), by, "left_semi"), n, by, key, *salt)


def take_until(groups: DataFrame, n: int, key: str = "key", size: str = "size", *salt: str) -> DataFrame:
    """Whole groups in the order of their digest until they hold n rows; the one that crosses n is taken whole.

    Sizes are summed per bucket of the digest first; buckets below the limit are taken, and only the groups of the bucket
    that crosses it are ranked, so no task sees all groups."""
    g = groups.withColumn("_u", uniform(*salt, F.col(key)))
    g = g.withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    sums = g.groupBy("_b").agg(F.sum(size).alias("_s"))  # at most BUCKETS rows
    before = sums.select("_b", "_s", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_before"))
    g = g.join(F.broadcast(before.where(F.col("_before") < n)), "_b")
    sure = g.where(F.col("_before") + F.col("_s") <= n)
    w = W.partitionBy("_b").orderBy("_u", key).rowsBetween(W.unboundedPreceding, -1)
    edge = g.where(F.col("_before") + F.col("_s") > n).withColumn("_run", F.coalesce(F.sum(size).over(w), F.lit(0)) + F.col("_before")).where(F.col("_run") < n).drop("_run")
    return sure.unionByName(edge).select(*groups.columns)


def calibration(records: DataFrame, frac: float = 0.02, cap: int = 4000, least: int = 50, seed: str = "13") -> DataFrame:
    """records with `held`: whether a row is in the calibration slice. Rows of one grp are held out together; without grp a
    row stands alone."""
    key = F.coalesce(F.concat(F.lit("g:"), "grp"), F.concat(F.lit("o:"), F.col("ord").cast("string")))
    r = records.withColumn("_key", key)
    total = r.count()
    n = min(cap, max(least, round(frac * total)), total // 2)
    taken = take_until(r.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("size")), n, "key", "size", seed, "calib")
    return r.join(taken.select(F.col("key").alias("_key"), F.lit(True).alias("held")), "_key", "left").withColumn("held", F.coalesce("held", F.lit(False))).drop("_key")


def shuffled(options: Column, *parts: Column | str) -> Column:
    """An array of strings in the order of their digests."""
    tagged = F.transform(options, lambda o: F.concat(digest(*parts, o), o))
    return F.transform(F.array_sort(tagged), lambda x: F.substring(x, 65, 1 << 30))


def choice_subset(options: Column, gold: Column, kmin: int, kmax: int, *parts: Column | str) -> Column:
    """The gold and other options by digest, kmin to kmax in all or as many as there are, in a new order."""
    k = F.least(F.size(options), F.lit(kmin) + F.floor(uniform("k", *parts) * (kmax - kmin + 1)).cast("int"))
    others = F.slice(shuffled(F.array_except(options, F.array(gold)), "pick", *parts), F.lit(1), k - 1)
    return shuffled(F.concat(others, F.array(gold)), "order", *parts)


DRAWS = 8


def negatives(rows: DataFrame, pool: DataFrame, group: str, own: str, text: str, *salt: str) -> DataFrame:
    """For each row one entry of its group's pool (group, entry) that is neither in the array `own` nor inside `text`. Of the pool in the order of its
    digests DRAWS places are drawn by digest, and the first fitting entry is taken, so a row costs DRAWS rows however large the pool is. The few rows that none of
    them fits get the first fitting entry of the whole pool by digest. Rows for which the pool has none are left out. rows need a column id."""
    placed = pool.select(group, "entry").where("entry IS NOT NULL").distinct()
    sizes = placed.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = placed.withColumn("_i", F.row_number().over(W.partitionBy(group).orderBy(digest(*salt, F.col("entry")), "entry")) - 1)
    slim = rows.select("id", group, own, text)
    drawn = slim.join(sizes, group).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("_i", F.floor(uniform(*salt, F.col("id"), F.col("_draw")) * F.col("_size")).cast("int"))
    fits = ~F.array_contains(own, F.col("entry")) & ~F.contains(text, "entry")
    first = drawn.join(ranked, [group, "_i"]).where(fits).groupBy("id").agg(F.min_by("entry", "_draw").alias("negative"))
    rest = slim.join(first.select("id"), "id", "left_anti").join(placed, group).where(fits).groupBy("id").agg(F.min_by("entry", digest(*salt, F.col("id"), F.col("entry"))).alias("negative"))
    return first.unionByName(rest)


def sql_negatives(rows: str, pool: str, salt: str) -> str:
    """The same over rows (id, grp, own, txt) and pool (grp, entry)."""
    from sievemill.functions.hashing import sql_digest, sql_uniform

    return f"""_p AS MATERIALIZED (SELECT DISTINCT grp, entry FROM {pool} WHERE entry IS NOT NULL), _k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {sql_digest(salt, "entry")}, entry) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM _p),
_f AS MATERIALIZED (SELECT id, arg_min(entry, d) AS negative FROM (SELECT r.id, r.own, r.txt, k.entry, d FROM {rows} r, range({DRAWS}) x(d), _k k WHERE k.grp = r.grp AND k.i = floor({sql_uniform(salt, "r.id", "d::VARCHAR")} * k.n)) WHERE NOT list_contains(own, entry) AND NOT contains(txt, entry) GROUP BY id),
negative AS (SELECT * FROM _f UNION ALL SELECT id, arg_min(entry, {sql_digest(salt, "id", "entry")}) FROM {rows} r JOIN _p USING (grp) WHERE id NOT IN (SELECT id FROM _f) AND NOT list_contains(own, entry) AND NOT contains(txt, entry) GROUP BY id)"""
