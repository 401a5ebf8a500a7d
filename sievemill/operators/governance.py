"""Licences, source selection, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Profiles: the licence classes allowed, and whether share-alike sources may train.
PROFILES = {"default": (["ALLOW", "CONDITIONAL"], True), "strict": (["ALLOW"], False)}


def licence_check(datasets: DataFrame, licences: DataFrame, profile: str = "default") -> DataFrame:
    """key, keep, problem. Not kept without a problem means left out by the profile: a share-alike source that trains."""
    classes, share_alike = PROFILES[profile]
    d = datasets.join(F.broadcast(licences.select(F.col("key").alias("license"), F.col("class"), "share_alike")), "license", "left")
    unknown = F.col("class").isNull()
    barred = ~F.col("class").isin(*classes)
    dropped = F.lit(not share_alike) & F.coalesce("share_alike", F.lit(False)) & ~F.col("role").eqNullSafe("eval_only")
    problem = F.when(unknown, F.concat("key", F.lit(": no licence entry"))).when(barred, F.concat("key", F.lit(": licence class "), "class", F.lit(" is not allowed")))
    return d.select("key", (~unknown & ~barred & ~dropped).alias("keep"), problem.alias("problem"))


def selected(datasets: DataFrame, licences: DataFrame, profile: str = "default") -> DataFrame:
    """key and converter of the sources to build from: enabled, with a converter, and kept by the licence check."""
    keep = licence_check(datasets, licences, profile).where("keep").select("key")
    return datasets.where("enabled AND converter IS NOT NULL").join(keep, "key", "left_semi").select("key", "converter")


def trainable(datasets: DataFrame, licences: DataFrame, profile: str = "default") -> DataFrame:
    return selected(datasets.where("NOT (role <=> 'eval_only')"), licences, profile)


def share_alike_sources(records: DataFrame, datasets: DataFrame, licences: DataFrame) -> DataFrame:
    """Sources with training records whose licence must be passed on."""
    s = datasets.join(F.broadcast(licences.where("share_alike").select(F.col("key").alias("license"))), "license", "left_semi").select(F.col("key").alias("source"))
    return records.where("split = 'train'").join(F.broadcast(s), "source", "left_semi").select("source").distinct()


def attribution(records: DataFrame, datasets: DataFrame, licences: DataFrame) -> DataFrame:
    """source, licence, duties and training records, one line per source."""
    n = records.where("split = 'train'").groupBy("source").agg(F.count("*").alias("n_train"))
    lic = licences.select(F.col("key").alias("license"), "duties")
    return n.join(datasets.select(F.col("key").alias("source"), "license"), "source").join(F.broadcast(lic), "license", "left").select("source", "license", F.coalesce("duties", F.lit("none")).alias("duties"), "n_train")


NULL = "\u2400"
FIELDS = ("id", "lang", "type", "question", "options", "context", "label")


def manifest(records: DataFrame) -> DataFrame:
    """source, split, n and a digest of each part's contents that no order changes: the digests of its lines, added up. A line has its
    fields between separators, a null as a sign of its own."""
    text = lambda c: F.array_join(c, "\x1e", NULL) if c == "options" else F.col(c).cast("string")
    line = F.sha2(F.concat_ws("\x1f", *(F.coalesce(text(c), F.lit(NULL)) for c in FIELDS)), 256)
    words = [F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(4)]
    mod = [F.col(f"w{i}") % (1 << 32) for i in range(4)]
    return records.groupBy("source", "split").agg(F.count("*").alias("n"), *words).select("source", "split", "n", F.sha2(F.concat_ws(",", *mod), 256).alias("sha256"))


def differing(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """source, split and problem of the parts in which two manifests differ."""
    a, b = pinned.select("source", "split", F.col("sha256").alias("_a")), found.select("source", "split", F.col("sha256").alias("_b"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, ["source", "split"], "full").select("source", "split", problem.alias("problem")).where("problem IS NOT NULL")


def publish_problems(records: DataFrame, datasets: DataFrame, licences: DataFrame, profile: str = "default", least: int = 1000) -> DataFrame:
    """Why a corpus or what was trained on it can't be published, as (source, problem): fewer than `least` training records in all, which is a trial
    run, or training records of a source that isn't listed or whose licence the profile bars. No row means that it can."""
    n = records.where("split = 'train'").groupBy("source").agg(F.count("*").alias("n"))
    check = licence_check(datasets, licences, profile).select(F.col("key").alias("source"), "keep", "problem")
    unlisted = F.when(F.col("keep").isNull(), F.concat("source", F.lit(": not listed")))
    bad = n.join(check, "source", "left").where(~F.coalesce("keep", F.lit(False))).select("source", F.coalesce(unlisted, "problem", F.concat("source", F.lit(": left out by the profile"))).alias("problem"))
    small = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") < least).select(F.lit(None).cast("string").alias("source"), F.lit("trial run").alias("problem"))
    return bad.unionByName(small)


def structure(expected: DataFrame, found: DataFrame) -> DataFrame:
    """name and problem where the parts of something, (name, kind), aren't those expected."""
    e, f = expected.select("name", F.col("kind").alias("_e"), F.lit(1).alias("_in_e")), found.select("name", F.col("kind").alias("_f"), F.lit(1).alias("_in_f"))
    problem = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_f")), F.concat(F.lit("is "), F.coalesce("_f", F.lit("null")), F.lit(", not "), F.coalesce("_e", F.lit("null"))))
    return e.join(f, "name", "full").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def card(title: str, lines: DataFrame, metrics: DataFrame, problems: DataFrame) -> str:
    """The description that goes with a release: its state, what it was trained on by source and licence, how it scores. All three tables have a row per
    source or slice."""
    from sievemill.sources.sinks import markdown

    bad = [r["problem"] for r in problems.orderBy("problem").collect()]
    state = "ready" if not bad else "not for publication: " + "; ".join(bad)
    return "\n".join([f"# {title}", "", f"State: {state}", "", markdown(lines, "Training sources"), markdown(metrics, "Results")])


def corpus_hash(parts: DataFrame) -> DataFrame:
    """SHA-256 over the lines '<digest>  <split>/<source>' of a manifest in order: one row per part, as many as files."""
    line = F.concat("sha256", F.lit("  "), F.concat_ws("/", "split", "source"), F.lit("\n"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("corpus_sha256"))
