"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import cosine_join, fm_index, format_dups, lookalike, mixing, packing, shared_spans, token_budget
from sievemill.session import folder, stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cosine_join.near_pairs(table(spark, sf_dir, "records"))
    return p.select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b"))


def p1_record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that takes part: its class of equal texts and the number of records on the other side that it is near to."""
    return cosine_join.links(table(spark, sf_dir, "records"))


def p1_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the held-out record: how many of its records come back in train, and in how many pairs."""
    r = table(spark, sf_dir, "records")
    held = r.where("id IS NOT NULL AND split IN ('dev', 'test')").select("id", "split", "source").dropDuplicates(["id"])
    per = cosine_join.links(r).where("n_links > 0").select("id", "n_links")
    return held.join(per, "id").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.sum("n_links").alias("n_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "records"))


def p2_consistent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent(table(spark, sf_dir, "records"))


def p3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*(table(spark, sf_dir, t) for t in ("records", "mix_targets", "tok_merges")))[0]


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*(table(spark, sf_dir, t) for t in ("records", "mix_targets", "tok_merges")))[1]


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report says of each target: its records, and whether no record is used more often than it may be."""
    used, report = mixing.mixture(*(table(spark, sf_dir, t) for t in ("records", "mix_targets", "tok_merges")))
    most = used.groupBy("source", "lang").agg(F.max("times").alias("most"))
    r = report.join(most, ["source", "lang"], "left")
    return r.select("source", "lang", "target_share", "n_records", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within"), (F.abs(F.coalesce("share_of_present", F.lit(0.0)) - F.col("actual_share")) < 1).alias("shared"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.copies(table(spark, sf_dir, "records"))


def p5_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.counted(table(spark, sf_dir, "records"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "probe_items").select("item_id", F.col("q_native.state").alias("passage"))
    return fm_index.leaked_spans(table(spark, sf_dir, "documents"), items)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = token_budget.Tokenizer.of(table(spark, sf_dir, "tok_merges"))
    items = token_budget.encoded(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), tok)
    return packing.pack(stored(items, "p6-sizes"), table(spark, sf_dir, "pack_sizes"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("spec_name", F.col("id").cast("long").alias("doc_id"), "piece", F.col("n").alias("n_tokens"), "container")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents of known length: their tokens in all containers, their pieces, and the containers that hold more than they can."""
    packed, specs = _packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    over = packed.groupBy("spec_name", "container").agg(F.sum("n").alias("held")).join(specs, "spec_name").where("held > capacity_tokens").groupBy("spec_name").agg(F.count("*").alias("over"))
    known = table(spark, sf_dir, "token_counts").select(F.col("doc_id").cast("string").alias("id")).distinct()
    own = packed.join(known, "id", "left_semi").groupBy("spec_name", "id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return own.join(over, "spec_name", "left").select("spec_name", F.col("id").cast("long").alias("doc_id"), "n_tokens", "n_pieces", F.coalesce("over", F.lit(0)).cast("long").alias("n_over"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.removal_spans(_leaks(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, sf_dir, "documents"))


def p8_document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.links(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.spans(table(spark, sf_dir, "documents"))


def p8_document_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shares(table(spark, sf_dir, "documents"))


def p8_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.deduplicated(table(spark, sf_dir, "documents"))


def _in_two_steps(spark: SparkSession, sf_dir: str, withdrawn: bool) -> DataFrame:
    """Totals of all rows, as an update of the ledger of the first two days; that one may also hold rows that were withdrawn since."""
    tok = token_budget.Tokenizer.of(table(spark, sf_dir, "tok_merges"))
    r, d, s = (table(spark, sf_dir, t) for t in ("records", "documents", "datasets"))
    early = token_budget.deliveries(r.where("loaded_at < TIMESTAMP '2026-01-03'"), d.where("fetched_at < TIMESTAMP '2026-01-03'"), s)
    if withdrawn:
        gone = early.where(F.pmod(F.xxhash64("kind", "id"), F.lit(10)) == 0).withColumn("id", F.concat(F.lit("withdrawn/"), "id"))
        early = early.unionByName(gone.withColumn("source", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "withdrawn").otherwise(F.col("source"))))
    ledger = token_budget.Ledger(spark, folder(spark, "p4-ledger"))
    ledger.update(early, tok)
    return ledger.update(token_budget.deliveries(r, d, s), tok)


def p4_counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents whose true count is known, from a ledger of all documents."""
    tok = token_budget.Tokenizer.of(table(spark, sf_dir, "tok_merges"))
    d, s = (table(spark, sf_dir, t) for t in ("documents", "datasets"))
    ledger = token_budget.Ledger(spark, folder(spark, "p4-ledger"))
    ledger.update(token_budget.deliveries(table(spark, sf_dir, "records").limit(0), d, s), tok)
    known = table(spark, sf_dir, "token_counts").select(F.col("doc_id").cast("string").alias("id")).distinct()
    return ledger.rows().where("kind = 'document'").join(known, "id", "left_semi").select(F.col("id").cast("long").alias("doc_id"), "n_tokens")


def p4_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_two_steps(spark, sf_dir, False)


def p4_updated_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals where a tenth more rows of the first two days, some of them all of their slice, are gone from the delivery."""
    return _in_two_steps(spark, sf_dir, True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from sievemill.llm.sql import SQL

    return dict(SQL)
