"""Checks of output files against their rules, evidence rows, and what may be skipped because of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.functions.patterns import pattern_result
from fleetops.functions.scalars import canonical_json, digest, json_equal

#: Content rules aren't applied to larger files, so that executors never hold one.
MOST_BYTES = 1 << 20


def check_files(rules: DataFrame, files: DataFrame, most_bytes: int = MOST_BYTES, seconds: float = 0.25) -> DataFrame:
    """Adds `code` and `passed` to rules: missing_file, too_small, content_too_large, invalid_json, missing_json_key,
    json_value_mismatch, invalid_regex, regex_timeout, regex_no_match or passed; the first failure in this order.

    rules: any keys, path, min_bytes, check (json), has_key (dotted path), json_equals (map of dotted path to JSON text),
    regex (Python). files: path, length, content (text or binary). Content is looked at only if a rule asks for it and the
    file isn't over most_bytes. A pattern that can't be used, or takes more than `seconds`, fails its own row only.
    """
    out = rules.join(files.select("path", F.col("length").alias("_length"), F.col("content").cast("string").alias("_content")), "path", "left")
    parse = (F.col("check") == "json") | F.col("has_key").isNotNull() | (F.size("json_equals") > 0)
    parse = F.coalesce(parse, F.lit(False))
    reads = parse | F.col("regex").isNotNull()
    text = F.when(F.col("_length") <= most_bytes, F.col("_content"))
    doc = F.try_parse_json(text)
    at = lambda path: F.concat(F.lit("$['"), F.array_join(F.split(path, "\\."), "']['"), F.lit("']"))
    whole = F.aggregate(F.map_entries(F.coalesce("json_equals", F.create_map().cast("map<string,string>"))), F.lit(True), lambda ok, e: ok & F.coalesce(_equal_at(text, at(e["key"]), e["value"]), F.lit(False)))
    out = out.withColumn("_regex", pattern_result(text, F.when(F.col("_length") <= most_bytes, F.col("regex")), seconds)["reason"])
    code = (
        F.when(F.col("_length").isNull(), "missing_file")
        .when(F.col("_length") < F.coalesce("min_bytes", F.lit(0)), "too_small")
        .when(reads & (F.col("_length") > most_bytes), "content_too_large")
        .when(parse & doc.isNull(), "invalid_json")
        .when(F.col("has_key").isNotNull() & ~_found(doc, at(F.col("has_key"))), "missing_json_key")
        .when((F.size("json_equals") > 0) & ~whole, "json_value_mismatch")
        .when(F.col("_regex") != "passed", F.col("_regex"))
        .otherwise("passed")
    )
    return out.withColumn("code", code).withColumn("passed", F.col("code") == "passed").drop("_length", "_content", "_regex")


def _found(doc: Column, path: Column) -> Column:
    """A key is there even if it holds null, which get_json_object couldn't tell."""
    return F.coalesce(F.try_variant_get(doc, path, "variant").isNotNull(), F.lit(False))


def _equal_at(text: Column, path: Column, wanted: Column) -> Column:
    return json_equal(F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant")), wanted)


def validation_record(checks: DataFrame, jobs: DataFrame, recorded: DataFrame, job: str, bound: Sequence[str]) -> DataFrame:
    """One row per completed job without one yet: rules_digest and codes_digest over its checks (sorted), context_digest
    over the bound columns of the job, record_digest over these, and passed. The first record stands.

    checks: job, name, path, code, passed; jobs: job and bound columns; recorded: job."""
    item = F.struct("name", "path")
    rules = F.to_json(F.sort_array(F.collect_list(item)))
    codes = F.to_json(F.sort_array(F.collect_list(F.struct("name", "code"))))
    per = checks.groupBy(job).agg(digest(rules).alias("rules_digest"), digest(codes).alias("codes_digest"), F.bool_and("passed").alias("passed"))
    out = jobs.join(recorded.select(job).distinct(), job, "left_anti").join(per, job)
    out = out.withColumn("context_digest", digest(canonical_json({c: F.col(c) for c in bound})))
    return out.withColumn("record_digest", _sealed())


def _sealed() -> Column:
    return digest(F.concat_ws("|", "rules_digest", "codes_digest", "context_digest", F.col("passed").cast("string")))


def verify_record(records: DataFrame, bound: Sequence[str]) -> DataFrame:
    """Adds `mismatches`: which of context and record no longer equal the digest of their columns."""
    context = digest(canonical_json({c: F.col(c) for c in bound}))
    odd = lambda a, b, n: F.when(~F.col(a).eqNullSafe(b), n)
    return records.withColumn("mismatches", F.array_compact(F.array(odd("context_digest", context, "context"), odd("record_digest", _sealed(), "record"))))


def skip_decision(jobs: DataFrame, producers: DataFrame, checks: DataFrame, job: str) -> DataFrame:
    """Adds `skip` and `why` (null if skipped): forced, no_outputs, no_fingerprint, no_producer, fingerprint_differs,
    dependency_changed, output_failed; the first that applies.

    jobs: job, force, n_outputs, fingerprint, bound (dependencies still as bound); producers: job,
    producer_fingerprint; checks: job, passed."""
    fit = checks.groupBy(job).agg(F.bool_and("passed").alias("_fit"))
    out = jobs.join(producers.select(job, "producer_fingerprint"), job, "left").join(fit, job, "left")
    why = (
        F.when(F.coalesce("force", F.lit(False)), "forced")
        .when(F.coalesce("n_outputs", F.lit(0)) == 0, "no_outputs")
        .when(F.col("fingerprint").isNull(), "no_fingerprint")
        .when(F.col("producer_fingerprint").isNull(), "no_producer")
        .when(F.col("producer_fingerprint") != F.col("fingerprint"), "fingerprint_differs")
        .when(~F.coalesce("bound", F.lit(False)), "dependency_changed")
        .when(~F.coalesce("_fit", F.lit(False)), "output_failed")
    )
    return out.withColumn("why", why).withColumn("skip", why.isNull()).drop("_fit", "producer_fingerprint")


def dry_run(decided: DataFrame, group: str) -> DataFrame:
    """By group what would run: tasks, skipped, and the count of each reason to run (map)."""
    each = decided.groupBy(group, F.coalesce("why", F.lit("skipped")).alias("_why")).agg(F.count("*").alias("_n"))
    skipped = F.sum(F.when(F.col("_why") == "skipped", F.col("_n")).otherwise(0))
    entries = F.sort_array(F.collect_list(F.when(F.col("_why") != "skipped", F.struct("_why", "_n"))))
    return each.groupBy(group).agg(F.sum("_n").alias("tasks"), skipped.alias("skipped"), F.map_from_entries(entries).alias("run_because"))


def stage_reuse(stages: DataFrame, sidecars: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `reuse`: not forced, the sidecar says schema 1 and the same fingerprint, and all files of the stage pass.

    stages: keys, force, fingerprint; sidecars: keys, schema, fingerprint; checks: keys, passed. A stage without
    checked files isn't reused."""
    side = sidecars.select(*keys, F.col("schema").alias("_schema"), F.col("fingerprint").alias("_was"))
    fit = checks.groupBy(*keys).agg(F.bool_and("passed").alias("_fit"))
    out = stages.join(side, list(keys), "left").join(fit, list(keys), "left")
    good = ~F.coalesce("force", F.lit(False)) & (F.col("_schema") == 1) & (F.col("_was") == F.col("fingerprint")) & F.col("_fit")
    return out.withColumn("reuse", F.coalesce(good, F.lit(False))).drop("_schema", "_was", "_fit")
