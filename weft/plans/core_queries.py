"""Queries of the core by name; SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.common import folded, one_per_key, plain_uuid, table
from weft.functions import text
from weft.functions.outcome import normalize_prediction
from weft.operators import evaluate, messages, nested, pairing, registry, rowwise, samples, segments, splits, stats, toolsets
from weft.plans import core_sql, more_queries, more_sql, views

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {"p3_found": nested.p3_found, "p3_rows": nested.p3_rows, "p3_schema": nested.p3_schema, "p3_links": nested.p3_links, "p3_orphans": nested.p3_orphans, "p3_responses": nested.p3_responses, "p3_children": nested.p3_children, "p3_map_counts": nested.p3_map_counts, "p3_json_counts": nested.p3_json_counts}


def _query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


# trajectories: messages, pairs, decisions


@_query
def messages_by_role(spark, root):
    each = rowwise.once(rowwise.parsed(views.trajectories(spark, root)).select("uuid", F.transform("messages", lambda m: F.struct(F.coalesce(m["role"], F.lit("(none)")).alias("role"), F.length(m["content"]).alias("n"))).alias("m")))
    rows = each.select("uuid", F.explode("m").alias("m"))
    return rows.groupBy("m.role").agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("n_uuids"), F.sum("m.n").alias("n_chars"))


@_query
def paired_calls(spark, root):
    return stats.pairs(views.light(spark, root))


@_query
def paired_calls_by_windows(spark, root):
    """The same pairs by windows over rows of messages."""
    rows = messages.message_rows(messages.parsed(views.trajectories(spark, root)))
    return pairing.events(pairing.ranked(rows))


@_query
def unpaired_counts(spark, root):
    rows = views.light(spark, root, outcomes=False).select("uuid", F.size("calls").cast("bigint").alias("calls"), F.col("tool_output_count").alias("outputs"), "unpaired_calls", "unpaired_outputs")
    return rows.where("calls + outputs > 0")


def _decisions(spark, root, *columns):
    return rowwise.once(rowwise.analysed(views.trajectories(spark, root), outcomes=False).select("uuid", *columns))


@_query
def decision_segments(spark, root):
    target = F.transform("decisions", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.md5(rowwise.joined(F.col("messages"), d["start"], d["end"])).alias("target_md5")))
    return _decisions(spark, root, target.alias("d")).select("uuid", F.explode("d").alias("d")).select("uuid", "d.*")


@_query
def decision_segments_by_windows(spark, root):
    """The same decisions by windows over rows of messages."""
    found = segments.decisions(messages.message_rows(messages.parsed(views.trajectories(spark, root))))
    return found.select("uuid", "start", "end", F.md5("target").alias("target_md5"))


@_query
def next_decisions(spark, root):
    found = _decisions(spark, root, "pairs", "decisions").select("uuid", "decisions", F.explode("pairs").alias("p"))
    after = segments.next_decision("decisions", F.col("p.output_index"))
    return found.select("uuid", "p.k", "p.output_index", after["start"].alias("next_start"), after["end"].alias("next_end"))


@_query
def final_decisions(spark, root):
    found = _decisions(spark, root, "decisions").where("size(decisions) > 0")
    last = segments.final_decision("decisions")
    return found.select("uuid", F.size("decisions").alias("n_decisions"), last["start"].alias("start"), last["end"].alias("end"))


@_query
def message_neighbours(spark, root):
    rows = rowwise.once(rowwise.parsed(views.trajectories(spark, root)).select("uuid", F.transform("messages", lambda m: m["role"]).alias("roles")))
    roles = rows.select("uuid", F.posexplode("roles").alias("idx", "role"))
    found = messages.neighbours(roles)
    return found.groupBy(*(F.coalesce(c, F.lit("(none)")).alias(c) for c in ("previous_role", "role", "next_role"))).agg(F.count("*").alias("n"))


@_query
def chat_turns(spark, root):
    turns = F.transform(rowwise.turns("messages"), lambda t, i: F.struct((i + 1).cast("bigint").alias("turn"), t["role"].alias("role"), F.md5(F.array_join(t["lines"], "\n")).alias("text_md5")))
    rows = rowwise.once(rowwise.parsed(views.trajectories(spark, root)).select("uuid", turns.alias("t")))
    return rows.select("uuid", F.explode("t").alias("t")).select("uuid", "t.*")


@_query
def chat_turns_by_windows(spark, root):
    """The same turns by windows over rows of messages."""
    rows = messages.message_rows(messages.parsed(views.trajectories(spark, root)))
    return messages.chat_turns(rows).select("uuid", "turn", "role", F.md5("text").alias("text_md5"))


@_query
def serialized_prompts(spark, root):
    rows = rowwise.parsed(views.trajectories(spark, root)).where("size(messages) > 0").withColumn("prompt", messages.serialize_array("messages"))
    return rowwise.once(rows.select("uuid", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars")))


# statistics tables


@_query
def call_stats(spark, root):
    return stats.call_stats(views.light(spark, root, outcomes=False))


@_query
def repeat_stats(spark, root):
    return stats.repeat_stats(views.light(spark, root, outcomes=False))


@_query
def tool_frequency(spark, root):
    return stats.tool_frequency(views.light(spark, root, outcomes=False))


@_query
def success_occurrences(spark, root):
    return stats.occurrences(stats.pairs(views.light(spark, root))).select("uuid", "tool_name", "occurrence", "call_index", "output_index")


@_query
def focal_tools(spark, root):
    found = stats.focal_tools(stats.pairs(views.light(spark, root)))
    return found.select("uuid", "focal_tool", "focal_count", F.array_join(F.col("focal_outputs").cast("array<string>"), ",").alias("focal_outputs"))


@_query
def success_stats(spark, root):
    return stats.success_stats(views.light(spark, root))


# splits


@_query
def split_manifest(spark, root):
    return views.split_manifest(spark, root)


@_query
def split_summary(spark, root):
    return splits.summary(views.split_manifest(spark, root))


@_query
def split_leaks(spark, root):
    """Sources of the delivered samples in more than one partition: the check that must find nothing in a manifest of ours."""
    rows = table(spark, root, "sft_samples").select(plain_uuid("source_uuid").alias("uuid"), folded("partition").alias("part")).where("uuid is not null and part is not null")
    return splits.leaks(rows, "uuid", "part")


@_query
def split_checks(spark, root):
    """Counted outcomes of the checks of a manifest: keys, repeated keys, leaks, keys lost."""
    parts, source = views.split_manifest(spark, root), views.stats(spark, root).where("uuid is not null").select("uuid")
    counts = parts.agg(F.count("*").alias("n_rows"), F.count_distinct("uuid").alias("n_keys"))
    leaked = splits.leaks(parts).agg(F.count("*").alias("n_leaks"))
    lost = source.join(parts, "uuid", "left_anti").distinct().agg(F.count("*").alias("n_lost"))
    return counts.select("n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_repeated"), leaked.select("n_leaks").scalar().alias("n_leaks"), lost.select("n_lost").scalar().alias("n_lost"))


@_query
def hash_split(spark, root):
    rows = table(spark, root, "documents").select("doc_id", F.concat(F.lit("source:"), F.coalesce("origin_key", F.lit(""))).alias("key"))
    return splits.group_split(rows, F.col("key")).groupBy("is_validation").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_groups"))


@_query
def hash_seeds(spark, root):
    rows = table(spark, root, "sft_samples").where("sample_id is not null").select("sample_id").distinct()
    return rows.select("sample_id", text.stable_seed(F.lit("42"), "sample_id", F.lit("4"), F.lit("1")).cast("string").alias("seed"))


# labelled samples


@_query
def reject_reasons(spark, root):
    return views.facts(spark, root).groupBy(F.coalesce("reject_reason", F.lit("(kept)")).alias("reason")).agg(F.count("*").alias("n"))


@_query
def labelled_samples(spark, root):
    built = samples.build(views.facts(spark, root))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("full_tool_success_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    text_of = F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return built.select(*(c for c in built.columns if c not in ("full_tool_success_counts", "messages", "target")), counts.alias("success_counts"), F.size("messages").alias("n_messages"), F.md5(text_of).alias("messages_md5"), F.md5("target").alias("target_md5"))


@_query
def sample_matrix(spark, root):
    return samples.matrix(samples.build(views.facts(spark, root)).select("partition", "sample_type"))


@_query
def sharegpt_samples(spark, root):
    rows = samples.sharegpt(one_per_key(table(spark, root, "sft_samples").where("sample_id is not null").select("sample_id", "messages", "target"), "sample_id"))
    part = lambda i: F.col("conversations")[i]
    return rows.select("sample_id", part(0)["from"].alias("from_0"), F.md5(part(0)["value"]).alias("value_0"), part(1)["from"].alias("from_1"), F.md5(part(1)["value"]).alias("value_1"))


# tool lists


@_query
def tool_rows_checked(spark, root):
    checked = toolsets.validated(views.tool_rows(spark, root))
    return checked.groupBy(F.coalesce("problem", F.lit("(valid)")).alias("problem"), "tool_count").agg(F.count("*").alias("n"))


@_query
def tool_generation_stats(spark, root):
    expanded = toolsets.expand(views.tool_rows(spark, root), text.parse_counts("2,3,4,5,8"), variants=2, policy="triggered-only")
    return expanded.groupBy("tool_count", "outcome").agg(F.count("*").alias("n"), F.count("chosen").alias("n_written"))


@_query
def tool_generation(spark, root):
    expanded = toolsets.expand(views.tool_rows(spark, root), [2, 4], variants=1, policy="all").where("outcome = 'written'")
    return expanded.select("id", "source_id", "tool_count", "is_trigger", "variant", "answers", F.array_join("chosen", ",").alias("chosen"))


@_query
def tool_generation_all_counts(spark, root):
    """The expansion over the tool counts of the reference's production run."""
    expanded = toolsets.expand(views.tool_rows(spark, root), text.parse_counts("1,2,3,4,5,6,7,8"), variants=1, policy="all").where("outcome = 'written'")
    return expanded.select("id", "source_id", "tool_count", "is_trigger", "variant", "answers", F.array_join("chosen", ",").alias("chosen"))


@_query
def missing_answer_tools(spark, root):
    return toolsets.missing_answer_tools(views.tool_rows(spark, root))


@_query
def catalog_first_by_name(spark, root):
    """The first catalog entry of each topic and name, by tool_id."""
    rows = table(spark, root, "tool_catalog").groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("tool_id", F.to_json(F.struct(F.col("tool_name").alias("name"), "tool_id")).alias("t")))), lambda x: x["t"]).alias("tools"))
    return rows.select("topic", F.explode(toolsets.unique_by_name(F.col("tools"))).alias("u")).select("topic", "u.name", F.get_json_object("u.tool", "$.tool_id").cast("int").alias("tool_id"))


# evaluation


@_query
def level_metrics(spark, root):
    return evaluate.level_metrics(evaluate.score_calls(views.call_predictions(spark, root)))


@_query
def overall_metrics(spark, root):
    return evaluate.overall_metrics(evaluate.score_calls(views.call_predictions(spark, root)))


@_query
def confusion_by_tool_count(spark, root):
    rows = views.tool_rows(spark, root)
    u = text.hash_unit(F.lit("arrays"), "id")
    marker = '[{"name":"trigger_tool","arguments":null}]'
    count = F.json_array_length("tools")
    rows = rows.select("id", count.alias("tool_count"), F.when(count > 4, marker).otherwise(F.col("answers")).alias("answers"), F.when(u < 0.5, F.when(count > 4, marker).otherwise(F.col("answers"))).when(u < 0.7, F.lit(marker)).when(u < 0.85, F.col("answers")).otherwise("no array").alias("prediction"))
    return evaluate.confusion(evaluate.score_arrays(rows))


@_query
def outcome_counts(spark, root):
    rows = table(spark, root, "job").select("id", folded("stage").alias("stage"), folded("status").alias("status")).distinct()
    return evaluate.outcome_counts(rows, "status", "stage")


@_query
def sample_per_level(spark, root):
    rows = views.call_predictions(spark, root).select("sample_id", "level")
    return evaluate.sample_per_group(rows, "level", "sample_id", 20).select("sample_id", "level", "rank")


@_query
def first_by_hash(spark, root):
    rows = table(spark, root, "documents").where("doc_id is not null").select("doc_id", "source")
    return evaluate.sample_first(rows, "doc_id", 100)


@_query
def length_summary(spark, root):
    rows = table(spark, root, "sft_samples").where("sample_id is not null").groupBy("sample_id").agg(F.max(folded("partition")).alias("part"), F.max(F.length("target")).alias("length"), F.max("expected_trigger").alias("flag"))
    return evaluate.length_summary(rows, "part", "length", "flag")


@_query
def within_length(spark, root):
    rows = table(spark, root, "sft_samples").where("sample_id is not null").groupBy("sample_id").agg(F.max(folded("partition")).alias("part"), F.max(F.length("target")).alias("length"))
    return evaluate.within_length(rows, "part", "length", 400)


# scalars


@_query
def call_texts(spark, root):
    """Unwrapped, named, compacted and marked calls of all samples' targets."""
    rows = table(spark, root, "sft_samples").where("sample_id is not null").groupBy("sample_id").agg(F.max("target").alias("target"))
    return rows.select("sample_id", F.md5(text.unwrap("target", "tool_call")).alias("unwrapped"), text.called_tool("target").alias("tool"), text.marker_strict("target").alias("strict"), text.marker_loose("target").alias("loose"), F.md5(text.normalize_text("target")).alias("normal"), F.md5(text.strip_code_fence("target")).alias("unfenced"))


@_query
def prediction_arrays(spark, root):
    """The first readable JSON array of each document."""
    rows = table(spark, root, "documents").where("text is not null").select("doc_id", normalize_prediction("text").alias("p"))
    return rows.select("doc_id", F.col("p.valid").alias("valid"), F.col("p.tool").alias("tool"), F.md5("p.normalized").alias("normalized"))


@_query
def source_ids(spark, root):
    rows = table(spark, root, "sft_samples").where("sample_id is not null").select("sample_id").distinct()
    rows = rows.select(F.concat("sample_id", F.when(F.length("sample_id") % 2 == 0, "_tc4_v1").otherwise("")).alias("id"))
    return rows.select("id", text.source_id(F.lit(None).cast("string"), "id").alias("source_id"))


@_query
def cropped_prompts(spark, root):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return table(spark, root, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(text.crop(words, 40, 0.35), " ")).alias("cropped"))


@_query
def count_buckets(spark, root):
    return views.stats(spark, root).groupBy("uuid").agg(F.max("max_same_tool_success_count").alias("n")).groupBy(text.count_bucket("n").alias("bucket")).agg(F.count("*").alias("n_uuids"))


# registry


def _jobs(spark, root):
    return registry.current(table(spark, root, "job"))


@_query
def run_status(spark, root):
    return registry.run_status(_jobs(spark, root))


@_query
def runs_with_jobs(spark, root):
    found = registry.with_jobs(_jobs(spark, root))
    return found.select("run_id", "n_jobs", F.array_join(F.transform("jobs", lambda j: F.concat_ws(":", j["id"].cast("string"), j["stage"], j["status"])), ",").alias("jobs"))


@_query
def jobs_of_status(spark, root):
    return registry.listed(_jobs(spark, root), status="failed").select("id", "run_id", "stage", "exit_code")


@_query
def claimable_job(spark, root):
    return registry.claimable(_jobs(spark, root), 3).select("id", "run_id", "node_id")


@_query
def newest_nodes(spark, root):
    return registry.newest(table(spark, root, "node")).limit(10).select("id", "name", "status")


@_query
def all_nodes(spark, root):
    """All nodes, newest first."""
    return registry.newest(table(spark, root, "node")).select("id", "name", "status")


@_query
def patched_nodes(spark, root):
    nodes = table(spark, root, "node").select("id", "name", "gpu_info", "status")
    changes = nodes.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "1x80G").alias("gpu_info"))
    return registry.patched(nodes, changes)


@_query
def registered_nodes(spark, root):
    nodes = table(spark, root, "node")
    seen = nodes.where("id % 4 = 0").select("name", F.lit("").alias("hostname"), F.lit(None).cast("string").alias("ssh_user"), F.lit(2200).alias("ssh_port"), F.when(F.col("id") % 8 == 0, "2x80G").alias("gpu_info"))
    return registry.registered(nodes, seen, F.lit("2031-02-01 00:00:00").cast("timestamp")).select("id", "name", "hostname", "ssh_user", "ssh_port", "gpu_info", "status", F.date_format("last_heartbeat_at", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat_at"))


@_query
def silent_nodes(spark, root):
    return registry.offline(table(spark, root, "node"), F.lit("2031-01-28 02:00:00").cast("timestamp"), 3600).select("id", "name", "status")


@_query
def jobs_without_node(spark, root):
    nodes = table(spark, root, "node").select(F.col("id").alias("node_id"))
    return _jobs(spark, root).where("node_id is not null").join(nodes, "node_id", "left_anti").select("id", "run_id", "node_id")


@_query
def job_durations(spark, root):
    """Jobs per stage and status with their waiting and running time; ends before starts count as unknown."""
    seconds = lambda a, b: F.unix_micros(b) / 1e6 - F.unix_micros(a) / 1e6
    rows = _jobs(spark, root).select(folded("stage").alias("stage"), folded("status").alias("status"), *(F.col(c).cast("timestamp").alias(c) for c in ("created_at", "started_at", "finished_at")))
    ran = seconds(F.col("started_at"), F.col("finished_at"))
    return rows.groupBy("stage", "status").agg(F.count("*").alias("n"), F.round(F.avg(seconds(F.col("created_at"), F.col("started_at"))), 3).alias("mean_wait"), F.round(F.avg(F.when(ran >= 0, ran)), 3).alias("mean_run"), F.count_if(F.coalesce(ran < 0, F.lit(False))).alias("n_reversed"))


def queries() -> dict[str, Query]:
    return {**_ALL, **more_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in {**core_sql.ORACLES, **more_sql.ORACLES}.items() if name in queries()}
