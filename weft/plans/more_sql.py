"""DuckDB SQL for ``more_queries`` and for queries of the first set that had none."""

from __future__ import annotations

from weft.plans import core_sql as _core
from weft.plans.core_sql import _HEX, _UUID, _W, _expanded, build, fold

_ROWS = "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_index FROM lineitem"
_ONE = "SELECT sample_id, {0} FROM sft_samples WHERE sample_id IS NOT NULL GROUP BY sample_id"
_WRITTEN = "SELECT j.id AS source_id, j.n AS tool_count, j.v AS variant FROM judged j WHERE outcome = 'written'"
_CHAT = "chr(10)"

ORACLES: dict[str, str] = {
    "numbered_rows": _ROWS,
    "batch_sizes": f"SELECT row_index // 1000 AS batch, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM ({_ROWS}) GROUP BY 1",
    "sequential_tool_rows": _expanded("2, 4", "1", "true") + f"SELECT 99 + row_number() OVER (ORDER BY source_id, tool_count, variant) AS id, * FROM ({_WRITTEN})",
    "tool_generation_all_counts": _expanded("1, 2, 3, 4, 5, 6, 7, 8", "1", "true") + """SELECT j.id || '_tc' || j.n || '_v' || j.v AS id, j.id AS source_id, j.n AS tool_count, j.triggered AS is_trigger, j.v AS variant,
        CASE WHEN j.triggered THEN '[{"name":"trigger_tool","arguments":null}]' ELSE '[{"arguments":{},"name":"' || j.focal || '"}]' END AS answers, o.chosen FROM judged j JOIN ordered o ON o.id = j.id AND o.n = j.n AND o.v = j.v""",
    "all_nodes": "SELECT id, name, status FROM node ORDER BY id DESC",
    "config_hashes": build("""SELECT id, substr(sha256('{"id":' || id || ',"run":' || coalesce(run_id::VARCHAR, 'null') || ',"stage":' || coalesce(to_json(stage)::VARCHAR, 'null') || '}'), 1, 16) AS hash FROM job_""", "job_"),
    "answer_scalars": build("""SELECT id, c <> 0 AS readable, c = 1 AS is_marker, CASE c WHEN 0 THEN NULL WHEN 1 THEN 'trigger_tool' ELSE focal END AS tool,
        CASE c WHEN 0 THEN NULL WHEN 1 THEN '[{"name":"trigger_tool","arguments":null}]' ELSE '[{"name":"' || focal || '","arguments":{}}]' END AS compact,
        CASE c WHEN 0 THEN left('[{"name":"' || focal || '","arguments":{}}]', length('[{"name":"' || focal || '","arguments":{}}]') - 2) WHEN 1 THEN '[ {"name": "trigger_tool", "arguments": null} ]' ELSE '[{"name":"' || focal || '","arguments":{}}]' END AS unfenced
        FROM (SELECT id, focal, ascii(right(id, 1)) % 7 AS c FROM tl)""", "tl"),
    "unprocessed_uuids": build("SELECT uuid FROM manifest WHERE uuid NOT IN (SELECT uuid FROM facts WHERE reason IS NULL)", "facts", "manifest"),
    "predictions_with_gold": build(f"SELECT s.sample_id, g.sample_type, level, strict, exact FROM scored s JOIN (SELECT sample_id, max({fold('sample_type')}) AS sample_type FROM sft_samples GROUP BY 1) g ON g.sample_id = s.sample_id", "scored"),
    "union_of_parts": build("SELECT part AS data_partition, count(*) AS n, min(uuid) AS first, max(uuid) AS last FROM manifest GROUP BY part", "manifest"),
    "sampled_levels": build(f"SELECT sample_id, level, r AS rank FROM (SELECT sample_id, level, row_number() OVER (PARTITION BY level ORDER BY {_HEX.format('''('42|' || sample_id)''')}, sample_id) AS r FROM preds WHERE level BETWEEN 0 AND 3) WHERE r <= 15", "preds"),
    "shared_uuids": f"""SELECT sample_id, u AS uuid FROM (SELECT sample_id, {_UUID} AS u FROM ({_ONE.format('max(source_uuid) AS source_uuid')}))
        WHERE u IN (SELECT {_UUID.replace('source_uuid', 'uuid')} FROM nemotron_uuid_same_tool_success_stats WHERE uuid IS NOT NULL)""",
    "jobs_of_one_run": build("SELECT id, run_id, stage FROM job_ WHERE run_id = 3", "job_"),
    "one_node": "SELECT id, name, hostname FROM node WHERE id = 5",
    "nodes_without_gone": "SELECT id, name FROM node WHERE id % 5 <> 0",
    "overwritten_nodes": "SELECT id, name, CASE WHEN id % 6 = 0 THEN '1x80G' WHEN id % 3 <> 0 THEN gpu_info END AS gpu_info, ssh_user FROM node",
    "heartbeats": "SELECT id, CASE WHEN id = 4 THEN 'alive' ELSE status END AS status, strftime(CASE WHEN id = 4 THEN TIMESTAMP '2031-03-01 00:00:00' ELSE last_heartbeat_at END, '%Y-%m-%d %H:%M:%S') AS last_heartbeat_at FROM node",
    "cancelled_jobs": build(f"SELECT id, 'cancelled' AS status, '2031-03-01 00:00:00' AS finished_at FROM job_ WHERE id BETWEEN 1 AND 10 AND {fold('status')} IN ('queued', 'running')", "job_"),
    "created_nodes": """SELECT (SELECT max(id) FROM node) + n AS id, name, host AS hostname, NULL::VARCHAR AS ssh_user, 22 AS ssh_port, 'alive' AS status, '2031-03-01' AS created FROM (VALUES (1, 'alpha', 'a.host'), (2, 'zeta', 'z.host')) t(n, name, host)""",
    "created_runs": build(f"""SELECT row_number() OVER (ORDER BY name) AS id, name, 'created' AS status, substr(sha256('{{"a":1,"stage":"' || name || '"}}'), 1, 16) AS config_hash FROM (SELECT DISTINCT {fold('stage')} AS name FROM job_ WHERE stage IS NOT NULL)""", "job_"),
    "queued_jobs": "SELECT id AS run_id, position, stage, 'run ' || stage AS command, '/runs/' || id AS workdir, 'queued' AS status, coalesce(given, id) AS node_id FROM node, (VALUES (0, 'train', NULL::BIGINT), (1, 'eval', 2)) t(position, stage, given)",
    "last_checkpoints": build("SELECT 'checkpoint-' || max(id) AS name FROM job_", "job_"),
    "json_lines_read_back": _ONE.format("max(sample_type) AS sample_type, md5(arg_max(target, (sample_type IS NOT NULL, sample_type, target))) AS target_md5"),
    "lenient_rows_read_back": f"SELECT sample_id, sample_type IS NOT NULL AND target IS NOT NULL AS valid FROM ({_ONE.format('max(sample_type) AS sample_type, max(target) AS target')})",
    "numbered_lines_read_back": "SELECT row_number() OVER (ORDER BY o_orderkey) AS record_no, o_orderkey FROM orders",
    "fan_out_read_back": f"SELECT part, type, count(*) AS n, count(*) AS same_part FROM ({_ONE.format(f'''coalesce(max({fold('partition')}), 'none') AS part, coalesce(max({fold('sample_type')}), 'none') AS type''')}) GROUP BY ALL",
    "manifest_read_back": build("SELECT uuid, part AS partition, split AS source_subset FROM manifest", "manifest"),
    "partition_files_read_back": build("SELECT part AS data_partition, count(*) AS n, sum(success_count)::BIGINT AS successes FROM manifest GROUP BY part", "manifest"),
    "metrics_read_back": build("""SELECT count(*) AS total_samples, count(*) FILTER (level < 3 AND strict)::DOUBLE / nullif(count(*) FILTER (level < 3), 0) AS overall_ftr, count(*) FILTER (level >= 3 AND strict)::DOUBLE / nullif(count(*) FILTER (level >= 3), 0) AS overall_asr,
        count(*)::INTEGER AS n_predictions FROM scored""", "scored"),
    "neighbour_contents": build("SELECT role, count(*) AS n, count(*) FILTER (a = role) AS after_same, count(*) FILTER (b = role) AS before_same FROM (SELECT role, lag(role) OVER w AS a, lead(role) OVER w AS b FROM rows_ WINDOW w AS (PARTITION BY uuid ORDER BY idx)) GROUP BY role", "rows_"),
    "tool_prompts": build(f"""SELECT id, 'system=' || md5('Answer with calls.' || chr(10) || chr(10) || 'Available tools JSON:' || chr(10) || tools) || ',user=' || md5('use ' || focal) || ',assistant=' || md5('[{{"name":"' || focal || '","arguments":{{}}}}]') AS turns
        FROM (SELECT tl.id, tl.focal, '[' || coalesce((SELECT string_agg('{{"name":"' || c.tool_name || '","description":' || to_json(coalesce(c.description, ''))::VARCHAR || '}}', ',' ORDER BY list_position(tl.names, c.tool_name)) FROM tool_catalog c WHERE list_contains(tl.names, c.tool_name)), '') || ']' AS tools FROM tl)""", "tl"),
    "chat_templates": """SELECT doc_id, md5('<|im_start|>user' || chr(10) || coalesce(topic, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(source, '') || '<|im_end|>' || chr(10)) AS chat_md5 FROM documents""",
    "training_arrays": f"""SELECT sample_id, array_to_string(cut, ' ') AS target, array_to_string(list_concat([-100 FOR _ IN p], [7 FOR _ IN cut]), ' ') AS labels, array_to_string(list_concat([7 FOR _ IN cut], [0 FOR _ IN range(16 - len(cut))]), ' ') AS right_padded,
        array_to_string(list_concat([0 FOR _ IN range(16 - len(cut))], [7 FOR _ IN cut]), ' ') AS left_padded, array_to_string(list_concat([0 FOR _ IN range(16 - len(cut))], [1 FOR _ IN cut]), ' ') AS attention, true AS has_prefix
        FROM (SELECT sample_id, p, list_append(t[1:11], '<end>') AS cut FROM (SELECT sample_id, list_filter(regexp_split_to_array(coalesce(f, ''), '\\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(coalesce(t, ''), '\\s+'), lambda x: x <> '') AS t
          FROM ({_ONE.format('max(focal_tool) AS f, arg_max(target, (focal_tool IS NOT NULL, focal_tool, target)) AS t')})))""",
}
ORACLES["sharegpt_samples"] = """
WITH once AS (SELECT sample_id, arg_max(messages, (messages IS NOT NULL, target)) AS messages, max(target) AS target FROM sft_samples WHERE sample_id IS NOT NULL GROUP BY sample_id),
m AS (SELECT sample_id, (generate_subscripts(messages, 1)) AS idx, unnest(messages) AS x FROM once WHERE messages IS NOT NULL AND target IS NOT NULL),
r AS (SELECT sample_id, idx, trim(coalesce(x.role, '')) AS role, coalesce(x.content, '') AS content, trim(coalesce(x.role, '')) IN ('reasoning', 'tool_call', 'answer', 'assistant') AS lk FROM m),
g AS (SELECT *, sum((NOT lk OR NOT prev OR role = 'reasoning')::INT) OVER (PARTITION BY sample_id ORDER BY idx) AS turn FROM (SELECT *, coalesce(lag(lk) OVER (PARTITION BY sample_id ORDER BY idx), false) AS prev FROM r)),
t AS (SELECT sample_id, turn, CASE WHEN bool_or(lk) THEN 'assistant' WHEN max(role) = 'tool_output' THEN 'tool' ELSE max(role) END AS role, string_agg(content, chr(10) ORDER BY idx) AS text FROM g GROUP BY ALL),
p AS (SELECT sample_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt FROM t GROUP BY sample_id)
SELECT o.sample_id, 'human' AS from_0, md5(coalesce(p.prompt, '') || '<|im_start|>assistant' || chr(10)) AS value_0, 'gpt' AS from_1, md5(o.target) AS value_1 FROM once o LEFT JOIN p ON p.sample_id = o.sample_id WHERE o.messages IS NOT NULL AND o.target IS NOT NULL
"""
# the JSON trees of tool outputs; a row is a root or an object in an array, and every node has its nearest row above it
_TREE = _core.ORACLES["p3_found"].split("objects AS")[0].rstrip().rstrip(",") + r""",
once_ AS (SELECT sample_id, i, any_value(j) AS j FROM opened WHERE j IS NOT NULL GROUP BY ALL),
tree AS (SELECT o.sample_id, o.i, n.id, n.parent, n.type, 'messages[' || o.i || '].content' || replace(substr(n.fullkey, 2), '"', '') AS path, n.value FROM once_ o, json_tree(o.j) n),
marked AS (SELECT c.*, c.parent IS NULL OR (c.type = 'OBJECT' AND p.type = 'ARRAY') AS is_row, p.type = 'ARRAY' AS in_array FROM tree c LEFT JOIN tree p ON p.sample_id = c.sample_id AND p.i = c.i AND p.id = c.parent),
up AS (SELECT sample_id, i, id, parent AS at FROM marked WHERE parent IS NOT NULL
  UNION ALL SELECT u.sample_id, u.i, u.id, m.parent FROM up u JOIN marked m ON m.sample_id = u.sample_id AND m.i = u.i AND m.id = u.at WHERE NOT m.is_row),
owned AS (SELECT c.*, o.path AS owner FROM up u JOIN marked o ON o.sample_id = u.sample_id AND o.i = u.i AND o.id = u.at AND o.is_row JOIN marked c ON c.sample_id = u.sample_id AND c.i = u.i AND c.id = u.id),
maps AS (SELECT DISTINCT sample_id AS k, 'full_tool_success_counts' AS root, unnest(map_entries(full_tool_success_counts)) AS e, generate_subscripts(map_entries(full_tool_success_counts), 1) - 1 AS n FROM sft_samples WHERE sample_id IS NOT NULL),
stat AS (SELECT uuid, j FROM (SELECT uuid, TRY_CAST(tool_success_counts_json AS JSON) AS j, row_number() OVER (PARTITION BY uuid ORDER BY tool_success_counts_json) AS r FROM (SELECT DISTINCT uuid, tool_success_counts_json FROM nemotron_uuid_same_tool_success_stats WHERE uuid IS NOT NULL AND json_type(TRY_CAST(tool_success_counts_json AS JSON)) = 'OBJECT')) WHERE r = 1),
entries AS (SELECT k, root, root || '.' || e.key AS path, e.key AS name, e.value::VARCHAR AS value, n FROM maps WHERE e.value IS NOT NULL
  UNION ALL SELECT s.uuid, 'tool_success_counts_json', 'tool_success_counts_json.' || t.key, t.key, json_extract_string(t.value, '$'), list_position(json_keys(s.j), t.key) - 1 FROM stat s, json_each(s.j) t WHERE t.type <> 'NULL')
""".replace("WITH outs", "WITH RECURSIVE outs")
_TREE = _TREE.replace("WITH outs", "WITH RECURSIVE outs")
_KEY = "md5({0} || chr(31) || {1})"
_FLAT = _TREE + f"SELECT k AS record_key, {_KEY.format('k', 'path')} AS row_id, {_KEY.format('k', 'root')} AS parent_id, root || '{{}}' AS table_path, n::INTEGER AS ordinal, name, value::DECIMAL(38, 0) AS value FROM entries WHERE root = '@R'"
ORACLES["p3_map_counts"] = _FLAT.replace("@R", "full_tool_success_counts")
ORACLES["p3_json_counts"] = _FLAT.replace("@R", "tool_success_counts_json")
ORACLES["p3_links"] = _TREE + f"""SELECT sample_id AS record_key, {_KEY.format('sample_id', 'path')} AS row_id, {_KEY.format('sample_id', 'owner')} AS parent_id, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS table_path,
    regexp_extract(path, '\\[(\\d+)\\]$', 1)::INTEGER AS ordinal, path FROM owned WHERE is_row
  UNION ALL SELECT k, {_KEY.format('k', 'path')}, {_KEY.format('k', 'root')}, root || '{{}}', n::INTEGER, path FROM entries"""
ORACLES["p3_orphans"] = "SELECT ''::VARCHAR AS record_key, ''::VARCHAR AS row_id, ''::VARCHAR AS parent_id, ''::VARCHAR AS path WHERE false"
ORACLES["p3_schema"] = _TREE.rstrip() + r""",
fields AS (SELECT sample_id AS k, owner AS row, regexp_replace(owner, '\[\d+\]', '[]', 'g') AS table_path, regexp_replace(ltrim(substr(path, length(owner) + 1), '.'), '\[\d+\]', '[]', 'g') AS field,
    CASE WHEN type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN CASE WHEN regexp_matches(value::VARCHAR, '^-?\d+$') THEN 'integer' ELSE 'double' END WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS type
  FROM owned WHERE type NOT IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT k, path, root || '{}', 'name', 'string' FROM entries UNION ALL SELECT k, path, root || '{}', 'value', 'integer' FROM entries),
rows_ AS (SELECT regexp_replace(path, '\[\d+\]', '[]', 'g') AS table_path, count(*) AS n FROM marked WHERE is_row GROUP BY 1 UNION ALL SELECT root || '{}', count(*) FROM entries GROUP BY 1)
SELECT f.table_path, f.field, string_agg(DISTINCT f.type, '|' ORDER BY f.type) AS types, count(DISTINCT f.k || chr(31) || f.row) AS n_present, any_value(r.n) AS n_rows, count(DISTINCT f.k || chr(31) || f.row) < any_value(r.n) AS optional
FROM fields f JOIN rows_ r ON r.table_path = f.table_path GROUP BY f.table_path, f.field
""".replace("\\\\", "\\")
ORACLES = {name: sql.replace("@W", _W) for name, sql in ORACLES.items()}
