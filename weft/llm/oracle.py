"""DuckDB SQL for the operators' queries that SQL can express over whole tables."""

from __future__ import annotations

_UUID = (
    r"CASE WHEN regexp_matches(regexp_replace(regexp_replace(low, '^urn:uuid:', ''), '[{}\s-]', '', 'g'), '^[0-9a-f]{32}$') "
    r"THEN regexp_replace(regexp_replace(regexp_replace(low, '^urn:uuid:', ''), '[{}\s-]', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') ELSE low END"
)


def _fold(column: str) -> str:
    return rf"nullif(lower(regexp_replace({column}, '^\s+|\s+$', '', 'g')), '')"


def _uuid(column: str) -> str:
    return _UUID.replace("low", _fold(column))


P4_FOUND = f"""
WITH s AS (SELECT DISTINCT sample_id, {_uuid('source_uuid')} AS source_uuid, {_fold('partition')} AS part FROM sft_samples WHERE sample_id IS NOT NULL)
SELECT source_uuid FROM s WHERE source_uuid IS NOT NULL AND part IN ('train', 'validation', 'test_iid', 'test_ood')
GROUP BY source_uuid HAVING count(DISTINCT part) > 1
"""

P5_FOUND = f"""
WITH stats AS (SELECT {_uuid('uuid')} AS uuid, max(max_same_tool_success_count) AS n FROM nemotron_uuid_same_tool_success_stats WHERE uuid IS NOT NULL GROUP BY 1),
samples AS (SELECT sample_id, max({_fold('sample_type')}) AS sample_type, max(focal_tool_success_count_at_decision) AS focal FROM sft_samples WHERE sample_id IS NOT NULL GROUP BY 1),
have AS (
  SELECT 'count_bucket' AS target_set, CASE WHEN n BETWEEN 0 AND 3 THEN 'c' || n WHEN n >= 4 THEN 'c4_plus' END AS category, count(*) AS k FROM stats GROUP BY ALL
  UNION ALL SELECT 'sample_type', sample_type, count(*) FROM samples GROUP BY ALL
  UNION ALL SELECT 'focal_count', CAST(focal AS VARCHAR), count(*) FROM samples GROUP BY ALL),
keys AS (SELECT target_set, sum(k) AS k FROM have GROUP BY 1),
t AS (SELECT {_fold('target_set')} AS target_set, {_fold('category')} AS category, max(target_share) AS s, max(min_rows) AS m, max(sample_share) AS p FROM sampling_targets GROUP BY 1, 2)
SELECT t.target_set, t.category FROM t LEFT JOIN keys USING (target_set) LEFT JOIN have ON have.target_set = t.target_set AND have.category = t.category
WHERE coalesce(have.k, 0) < greatest(coalesce(t.m, 0), ceil(t.s * floor(t.p * coalesce(keys.k, 0)::DOUBLE)))
"""


P2_FOUND = rf"""
WITH s AS (SELECT DISTINCT sample_id, {_fold('partition')} AS part, list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[1].content AS u FROM sft_samples WHERE sample_id IS NOT NULL),
k AS (SELECT sample_id, part = 'train' AS train, u FROM s WHERE part IN ('train', 'validation', 'test_iid', 'test_ood') AND u IS NOT NULL),
w AS (SELECT u, unnest(regexp_extract_all(regexp_replace(regexp_replace(strip_accents(lower(u)), '[\p{{Mn}}\p{{Cf}}]', '', 'g'), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')) AS word FROM (SELECT DISTINCT u FROM k)),
c AS (SELECT u, word, count(*) AS c FROM w GROUP BY ALL),
n AS (SELECT u, sum(c) AS n, bool_or(train) AS a, bool_or(NOT train) AS b FROM c JOIN (SELECT DISTINCT u, train FROM k) USING (u) GROUP BY u),
z AS (SELECT u, sum(c) AS n FROM c GROUP BY u),
p AS (SELECT x.u AS ua, y.u AS ub, sum(least(x.c, y.c)) AS shared FROM c x JOIN c y ON x.word = y.word JOIN n nx ON nx.u = x.u AND nx.a JOIN n ny ON ny.u = y.u AND ny.b GROUP BY x.u, y.u),
near AS (SELECT ua, ub FROM p JOIN z za ON za.u = ua JOIN z zb ON zb.u = ub WHERE shared * 20 >= 17 * greatest(za.n, zb.n))
SELECT DISTINCT least(t.sample_id, e.sample_id) AS sample_id_a, greatest(t.sample_id, e.sample_id) AS sample_id_b FROM near JOIN k t ON t.train AND t.u = ua JOIN k e ON NOT e.train AND e.u = ub WHERE t.sample_id <> e.sample_id
"""


# the same parts, with every text's words in order for its class
_P2_CLASSES = P2_FOUND[: P2_FOUND.rindex("SELECT DISTINCT least(")].rstrip() + r""",
class AS (SELECT u, md5(string_agg(word, ' ' ORDER BY word)) AS class FROM w GROUP BY u),
m AS (SELECT k.sample_id, k.train, s.part, s.subset, class.class FROM k JOIN class USING (u) JOIN (SELECT DISTINCT sample_id, lower(trim(partition)) AS part, @SUBSET AS subset FROM sft_samples) s ON s.sample_id = k.sample_id),
cp AS (SELECT a.class AS train_class, b.class AS eval_class, max(p.shared) AS shared, max(greatest(za.n, zb.n)) AS longer FROM near JOIN p USING (ua, ub) JOIN z za ON za.u = ua JOIN z zb ON zb.u = ub JOIN class a ON a.u = ua JOIN class b ON b.u = ub GROUP BY ALL)
""".replace("@SUBSET", _fold("source_subset"))
P2_PAIRS = _P2_CLASSES + "SELECT train_class, eval_class, shared::BIGINT AS shared, longer::BIGINT AS longer FROM cp"
P2_MEMBERS = _P2_CLASSES + "SELECT DISTINCT sample_id, train AS is_train, part AS partition, subset AS source_subset, class AS class_id FROM m"
_P2_COUNTS = _P2_CLASSES.rstrip() + """,
t AS (SELECT class, count(DISTINCT sample_id) AS n FROM m WHERE train GROUP BY class),
l AS (SELECT eval_class, sum(t.n)::BIGINT AS n FROM cp JOIN t ON t.class = cp.train_class GROUP BY eval_class),
e AS (SELECT DISTINCT sample_id, part, subset, class FROM m WHERE NOT train)
"""
P2_LINKS = _P2_COUNTS + "SELECT e.sample_id AS eval_id, e.part AS partition, e.subset AS source_subset, e.class AS class_id, coalesce(l.n, 0) AS n_links FROM e LEFT JOIN l ON l.eval_class = e.class"
P2_REPORT = _P2_COUNTS + "SELECT e.part AS partition, e.subset AS source_subset, coalesce(sum(l.n), 0)::BIGINT AS pairs, count(l.n) AS overlapping, count(*) AS samples FROM e LEFT JOIN l ON l.eval_class = e.class GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_pairs": P2_PAIRS, "p2_members": P2_MEMBERS, "p2_links": P2_LINKS, "p2_report": P2_REPORT, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
