"""SQL for DuckDB that gives what the queries of :mod:`alertweave.plans.reference` give."""

from __future__ import annotations

from alertweave.functions import normalize as N
from alertweave.operators import predicates as P
from alertweave.plans.general import _entries
from alertweave.plans.reference import DOMAINS, SCENARIOS, SUFFIXES, TAUS


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


U, I, H = (_entries(f"entity_{k}") for k in ("users", "ips", "hosts"))
ENT = f"list_concat([('user:' || x) for x in {U}], list_concat([('ip:' || x) for x in {I}], [('host:' || x) for x in {H}]))"
ROWS = "alerts AS (SELECT *, CAST(CASE WHEN cluster_id < 0 THEN -1 ELSE cluster_id % 61 END AS BIGINT) AS community_id FROM real_alerts_clustered)"
SAFE = "list_filter(coalesce({}, []), lambda x: x is not null and x <> '')"
CSV = "list_filter([lower(trim(x)) for x in string_split(coalesce({}, ''), ',')], lambda x: x <> '')"
LISTED = f"{ROWS}, listed AS (SELECT DISTINCT row_id, decoder_name, unnest({ENT}) AS entity FROM alerts)"
JOINED = lambda c: f"array_to_string(list_sort(list_distinct(flatten(list({c})))), '|')"
BIG = lambda x: f"CAST({x} AS BIGINT)"

PAIRS = f"""{LISTED}, few AS (SELECT entity FROM listed GROUP BY entity HAVING count(*) BETWEEN 2 AND 400),
post AS (SELECT row_id, entity FROM listed SEMI JOIN few USING (entity)),
pairs AS (SELECT p.row_id AS a, q.row_id AS b, count(*) AS shared FROM post p JOIN post q ON p.entity = q.entity AND p.row_id < q.row_id GROUP BY 1, 2)"""
EDGES = f"""{PAIRS}, times AS (SELECT row_id, epoch_us(alert_ts) / 1e6 AS lo, epoch_us(alert_ts) / 1e6 + least("count", 600) AS hi FROM alerts),
edges AS (SELECT a, b, shared, greatest(0.0, greatest(x.lo, y.lo) - least(x.hi, y.hi)) AS dt FROM pairs JOIN times x ON x.row_id = a JOIN times y ON y.row_id = b)"""
DECAY = {
    "none": "1.0", "exponential": "exp(-dt / 3600.0)", "gaussian": "exp(-(dt / 3600.0) * (dt / 3600.0))", "linear": "greatest(0.0, 1 - dt / 3600.0)", "power": "1 / (1 + dt / 3600.0)",
    "cutoff": "CASE WHEN dt > 60 THEN 0.0 ELSE 1.0 END",
}
STRONG = f"{EDGES}, strong AS (SELECT a, b FROM edges WHERE shared * exp(-dt / 3600.0) >= 1.0)"


def _weights(kind: str) -> str:
    return f"WITH {EDGES}, w AS (SELECT *, shared * {DECAY[kind]} AS w FROM edges) SELECT a, b, shared, round(dt, 3) AS dt, round(w, 6) AS w FROM w WHERE w > 0 AND w >= 0.001"


OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
_bare_ip = lambda any_case: f"(CASE WHEN starts_with({'lower(b)' if any_case else 'b'}, '::ffff:') THEN substr(b, 8) ELSE b END)"
_ours = "(" + " OR ".join(f"dom = '{d}' OR ends_with(dom, '.{d}')" for d in DOMAINS) + ")"
_suffix = "|".join(x.replace(".", "\\.") for x in sorted(SUFFIXES, key=lambda x: (-len(x), x)))

_CLUSTERED = """summ AS (SELECT {g}, count(*) AS size, CAST(sum("count") AS BIGINT) AS n_alerts, array_to_string(list_sort(list(DISTINCT decoder_name)), ',') AS decoders,
array_to_string(list_sort(list(DISTINCT rule_id))[1:5], ',') AS rules, count(DISTINCT cluster_id) AS n_clusters, epoch_us(min(alert_ts)) AS first_us, epoch_us(max(alert_ts)) AS last_us
FROM alerts WHERE {g} >= 0 GROUP BY {g})"""
_HEAVY = """(SELECT community_id, array_to_string(list(item ORDER BY rnk), ',') AS v FROM (SELECT community_id, item, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, item) AS rnk
FROM (SELECT community_id, unnest({items}) AS item FROM alerts WHERE community_id >= 0) WHERE item <> '' GROUP BY community_id, item) WHERE rnk <= 10 GROUP BY community_id) {name}"""
SEEN = f"""{ROWS}, seen AS (SELECT *, alert_ts AS first_ts, alert_ts + to_seconds(least("count", 600)) AS last_ts FROM alerts)"""
_SPAN = "epoch_us(min(first_ts)) AS first_us, epoch_us(max(last_ts)) AS last_us, CAST(coalesce(trunc((epoch_us(max(last_ts)) - epoch_us(min(first_ts))) / 1e6), 0) AS BIGINT) AS duration_seconds"
_NAMES = "array_to_string(list_sort(list(DISTINCT decoder_name)), ',') AS decoders, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules"
_PARTS = "list_filter([trim(x) for x in string_split(coalesce({}, ''), ',')], lambda x: x <> '')"
_TOLD = {
    "rules": ("[coalesce(rule_id, 'None')]", 8), "descriptions": ("[rule_description]", 6), "users": (SAFE.format("entity_users"), 10), "ips": (SAFE.format("entity_ips"), 10), "hosts": (SAFE.format("entity_hosts"), 10),
    "tactics": (_PARTS.format("mitre_tactic"), None), "techniques": (_PARTS.format("mitre_technique"), None), "decoders": ("[coalesce(decoder_name, 'None')]", None),
}
_LISTS = {"top_ips": SAFE.format("entity_ips"), "top_users": SAFE.format("entity_users"), "top_hosts": SAFE.format("entity_hosts"), "mitre_tactics": _PARTS.format("mitre_tactic"), "mitre_techniques": _PARTS.format("mitre_technique")}

_CASE = " ".join(f"WHEN first = '{v}' THEN '{k}'" for k, v in SCENARIOS.items())
HITS = f"""{LISTED}, hits AS (SELECT DISTINCT row_id, scenario FROM (SELECT row_id, CASE {_CASE} END AS scenario FROM
(SELECT row_id, string_split(substr(entity, 6), '.')[1] AS first FROM listed WHERE entity LIKE 'user:%')) WHERE scenario IS NOT NULL),
scen AS (SELECT unnest([{', '.join(f"'{k}'" for k in SCENARIOS)}]) AS scenario)"""


def _scored(c: str, name: str) -> str:
    return f"""{name}r AS (SELECT row_id, CAST({c} AS BIGINT) AS comm, decoder_name FROM alerts),
{name}p AS (SELECT scenario, comm, count(*) AS n FROM hits JOIN {name}r USING (row_id) GROUP BY ALL),
{name}t AS (SELECT scenario, CAST(sum(n) AS BIGINT) AS n_rows FROM {name}p GROUP BY 1),
{name}m AS (SELECT scenario, comm AS main_comm, n FROM {name}p WHERE comm >= 0 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n DESC, comm) = 1),
{name}s AS (SELECT comm AS main_comm, count(*) AS size, count(DISTINCT decoder_name) AS d FROM {name}r WHERE comm >= 0 GROUP BY 1),
{name} AS (SELECT scenario, coalesce(n_rows, 0) AS n_rows, main_comm, round(n / n_rows, 6) AS recall, round(n / size, 6) AS purity, coalesce(d > 1, false) AS is_cross
FROM scen LEFT JOIN {name}t USING (scenario) LEFT JOIN {name}m USING (scenario) LEFT JOIN {name}s USING (main_comm))"""


PLACED = f"""{ROWS}, spans AS (SELECT row_id AS node, CAST(cluster_id AS BIGINT) AS community, epoch_us(alert_ts) / 1e6 AS lo, epoch_us(alert_ts) / 1e6 + least("count", 600) AS hi FROM alerts),
held AS (SELECT DISTINCT row_id AS node, unnest([('user:' || x) for x in {U}]) AS entity FROM alerts),
csize AS (SELECT community, min(lo) AS lo, max(hi) AS hi, count(*) AS size FROM spans WHERE community >= 0 GROUP BY 1),
ce AS (SELECT DISTINCT community, entity FROM held JOIN spans USING (node) WHERE community >= 0),
ovl AS (SELECT DISTINCT p.community AS a, q.community AS b FROM ce p JOIN ce q ON p.entity = q.entity AND p.community < q.community JOIN csize x ON x.community = p.community
JOIN csize y ON y.community = q.community WHERE x.lo <= y.hi AND x.hi >= y.lo AND (x.size < 30 OR y.size < 30))"""

SQL = {
    "dedup_hourly": f"""SELECT coalesce(decoder_name, '') AS decoder_name, coalesce(rule_id, '') AS rule_id, coalesce(source_address, '') AS source_address, coalesce(destination_address, '') AS destination_address,
        coalesce(list_min(list_filter(entity_users, lambda x: x is not null)), '') AS user_key, {BIG("floor(epoch_us(alert_ts) / 3600000000)")} AS bucket, count(*) AS n_alerts, epoch_us(min(alert_ts)) AS first_us,
        epoch_us(max(alert_ts)) AS last_us, arg_min(row_id, (alert_ts, row_id)) AS first_row_id, arg_min(struct_pack(v := rule_level), (alert_ts, row_id)).v AS rule_level,
        arg_min(struct_pack(v := rule_description), (alert_ts, row_id)).v AS rule_description, {JOINED("coalesce(entity_users, [])")} AS entity_users, {JOINED("coalesce(entity_ips, [])")} AS entity_ips,
        {JOINED("coalesce(entity_hosts, [])")} AS entity_hosts FROM real_alerts_clustered
        GROUP BY 1, 2, 3, 4, 5, 6""",
    "reduction_kpis": f"""WITH {ROWS}, s AS (SELECT {BIG('sum("count")')} AS n_alerts, count(*) AS n_rows, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters,
        count(DISTINCT CASE WHEN community_id >= 0 THEN community_id END) AS n_communities FROM alerts)
        SELECT *, round(1 - n_rows / n_alerts, 6) AS dedup_reduction, round(1 - n_communities / n_alerts, 6) AS total_reduction, round(n_alerts / n_communities, 4) AS factor FROM s""",
    "repetition_analysis": f"""WITH k AS (SELECT count(*) AS n FROM real_alerts_clustered GROUP BY coalesce(decoder_name, ''), coalesce(rule_id, ''), coalesce(source_address, ''), coalesce(destination_address, ''), coalesce({SAFE.format("entity_users")}[1], ''))
        SELECT count(*) AS n_keys, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_repeated, {BIG("sum(n) - count(*)")} AS n_redundant, round((sum(n) - count(*)) / sum(n), 6) AS redundant_ratio FROM k""",
    "freq_tables": f"""WITH p AS (SELECT 'decoder' AS dimension, decoder_name AS item, 20 AS k FROM real_alerts_clustered UNION ALL SELECT 'level', CAST(rule_level AS VARCHAR), 20 FROM real_alerts_clustered
        UNION ALL SELECT 'rule', rule_id || '|' || substr(rule_description, 1, 80), 30 FROM real_alerts_clustered UNION ALL SELECT 'group', unnest({CSV.format("rule_groups")}), 25 FROM real_alerts_clustered
        UNION ALL SELECT 'tactic', unnest({CSV.format("mitre_tactic")}), 15 FROM real_alerts_clustered UNION ALL SELECT 'agent', agent_name, 15 FROM real_alerts_clustered),
        c AS (SELECT dimension, item, k, count(*) AS n FROM p WHERE item IS NOT NULL AND item <> '' GROUP BY ALL)
        SELECT dimension, item, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, item) AS INTEGER) AS rnk, FROM c QUALIFY rnk <= k""".replace(", FROM c QUALIFY", " FROM c QUALIFY"),
    "field_coverage": "WITH top AS (SELECT decoder_name FROM real_alerts_clustered WHERE decoder_name <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), f AS ("
    + " UNION ALL ".join(f"SELECT decoder_name, '{c}' AS field FROM real_alerts_clustered WHERE {c} IS NOT NULL" for c in ("rule_level", "rule_groups", "mitre_id", "source_address", "destination_address", "agent_name", "first_seen", "last_seen"))
    + ") SELECT decoder_name, field, count(*) AS n FROM f SEMI JOIN top USING (decoder_name) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY decoder_name ORDER BY count(*) DESC, field) <= 12",
    "entity_cardinality": f"""WITH p AS (SELECT decoder_name, 'user' AS kind, unnest({U}) AS item FROM real_alerts_clustered UNION ALL SELECT decoder_name, 'ip', unnest({I}) FROM real_alerts_clustered UNION ALL SELECT decoder_name, 'host', unnest({H}) FROM real_alerts_clustered),
        c AS (SELECT decoder_name, kind, item, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY decoder_name, kind ORDER BY n DESC, item) AS rnk FROM c)
        SELECT decoder_name, kind, count(*) AS n_unique, array_to_string(list(item ORDER BY rnk) FILTER (rnk <= 3), ',') AS top FROM r GROUP BY ALL""",
    "stratum_share": """SELECT decoder_name, rule_id, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM real_alerts_clustered), 4) AS pct, row_number() OVER (ORDER BY count(*) DESC, decoder_name, rule_id) AS rnk
        FROM real_alerts_clustered GROUP BY 1, 2 QUALIFY rnk <= 10""",
    "hash_sample": """WITH o AS (SELECT decoder_name, count(*) FILTER ((row_id * 2654435761) % 1000000 < 100000) AS n_sample, count(*) AS n_origin FROM real_alerts_clustered GROUP BY 1)
        SELECT *, round(100 * n_sample / sum(n_sample) OVER (), 4) AS pct_sample, round(100 * n_origin / sum(n_origin) OVER (), 4) AS pct_origin FROM o""",
    "time_reassign": "SELECT row_id, round(3600.0 * (row_number() OVER (ORDER BY alert_ts, row_id) - 1) / greatest(1, count(*) OVER () - 1), 6) AS offset_s FROM real_alerts_clustered",
    "predicates_null_semantics": """SELECT variant, count(*) FILTER (p) AS n_kept FROM (SELECT unnest([
        {'variant': 'search', 'p': alert_ts BETWEEN TIMESTAMPTZ '2025-10-05 00:00:00+00' AND TIMESTAMPTZ '2025-10-20 00:00:00+00' AND NOT coalesce(rule_id IN ('41000', '42000'), false) AND NOT coalesce(decoder_name = 'web-proxy', false) AND coalesce(rule_level >= 5, false)},
        {'variant': 'file', 'p': rule_level IS NULL OR rule_level >= 5},
        {'variant': 'sample', 'p': coalesce(rule_level, 0) >= 5 AND coalesce(rule_id, '?') NOT IN ('41000', '42000') AND coalesce(decoder_name, '?') <> 'web-proxy'},
        {'variant': 'sentinel', 'p': coalesce(contains(lower(decoder_name), 'edge'), false)}, {'variant': 'noise', 'p': cluster_id < 0}], recursive := true) FROM real_alerts_clustered) GROUP BY 1""",
    "user_norm": f"""WITH raw AS (SELECT DISTINCT unnest(entity_users) AS raw FROM real_alerts_clustered), t AS (SELECT raw, lower(string_split(trim(raw), chr(92))[-1]) AS s, CASE WHEN trim(raw) <> '' THEN 1 END AS filled FROM raw WHERE raw IS NOT NULL),
        u AS (SELECT raw, filled, s, string_split(s, '@')[1] AS name, string_split(s, '@')[-1] AS dom FROM t),
        v AS (SELECT *, regexp_replace(trim(string_split(CASE WHEN contains(s, '@') AND {_ours} THEN name ELSE s END, '(')[1]), '[,.;:]+$', '') AS st, regexp_split_to_array(trim(name), '\\s+')[1] AS si,
        regexp_replace(trim(string_split(regexp_replace(lower(trim(raw)), '^user:', ''), chr(92))[-1].string_split('@')[1]), '[,.;:]+$', '') AS cl FROM u),
        w AS (SELECT *, CASE WHEN filled = 1 AND cl NOT IN {_in(N.ASSET_GENERIC_USERS)} THEN cl END AS clean FROM v)
        SELECT raw, CASE WHEN filled = 1 AND st <> '' THEN 'user:' || st END AS strict_name, CASE WHEN filled = 1 AND si NOT IN {_in(N.GENERIC_USERS_SIMPLE)} THEN si END AS simple_name, clean AS clean_name,
        trim(regexp_replace(clean, '[._-]+', ' ', 'g')) AS identity FROM w""",
    "ip_norm": f"""WITH raw AS (SELECT DISTINCT unnest(entity_ips) AS raw FROM real_alerts_clustered), t AS (SELECT raw, string_split(trim(raw), '/')[1] AS b FROM raw WHERE raw IS NOT NULL),
        u AS (SELECT raw, {_bare_ip(True)} AS s, {_bare_ip(False)} AS z, trim(CASE WHEN starts_with(lower(string_split(regexp_replace(trim(raw), '^ip:', ''), '/')[1]), '::ffff:') THEN substr(string_split(regexp_replace(trim(raw), '^ip:', ''), '/')[1], 8) ELSE string_split(regexp_replace(trim(raw), '^ip:', ''), '/')[1] END) AS c FROM t)
        SELECT raw, CASE WHEN regexp_matches(s, '{V4}') THEN CASE WHEN NOT starts_with(s, '127.') AND s NOT IN ('0.0.0.0', '255.255.255.255') THEN 'ip:' || s END WHEN contains(s, ':') AND s NOT IN ('::', '::1') AND regexp_matches(s, '^[0-9a-fA-F:.]+$') THEN 'ip:' || lower(s) END AS strict_ip,
        CASE WHEN regexp_matches(z, '{V4}') THEN CASE WHEN NOT starts_with(z, '127.') AND z <> '0.0.0.0' AND NOT coalesce(try_cast(string_split(z, '.')[1] AS INTEGER) BETWEEN 224 AND 239, false) THEN z END WHEN contains(z, ':') AND z NOT IN ('::', '::1') AND NOT starts_with(lower(z), 'ff') AND regexp_matches(z, '^[0-9a-fA-F:.]+$') THEN lower(z) END AS simple_ip,
        CASE WHEN regexp_matches(c, '^\\d{{1,9}}(\\.\\d{{1,9}}){{3}}$') AND len(list_filter([try_cast(x AS BIGINT) for x in string_split(c, '.')], lambda x: x > 255)) = 0 AND c NOT IN ('0.0.0.0', '127.0.0.1', '255.255.255.255') THEN c END AS clean_ip FROM u""",
    "host_norm": f"""WITH raw AS (SELECT DISTINCT unnest(entity_hosts) AS raw FROM real_alerts_clustered), t AS (SELECT raw, CASE WHEN trim(raw) <> '' THEN lower(trim(raw)) END AS s FROM raw WHERE raw IS NOT NULL),
        u AS (SELECT raw, s, regexp_replace(s, '^(.*?)({_suffix})$', '\\1') AS x, CASE WHEN contains(s, '.') AND string_split(s, '.')[1] <> '' THEN string_split(s, '.')[1] ELSE s END AS short,
        trim(regexp_replace(regexp_replace(s, '^host:', ''), '(\\.labcorp\\.local|\\.corp\\.local|\\.domain\\.local|\\.vsphere\\.local|\\.local)$', '')) AS c FROM t),
        v AS (SELECT *, CASE WHEN NOT regexp_matches(x, '{V4}') THEN string_split(x, '.')[1] ELSE x END AS y, regexp_matches(x, '^[0-9a-f:]*:[0-9a-f:.]*$') AS colon FROM u)
        SELECT raw, CASE WHEN y NOT IN {_in(N.GENERIC_HOSTS_STRICT)} AND NOT regexp_matches(y, '{V4}') AND NOT colon THEN 'host:' || y END AS strict_host,
        CASE WHEN NOT regexp_matches(s, '{V4}') AND short NOT IN {_in(N.GENERIC_HOSTS_SIMPLE)} THEN short END AS simple_host, CASE WHEN c NOT IN ('', 'localhost', 'none', 'null', 'unknown', '-', 'n/a') THEN c END AS clean_host FROM v""",
    "match_forms": r"""WITH raw AS (SELECT DISTINCT unnest(entity_users) AS raw FROM real_alerts_clustered), t AS (SELECT raw, lower(trim(raw)) AS s FROM raw WHERE raw IS NOT NULL)
        SELECT raw, array_to_string(list_sort(list_filter(list_distinct([s, string_split(s, '@')[1], string_split(s, chr(92))[-1]]), lambda x: x <> '')), '|') AS variants, regexp_replace(raw, '-[0-9a-f]{6,}$', '') AS base,
        regexp_replace(raw, '[0-9]', 'd', 'g') AS shape FROM t""",
    "alias_assign": f"""WITH u AS (SELECT canonical, min(us) AS us FROM (SELECT unnest({U}) AS canonical, epoch_us(alert_ts) AS us FROM real_alerts_clustered) GROUP BY 1)
        SELECT canonical, row_number() OVER (ORDER BY us, canonical) AS id, printf('user_%04d_anonymized', row_number() OVER (ORDER BY us, canonical)) AS alias FROM u""",
    "pseudonymised_users": f"""WITH l AS (SELECT row_id, unnest({U}) AS canonical, epoch_us(alert_ts) AS us FROM real_alerts_clustered), u AS (SELECT canonical, min(us) AS us FROM l GROUP BY 1),
        n AS (SELECT canonical, printf('user_%04d_anonymized', row_number() OVER (ORDER BY us, canonical)) AS alias FROM u) SELECT row_id, alias FROM l JOIN n USING (canonical)""",
}

_MAP = f"""amap AS (SELECT ip, arg_min(struct_pack(host := host, source := source), (priority, seq, host)) AS x FROM (SELECT {I}[1] AS ip, {H}[1] AS host, decoder_name AS source,
CASE WHEN contains(lower(decoder_name), 'edr') THEN 0 ELSE 1 END AS priority, row_id AS seq FROM real_alerts_clustered WHERE len({I}) = 1 AND len({H}) = 1) GROUP BY ip)"""
_COMP = """RECURSIVE ends AS (SELECT a AS src, b AS dst FROM {e} UNION SELECT b, a FROM {e}), reach AS (SELECT src AS node, src AS c FROM ends UNION SELECT ends.dst, reach.c FROM reach JOIN ends ON ends.src = reach.node)"""

SQL |= {
    "asset_map": f"WITH {_MAP} SELECT ip, x.host AS host, x.source AS source FROM amap",
    "asset_stats": f"WITH {_MAP} SELECT count(*) AS n_ips, count(DISTINCT x.host) AS n_hosts, count(DISTINCT x.source) AS n_sources FROM amap",
    "asset_resolve": f"""WITH {LISTED}, {_MAP}, known AS (SELECT 'ip:' || ip AS entity, 'asset:' || x.host AS t FROM amap UNION SELECT 'host:' || x.host, 'asset:' || x.host FROM amap)
        SELECT entity, coalesce(t, entity) AS resolved FROM (SELECT DISTINCT entity FROM listed) LEFT JOIN known USING (entity)""",
    "user_alias_groups": f"""WITH n AS ({SQL["user_norm"]}), c AS (SELECT DISTINCT identity AS k, clean_name AS variant FROM n WHERE identity IS NOT NULL),
        h AS (SELECT k, coalesce(min(CASE WHEN contains(variant, '.') THEN variant END), min(variant)) AS canonical FROM c GROUP BY k HAVING count(*) >= 2)
        SELECT variant, arg_max(canonical, k) AS canonical FROM c JOIN h USING (k) GROUP BY variant""",
    "promiscuous_entities": f"""WITH {LISTED} SELECT entity, count(*) AS n_rows, count(DISTINCT decoder_name) AS n_decoders, count(*) >= greatest(3, round_even((SELECT count(*) FROM alerts) * 0.1, 0)) OR count(DISTINCT decoder_name) > 4 AS dropped FROM listed GROUP BY entity""",
    "bridge_filter": f"""WITH {ROWS}, per AS (SELECT cluster_id, sum("count") AS n_alerts, min(decoder_name) AS decoder_name FROM alerts WHERE cluster_id >= 0 GROUP BY 1),
        m AS (SELECT DISTINCT cluster_id, unnest({ENT}) AS entity FROM alerts WHERE cluster_id >= 0), x AS (SELECT entity, decoder_name, count(*) AS k, sum(n_alerts) AS a FROM m JOIN per USING (cluster_id) GROUP BY ALL),
        e AS (SELECT entity, sum(k) AS k, sum(a) AS a, count(decoder_name) AS d, max(CASE WHEN decoder_name IS NOT NULL THEN k END) AS most,
        entity IN {_in(P.INFRASTRUCTURE)} OR regexp_matches(entity, '{"|".join(P.INFRASTRUCTURE_PATTERNS)}') AS infra FROM x GROUP BY entity)
        SELECT entity, infra AS by_blocklist, NOT infra AND k >= greatest(2, round_even((SELECT count(*) FROM per) * 0.5, 0)) AS by_clusters, NOT infra AND a >= (SELECT sum(n_alerts) FROM per) * 0.3 AS by_volume,
        NOT infra AND d > 4 AS by_decoders, NOT infra AND coalesce(most > 2, false) AS by_same_decoder FROM e""",
    "entity_pairs": f"WITH {PAIRS} SELECT a, b, shared FROM pairs",
    "edge_stats": f"""WITH {EDGES}, w AS (SELECT shared * exp(-dt / 3600.0) AS w FROM edges WHERE shared * exp(-dt / 3600.0) >= 0.001)
        SELECT (SELECT count(*) FROM alerts) AS n_nodes, count(*) AS n_edges, round(sum(w), 4) AS w_sum, round(avg(w), 6) AS w_mean, round(2 * count(*) / (SELECT count(*) FROM alerts), 6) AS mean_degree FROM w""",
    "dt_quantiles": f"WITH {EDGES}, r AS (SELECT round(dt, 3) AS dt FROM edges) SELECT " + ", ".join(f"round(quantile_cont(dt, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p995", 0.995))) + " FROM r",
    "tau_sweep_edges": f"WITH {EDGES}, t AS (" + " UNION ALL ".join(f"SELECT {'NULL' if t is None else t}::DOUBLE AS tau, shared * {'1.0' if t is None else f'exp(-dt / {t})'} AS w FROM edges" for t in TAUS) + ") SELECT tau, count(*) AS n_edges, round(sum(w), 4) AS w_sum FROM t WHERE w >= 0.1 GROUP BY tau",
    "connected_components": f"WITH RECURSIVE {STRONG}, {_COMP.format(e='strong').removeprefix('RECURSIVE ')} SELECT row_id AS node, coalesce(c, row_id) AS component FROM alerts LEFT JOIN (SELECT node, min(c) AS c FROM reach GROUP BY 1) ON node = row_id",
    "overlapping_communities": f"WITH {PLACED} SELECT a, b FROM ovl",
    "consolidate_small": f"""WITH RECURSIVE {PLACED}, {_COMP.format(e='ovl').removeprefix('RECURSIVE ')}, g AS (SELECT community, coalesce(min(c), community) AS comp, any_value(size) AS size FROM csize LEFT JOIN reach ON node = community GROUP BY community),
        h AS (SELECT comp, community AS head FROM g QUALIFY row_number() OVER (PARTITION BY comp ORDER BY size DESC, community) = 1), r AS (SELECT community, dense_rank() OVER (ORDER BY head) - 1 AS new FROM g JOIN h USING (comp))
        SELECT node, coalesce(new, -1) AS community FROM spans LEFT JOIN r USING (community)""",
    "cluster_summary": f"WITH {ROWS}, {_CLUSTERED.format(g='cluster_id')} SELECT * FROM summ ORDER BY n_alerts DESC, cluster_id LIMIT 20",
    "community_summary": f"WITH {ROWS}, {_CLUSTERED.format(g='community_id')} SELECT * FROM summ ORDER BY n_alerts DESC, community_id LIMIT 15",
    "heavy_entities": f"""SELECT decoder_name, item, count(*) AS n, row_number() OVER (PARTITION BY decoder_name ORDER BY count(*) DESC, item) AS rnk FROM (SELECT decoder_name, unnest({H}) AS item FROM real_alerts_clustered) GROUP BY 1, 2 QUALIFY rnk <= 5""",
    "community_docs": f"""WITH {SEEN}, base AS (SELECT community_id, {_SPAN}, {BIG('sum("count")')} AS n_alerts, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_rows, coalesce(bool_or(is_replay), false) AS has_replay,
        {_NAMES}, 'run-1' AS run_id, false AS is_summary, round(sum("count") / count(*), 2) AS reduction_factor FROM seen WHERE community_id >= 0 GROUP BY 1),
        d AS (SELECT community_id, string_agg(rule_description, ' | ' ORDER BY arrived, rule_description) AS v FROM (SELECT community_id, rule_description, min(row_id) AS arrived FROM seen WHERE community_id >= 0 AND rule_description IS NOT NULL GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY min(row_id), rule_description) <= 5) GROUP BY 1)
        SELECT base.*, coalesce(d.v, '') AS rule_descriptions, NULL::DOUBLE AS severity_score, NULL::VARCHAR AS incident_summary, NULL::VARCHAR AS incident_category, """
    + ", ".join(f"coalesce({n}.v, '') AS {n}" for n in _LISTS)
    + " FROM base LEFT JOIN d USING (community_id) "
    + " ".join(f"LEFT JOIN {_HEAVY.format(items=i, name=n).replace('FROM alerts', 'FROM seen')} ON {n}.community_id = base.community_id" for n, i in _LISTS.items()),
    "run_summary": f"""WITH {SEEN} SELECT -1 AS community_id, 'run-1' AS run_id, true AS is_summary, {_SPAN}, {BIG('sum("count")')} AS n_alerts, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters, count(*) AS n_rows,
        round(sum("count") / count(DISTINCT CASE WHEN community_id >= 0 THEN community_id END), 2) AS reduction_factor, {_NAMES}, 'Resumen del run' AS rule_descriptions, '' AS top_ips, '' AS top_users, '' AS top_hosts, '' AS mitre_tactics, '' AS mitre_techniques,
        false AS has_replay, NULL::DOUBLE AS severity_score, NULL::VARCHAR AS incident_summary, '__summary__' AS incident_category FROM seen""",
    "bridge_entities": f"""WITH {ROWS}, e AS (SELECT DISTINCT community_id, cluster_id, row_id, unnest({ENT}) AS entity FROM alerts WHERE community_id >= 0), t AS (SELECT community_id, count(DISTINCT cluster_id) AS total FROM alerts WHERE community_id >= 0 GROUP BY 1),
        p AS (SELECT community_id, entity, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_rows FROM e GROUP BY 1, 2 HAVING count(DISTINCT cluster_id) >= 2)
        SELECT community_id, entity, n_clusters, n_rows, round(n_clusters / total, 6) AS pct, CASE WHEN n_clusters / total > 0.5 THEN 'very generic' WHEN n_clusters / total > 0.3 THEN 'generic' ELSE 'discriminating' END AS label
        FROM p JOIN t USING (community_id) QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n_clusters DESC, n_rows DESC, entity) <= 15""",
    "cluster_breakdown": f"""WITH {ROWS}, b AS (SELECT community_id, cluster_id, count(*) AS n_rows, {BIG('sum("count")')} AS n_alerts, array_to_string(list_sort(list(DISTINCT decoder_name)), ',') AS decoders, array_to_string(list_sort(list(DISTINCT rule_id))[1:3], ',') AS rules FROM alerts WHERE community_id >= 0 GROUP BY 1, 2),
        e AS (SELECT DISTINCT community_id, cluster_id, unnest({ENT}) AS entity FROM alerts WHERE community_id >= 0), k AS (SELECT *, count(*) OVER (PARTITION BY community_id, entity) AS k FROM e),
        c AS (SELECT community_id, cluster_id, count(*) FILTER (k > 1) AS n_bridge, count(*) FILTER (k = 1) AS n_unique, array_to_string(list_sort(list(entity) FILTER (k > 1))[1:10], ',') AS bridges, array_to_string(list_sort(list(entity) FILTER (k = 1))[1:10], ',') AS uniques FROM k GROUP BY 1, 2)
        SELECT community_id, cluster_id, n_rows, n_alerts, decoders, rules, coalesce(n_bridge, 0) AS n_bridge, coalesce(n_unique, 0) AS n_unique, coalesce(bridges, '') AS bridges, coalesce(uniques, '') AS uniques FROM b LEFT JOIN c USING (community_id, cluster_id)""",
    "cross_source": f"""WITH {ROWS} SELECT community_id, count(DISTINCT decoder_name) AS n_decoders, {BIG('sum("count")')} AS n_alerts, count(*) AS n_rows FROM alerts WHERE community_id >= 0 GROUP BY 1 HAVING count(DISTINCT decoder_name) > 1 ORDER BY n_alerts DESC, community_id LIMIT 10""",
    "entity_coverage": f"""WITH c AS (SELECT len({SAFE.format("entity_users")}) > 0 AS u, len({SAFE.format("entity_ips")}) > 0 AS i, len({SAFE.format("entity_hosts")}) > 0 AS h FROM real_alerts_clustered)
        SELECT round(avg(u::INTEGER), 6) AS users, round(avg(i::INTEGER), 6) AS ips, round(avg(h::INTEGER), 6) AS hosts, round(avg((u OR i OR h)::INTEGER), 6) AS any_entity FROM c""",
    "volume_timeline": f"""SELECT epoch_us(date_trunc('minute', alert_ts)) AS start_us, count(*) AS n_rows, {BIG('sum("count")')} AS n_alerts FROM real_alerts_clustered WHERE alert_ts IS NOT NULL GROUP BY 1""",
    "size_histogram": """WITH s AS (SELECT count(*) AS size FROM real_alerts_clustered WHERE cluster_id >= 0 GROUP BY cluster_id) SELECT least(20, CAST(floor((size - 1) / 10.0) AS BIGINT) + 1) AS bin, count(*) AS n FROM s WHERE size BETWEEN 1 AND 201 GROUP BY 1""",
    "log_histogram": """SELECT CAST(floor(log10("count") + 1e-12) AS BIGINT) AS bin, count(*) AS n FROM real_alerts_clustered WHERE "count" > 0 GROUP BY 1""",
    "triage_context": f"""WITH {SEEN}, base AS (SELECT community_id, count(*) AS n_rows, {BIG('sum("count")')} AS n_alerts, count(DISTINCT cluster_id) AS n_clusters, {_SPAN}, max(rule_level) AS max_level, count(DISTINCT coalesce(decoder_name, 'None')) > 1 AS is_cross FROM seen WHERE community_id >= 0 GROUP BY 1)
        SELECT base.*, """
    + ", ".join(f"coalesce({n}.v, '') AS {n}" for n in _TOLD)
    + " FROM base "
    + " ".join(
        f"""LEFT JOIN (SELECT community_id, string_agg({"item || ':' || n" if n == "rules" else "item"}, '|' ORDER BY n DESC, item) AS v FROM (SELECT community_id, item, count(*) AS n FROM (SELECT community_id, unnest({i}) AS item FROM seen WHERE community_id >= 0)
        WHERE item <> '' GROUP BY 1, 2 {f'QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, item) <= {k}' if k else ''}) GROUP BY 1) {n} ON {n}.community_id = base.community_id"""
        for n, (i, k) in _TOLD.items()
    ),
    "scenario_verdict": f"""WITH {HITS}, {_scored("community_id", "s")} SELECT scenario, n_rows, main_comm, recall, purity, is_cross, CASE WHEN n_rows = 0 THEN 'NOT DETECTED' WHEN main_comm IS NULL THEN 'NO COMMUNITY' WHEN count(main_comm) OVER (PARTITION BY main_comm) > 1 THEN 'FAIL shared'
        WHEN recall >= 0.3 AND purity >= 0.5 THEN 'OK' WHEN purity < 0.5 THEN 'WEAK purity' ELSE 'WEAK recall' END AS verdict FROM s""",
    "scenario_dispersion": f"""WITH {HITS}, p AS (SELECT scenario, community_id, count(*) AS n FROM hits JOIN alerts USING (row_id) WHERE community_id >= 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY n DESC, community_id) AS k FROM p)
        SELECT scenario, community_id, n FROM r WHERE k BETWEEN 2 AND 7""",
    "first_scenario": f"WITH {HITS} SELECT row_id, min(scenario) AS scenario FROM hits GROUP BY 1",
    "ab_compare": f"""WITH {HITS}, {_scored("community_id", "x")}, {_scored("cluster_id", "y")} SELECT scenario, x.recall AS recall_a, x.purity AS purity_a, y.recall AS recall_b, y.purity AS purity_b,
        CASE WHEN x.purity IS DISTINCT FROM y.purity THEN 'purity' WHEN x.recall IS DISTINCT FROM y.recall THEN 'recall' ELSE '' END AS changed FROM x FULL JOIN y USING (scenario)""",
    "ari_vmeasure": """WITH c AS (SELECT decoder_name AS t, cluster_id AS c, count(*) AS n FROM real_alerts_clustered WHERE decoder_name IS NOT NULL GROUP BY 1, 2), a AS (SELECT t, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT c, sum(n) AS n FROM c GROUP BY 1),
        s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(n * (n - 1) / 2) FROM a) AS xa, (SELECT sum(n * (n - 1) / 2) FROM b) AS xb, (SELECT sum(n) FROM c) AS n,
        (SELECT sum(n * ln(n)) FROM c) AS h, (SELECT sum(n * ln(n)) FROM a) AS ha, (SELECT sum(n * ln(n)) FROM b) AS hb), e AS (SELECT *, xa * xb / (n * (n - 1) / 2) AS ex, ln(n) - ha / n AS ht, ln(n) - hb / n AS hc FROM s),
        f AS (SELECT (x - ex) / ((xa + xb) / 2 - ex) AS ari, (ht + hc - (ln(n) - h / n)) / ht AS hom, (ht + hc - (ln(n) - h / n)) / hc AS com FROM e) SELECT round(ari, 6) AS ari, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v FROM f""",
    "cohesion_purity": """WITH c AS (SELECT decoder_name AS scenario, cluster_id AS c, count(*) AS n FROM real_alerts_clustered WHERE decoder_name IS NOT NULL GROUP BY 1, 2), m AS (SELECT * FROM c WHERE c >= 0 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n DESC, c) = 1)
        SELECT t.scenario, round(coalesce(m.n / t.n, 0), 6) AS cohesion, round(coalesce(m.n / z.n, 0), 6) AS purity FROM (SELECT scenario, sum(n) AS n FROM c GROUP BY 1) t LEFT JOIN m USING (scenario) LEFT JOIN (SELECT c, sum(n) AS n FROM c GROUP BY 1) z ON z.c = m.c""",
    "level_over_repetitions": "SELECT decoder_name, round(avg(coalesce(rule_level, 0)), 6) AS mean, round(stddev_pop(coalesce(rule_level, 0)), 6) AS std FROM real_alerts_clustered GROUP BY 1",
    "phase_pivot": f"""WITH {ROWS}, p AS (SELECT community_id, CASE WHEN len(list_filter({SAFE.format("entity_hosts")}, lambda x: contains(x, 'nx-gate'))) > 0 THEN 'A' WHEN len(list_filter({SAFE.format("entity_hosts")}, lambda x: contains(x, 'ad-core') OR contains(x, 'mail-hub'))) > 0 THEN 'B' END AS phase FROM alerts)
        SELECT community_id, count(*) FILTER (phase = 'A') AS a, count(*) FILTER (phase = 'B') AS b, count(*) FILTER (phase IS NULL) AS other, count(*) FILTER (phase = 'A') > 0 AND count(*) FILTER (phase = 'B') > 0 AS both FROM p GROUP BY 1""",
    "zscore_features": """WITH b AS (SELECT row_id, coalesce((epoch_us(alert_ts) - min(epoch_us(alert_ts)) OVER ()) / 1e6, 0.0) AS t, coalesce(rule_level, 0) AS l, ln(1 + "count") AS c FROM real_alerts_clustered)
        SELECT row_id, round(2 * (t - avg(t) OVER ()) / stddev_pop(t) OVER (), 5) AS z_t_seconds, round((l - avg(l) OVER ()) / stddev_pop(l) OVER (), 5) AS z_level, round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 5) AS z_log_count FROM b""",
    "dbscan_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), near AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_distance(p.e, q.e) <= 1.15),
        core AS (SELECT a AS node FROM near GROUP BY 1 HAVING count(*) + 1 >= 5), inner_ AS (SELECT a, b FROM near SEMI JOIN core ON node = a WHERE b IN (SELECT node FROM core)),
        reach AS (SELECT node, node AS c FROM core UNION SELECT b, c FROM reach JOIN inner_ ON a = node), comp AS (SELECT node, min(c) AS c FROM reach GROUP BY 1),
        border AS (SELECT a, min(b) AS via FROM near SEMI JOIN core ON node = b GROUP BY 1)
        SELECT vec_id, coalesce(x.c, y.c, -1) AS cluster_id FROM v LEFT JOIN comp x ON x.node = vec_id LEFT JOIN border ON a = vec_id LEFT JOIN comp y ON y.node = via""",
    "dash_total_alerts": "SELECT max(n_alerts) AS total_alerts FROM communities WHERE is_summary",
    "dash_total_alerts_variant": f"SELECT {BIG('sum(n_alerts)')} AS n_alerts FROM communities",
    "dash_communities": "SELECT count(DISTINCT community_id) AS n_communities FROM communities WHERE NOT is_summary",
    "dash_rows": "SELECT max(n_rows) AS n_rows FROM communities WHERE is_summary",
    "dash_factor": "SELECT round(max(reduction_factor)::DOUBLE, 3) AS factor FROM communities WHERE is_summary",
    "dash_rules": f"""WITH {ROWS} SELECT rule_id, {BIG('sum("count")')} AS n_alerts, count(*) AS n_rows, count(DISTINCT community_id) AS n_communities, max(rule_level) AS max_level FROM alerts WHERE rule_id IS NOT NULL GROUP BY 1 ORDER BY n_alerts DESC, rule_id LIMIT 30""",
    "dash_community_table": f"""SELECT community_id, {BIG("sum(n_alerts)")} AS n_alerts, max(n_clusters) AS n_clusters, max(duration_seconds) AS duration_seconds, """
    + ", ".join(f"array_to_string(list_sort({SAFE.format(f'arg_max({c}, n_alerts)')}), ',') AS {c}" for c in ("top_ips", "top_users", "rules"))
    + " FROM communities WHERE NOT is_summary GROUP BY 1 ORDER BY n_alerts DESC, community_id LIMIT 50",
    "dash_sizes": "SELECT CAST(CASE WHEN n_alerts >= 500 THEN 500 WHEN n_alerts >= 100 THEN 100 WHEN n_alerts >= 50 THEN 50 WHEN n_alerts >= 10 THEN 10 WHEN n_alerts >= 1 THEN 1 ELSE 0 END AS BIGINT) AS size_range, count(*) AS n FROM communities WHERE NOT is_summary GROUP BY 1",
    "dash_rules_decoders": """WITH g AS (SELECT rule_id, decoder_name, CAST(sum("count") AS BIGINT) AS n_alerts FROM real_alerts_clustered WHERE rule_id IS NOT NULL AND decoder_name IS NOT NULL GROUP BY 1, 2), t AS (SELECT rule_id FROM g GROUP BY 1 ORDER BY sum(n_alerts) DESC, rule_id LIMIT 15)
        SELECT * FROM g SEMI JOIN t USING (rule_id) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY n_alerts DESC, decoder_name) <= 5""",
    "dash_tactics": f"SELECT tactic, count(DISTINCT community_id) AS n_communities FROM (SELECT community_id, unnest({SAFE.format('mitre_tactics')}) AS tactic FROM communities WHERE NOT is_summary) GROUP BY 1",
    "dash_timeline": f"""WITH {ROWS}, t AS (SELECT community_id FROM alerts WHERE community_id >= 0 GROUP BY 1 ORDER BY sum("count") DESC, community_id LIMIT 10) SELECT epoch_us(date_trunc('day', alert_ts)) AS start_us, community_id, {BIG('sum("count")')} AS n_alerts FROM alerts SEMI JOIN t USING (community_id) GROUP BY 1, 2""",
    "dash_decoders": f"""SELECT decoder_name, {BIG('sum("count")')} AS n_alerts FROM real_alerts_clustered WHERE decoder_name IS NOT NULL GROUP BY 1 ORDER BY n_alerts DESC, decoder_name LIMIT 10""",
}
SQL |= {f"edge_weights_{k}": _weights(k) for k in DECAY}
SQL["triage_heuristic"] = f"""WITH c AS (SELECT *, list_filter(string_split(users, '|'), lambda x: x <> '') AS u, list_filter(string_split(ips, '|'), lambda x: x <> '') AS i, coalesce(max_level, 0) AS lvl FROM ({SQL["triage_context"]})),
    x AS (SELECT *, len(list_filter(u, lambda x: starts_with(lower(x), 'svc-') OR starts_with(lower(x), 'user:svc-'))) > 0 AND NOT is_cross AS svc FROM c)
    SELECT community_id, CASE WHEN svc THEN 'service accounts, probably maintenance' WHEN is_cross AND lvl >= 10 THEN 'several sources with rules of high level' WHEN is_cross THEN 'correlated activity of several sources' ELSE 'activity of a single source' END AS incident_type,
    CASE WHEN svc THEN 'informativa' WHEN is_cross AND lvl >= 10 THEN 'alta' WHEN is_cross THEN 'media' ELSE 'baja' END AS severity, svc AS benign, array_to_string(list_concat(u[1:3], i[1:3]), '|') AS key_entities,
    array_to_string(list_filter([CASE WHEN len(u) > 4 THEN 'many users without a visible relation: the grouping may be an artefact' END, CASE WHEN NOT is_cross THEN 'a single source: little evidence' END], lambda x: x IS NOT NULL), '|') AS doubts,
    'review the original alerts of the community|check whether the entities are expected to do this' AS actions, 'baja' AS confidence,
    'Community of ' || n_rows || ' rows and ' || n_alerts || ' alerts, ' || CASE WHEN is_cross THEN 'several sources' ELSE 'one source' END || ' (' || replace(decoders, '|', ', ') || ').' AS narrative FROM x"""

_ITEMS = {"users": U, "ips": I, "hosts": H} | {k: CSV.format(c) for k, c in (("groups", "rule_groups"), ("tactics", "mitre_tactic"), ("techniques", "mitre_technique"))}


def _vocab(items: str) -> str:
    return f"""(SELECT item, n, rnk FROM (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS rnk, coalesce(sum(n) OVER (ORDER BY n DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(n) OVER () AS total FROM (SELECT item, count(*) AS n FROM (SELECT unnest({items}) AS item FROM real_alerts_clustered) GROUP BY 1)) WHERE rnk <= 30 OR (rnk <= 200 AND before < total * 0.7))"""


_VOCAB = f"{ROWS}, vocab AS {_vocab(H)}"
SQL |= {
    "coverage_topk": " UNION ALL ".join(f"SELECT '{k}' AS list, * FROM {_vocab(i)}" for k, i in _ITEMS.items()),
    "multi_hot": f"""WITH {_VOCAB}, x AS (SELECT row_id, unnest({H}) AS item FROM alerts), h AS (SELECT row_id, array_to_string(list(CAST(rnk AS VARCHAR) ORDER BY rnk), ',') AS hot FROM x JOIN vocab USING (item) GROUP BY 1) SELECT row_id, coalesce(hot, '') AS hot FROM alerts LEFT JOIN h USING (row_id)""",
    "one_hot_topk": "WITH t AS (SELECT rule_id FROM real_alerts_clustered WHERE rule_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, rule_id LIMIT 10) SELECT coalesce(t.rule_id, '__other__') AS rule_id_hot, count(*) AS n FROM real_alerts_clustered a LEFT JOIN t ON t.rule_id = a.rule_id GROUP BY 1",
}

SQL["ip_extract_docs"] = rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '@([0-9A-Fa-f:.]+)', 1) AS found FROM documents WHERE contains(text, '@'))
SELECT doc_id, nullif(regexp_extract(text, '@(\d{{1,3}}(\.\d{{1,3}}){{3}})', 1), '') AS first_ip, array_to_string([('ip:' || x) for x in list_filter(found, lambda x: regexp_matches(x, '{V4}') AND NOT starts_with(x, '127.') AND x NOT IN ('0.0.0.0', '255.255.255.255'))], ',') AS all_ips FROM d"""


_KEPT = f"""{LISTED}, {_MAP}, known AS (SELECT 'ip:' || ip AS entity, 'asset:' || x.host AS t FROM amap UNION SELECT 'host:' || x.host, 'asset:' || x.host FROM amap),
res AS (SELECT DISTINCT row_id, decoder_name, coalesce(t, entity) AS entity FROM listed LEFT JOIN known USING (entity)),
clear AS (SELECT * FROM res WHERE NOT (lower(entity) = '' OR lower(entity) IN {_in(P.INFRASTRUCTURE)} OR regexp_matches(lower(entity), '{"|".join(P.INFRASTRUCTURE_PATTERNS)}'))),
bad AS (SELECT entity FROM clear GROUP BY entity HAVING count(DISTINCT row_id) >= greatest(3, round_even((SELECT count(*) FROM alerts) * 0.1, 0)) OR count(DISTINCT decoder_name) > 4),
kept AS (SELECT row_id, entity FROM clear ANTI JOIN bad USING (entity))"""
SQL["row_entities"] = f"WITH {_KEPT} SELECT row_id, entity FROM kept"
SQL["pipeline_edges"] = f"""WITH {_KEPT}, few AS (SELECT entity FROM kept GROUP BY entity HAVING count(*) BETWEEN 2 AND 400), post AS (SELECT row_id, entity FROM kept SEMI JOIN few USING (entity)),
    pairs AS (SELECT p.row_id AS a, q.row_id AS b, count(*) AS shared FROM post p JOIN post q ON p.entity = q.entity AND p.row_id < q.row_id GROUP BY 1, 2),
    times AS (SELECT row_id, epoch_us(alert_ts) / 1e6 AS lo, epoch_us(alert_ts) / 1e6 + least("count", 600) AS hi FROM alerts),
    edges AS (SELECT a, b, shared, greatest(0.0, greatest(x.lo, y.lo) - least(x.hi, y.hi)) AS dt FROM pairs JOIN times x ON x.row_id = a JOIN times y ON y.row_id = b)
    SELECT a, b, shared, round(dt, 3) AS dt, round(shared * exp(-dt / 300.0), 6) AS w FROM edges WHERE shared * exp(-dt / 300.0) > 0"""

_LOGONS = SQL["user_norm"].replace("SELECT DISTINCT unnest(entity_users) AS raw FROM real_alerts_clustered", "SELECT DISTINCT user_id AS raw FROM user_logged_in")
SQL["alias_lookup"] = f"""WITH m AS ({SQL["alias_assign"]}), n AS ({_LOGONS}) SELECT DISTINCT clean_name AS name, alias, canonical AS back FROM n LEFT JOIN m ON canonical = clean_name WHERE clean_name IS NOT NULL"""
SQL["alias_bounce"] = f"""WITH m AS ({SQL["alias_assign"]}), g AS ({SQL["user_alias_groups"]}), w AS (SELECT m.alias, coalesce(g.canonical, m.canonical) AS head FROM m LEFT JOIN g ON g.variant = m.canonical)
    SELECT w.alias AS was, coalesce(h.alias, w.alias) AS "user" FROM w LEFT JOIN m h ON h.canonical = w.head"""
