"""Queries of the llm problems and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm import copies, entities, overlaps, packing, stuffing, tokens, waves
from alertweave.operators import instants
from alertweave.plans.general import _BLANKS, _entries
from alertweave.plans.instants_sql import sole_instants
from alertweave.session import table

ALERTS = "real_alerts_clustered"


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return instants.zone_table(table(spark, d, "agent_zones"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.found(table(spark, d, ALERTS), table(spark, d, "asset_inventory"))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    m = entities.matches(table(spark, d, ALERTS), table(spark, d, "asset_inventory"))
    return m.select("row_id", "asset_id", F.round("confidence", 6).alias("confidence"), "agree")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = copies.alert_copies(table(spark, d, ALERTS), _zones(spark, d)).withColumn("table_name", F.lit(ALERTS))
    b = copies.line_copies(table(spark, d, "alert_lines")).withColumn("table_name", F.lit("alert_lines"))
    return a.unionByName(b).select("table_name", "group_id", "rec_id")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies of both tables, by the keys of p3_found, and its number of copies."""
    a = copies.collapsed_alerts(table(spark, d, ALERTS), _zones(spark, d)).withColumn("table_name", F.lit(ALERTS))
    b = copies.collapsed_lines(table(spark, d, "alert_lines")).withColumn("table_name", F.lit("alert_lines"))
    return a.unionByName(b).select("table_name", "rec_id", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return waves.found(table(spark, d, ALERTS), _zones(spark, d))


def p4_waves(spark: SparkSession, d: str) -> DataFrame:
    return waves.described(table(spark, d, ALERTS), _zones(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.all_pairs(table(spark, d, ALERTS)).select("row_id_a", "row_id_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.link_counts(table(spark, d, ALERTS))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The text of every document again from its ids."""
    ids = p7_ids(spark, d)
    return ids.select("doc_id", tokens.text_of(F.col("ids")).alias("text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.found(table(spark, d, "documents"))


def p9_scored(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.scored(table(spark, d, "documents"))


_ALL = (p2_found, p2_matches, p3_found, p3_collapsed, p4_found, p4_waves, p5_found, p5_classes, p7_ids, p7_decoded, p8_containers, p8_fill, p9_found, p9_scored)
QUERIES = {f.__name__: f for f in _ALL}

_SETS = f"""s AS (SELECT row_id, list_sort(list_concat([('u' || x) for x in {_entries('entity_users')}], list_concat([('i' || x) for x in {_entries('entity_ips')}], [('h' || x) for x in {_entries('entity_hosts')}]))) AS toks
    FROM real_alerts_clustered), big AS (SELECT * FROM s WHERE len(toks) >= 5), t AS (SELECT row_id, len(toks) AS n, unnest(toks) AS tok FROM big),
    pairs AS (SELECT x.row_id AS row_id_a, y.row_id AS row_id_b FROM t x JOIN t y ON x.tok = y.tok AND x.row_id < y.row_id GROUP BY 1, 2, x.n, y.n HAVING count(*) * 10 >= 7 * (x.n + y.n - count(*)))"""

_BARE = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_BARE_LIST = lambda items: f"list_sort(list_filter([{_BARE.format('x')} for x in {items}], lambda x: x <> ''))"
_PLAIN = "list_sort(list_filter(coalesce({}, []), lambda x: x is not null and x <> ''))"
_TIMED = f"stamped AS (SELECT row_id, first_seen AS v, agent_name AS agent FROM real_alerts_clustered), {sole_instants('stamped', 'row_id')}"
_FIELDS = "|".join(copies.LINE_FIELDS)
_FIELD = lambda n: f"list_filter(parts, lambda p: lower(string_split(p, chr(2))[1]) = '{n}')[1]"
_VALUE = lambda n: f"string_split({_FIELD(n)}, chr(2))[-1]"


def _address(c: str) -> str:
    """One spelling of an address, as groups without zeros in front."""
    groups = lambda x: f"list_filter(string_split({x}, ':'), lambda g: g <> '')"
    left, right = groups("string_split(a, '::')[1]"), groups("string_split(a, '::')[2]")
    zeros = f"list_transform(range(greatest(0, 8 - len({left}) - len({right}))), lambda i: '0')"
    six = f"CASE WHEN contains(a, '::') THEN list_concat(list_concat({left}, {zeros}), {right}) ELSE {groups('a')} END"
    whole = f"CASE WHEN contains(a, ':') THEN {six} ELSE string_split(a, '.') END"
    text = f"regexp_replace(lower(regexp_extract({c}, '[0-9A-Fa-f:.]{{2,}}')), '^(0*:){{2,7}}ffff:([0-9]+\\.)', '\\2')"
    return f"(SELECT array_to_string(list_transform({whole}, lambda g: coalesce(nullif(ltrim(g, '0'), ''), '0')), '.') FROM (SELECT {text} AS a))"


_COPIES = rf"""{_TIMED},
    ak AS (SELECT 'real_alerts_clustered' AS table_name, row_id AS rec_id, hash(struct_pack(a := coalesce(decoder_name, ''), b := coalesce(rule_id, ''), c := "count", d := coalesce(first_seen, ''), e := coalesce(last_seen, ''),
        f := {_PLAIN.format('entity_ips')}, g := {_PLAIN.format('entity_hosts')}, h := {_BARE.format('rule_description')}, i := {_BARE_LIST('coalesce(entity_users, [])')})::VARCHAR) AS key
        FROM real_alerts_clustered SEMI JOIN (SELECT row_id FROM sole WHERE us IS NOT NULL) USING (row_id) WHERE len({_BARE_LIST('coalesce(entity_users, [])')}) > 0),
    lp AS (SELECT line_id, string_split(regexp_replace(regexp_replace(line_text, '\\(?:[tnrbf]|u00[01a][0-9a-fA-F]|u20[02][0-9a-fA-F])', ' ', 'g'), '(?i)(?:^|[^A-Za-z0-9_])({_FIELDS})["'']?\s*[:=]', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM alert_lines),
    lf AS (SELECT line_id, {', '.join(f'{_VALUE(n)} AS f{i}' for i, n in enumerate(copies.LINE_FIELDS))} FROM lp WHERE {' AND '.join(f'{_FIELD(n)} IS NOT NULL' for n in copies.LINE_FIELDS)}),
    lk AS (SELECT 'alert_lines' AS table_name, line_id AS rec_id, hash(struct_pack(a := {_address('f3')}, b := {_address('f4')}, c := regexp_replace(f6, '[^0-9]', '', 'g'), d := {_BARE.format('f0')}, e := {_BARE.format('f1')}, f := {_BARE.format('f2')}, g := {_BARE.format('f7')},
        h := {_BARE_LIST("string_split(f5, ',')")})::VARCHAR) AS key FROM lf),
    keyed AS (SELECT * FROM ak UNION ALL SELECT * FROM lk)"""

_WAVES = f"""{_TIMED}, s AS (SELECT row_id, us, list_concat([('u' || x) for x in {_entries('entity_users')}], [('i' || x) for x in {_entries('entity_ips')}]) AS toks FROM real_alerts_clustered JOIN sole USING (row_id) WHERE us IS NOT NULL),
    t AS (SELECT row_id, us, len(toks) AS n, unnest(toks) AS tok FROM s WHERE len(toks) >= 5),
    e AS (SELECT x.row_id AS a, y.row_id AS b FROM t x JOIN t y ON x.tok = y.tok AND abs(x.us - y.us) <= 21600000000 GROUP BY x.row_id, y.row_id, x.n, y.n HAVING count(*) * 2 >= x.n + y.n - count(*)),
    near AS (SELECT a, list_sort(list(b)) AS bs FROM e GROUP BY a),
    closed AS (SELECT bs FROM near GROUP BY bs HAVING count(*) = len(bs) AND len(bs) >= 3)"""

_CLEAN = f"lower(trim(x, {_BLANKS}))"


def _devices(name: str, key: str, source: str) -> str:
    """Relations ``name``h (host: letters, number), i (address), u (surname, first name) of the raw texts of ``source`` (key, kind, x)."""
    single = f"{name}r AS (SELECT {key}, kind, {_CLEAN} AS t FROM ({source}) WHERE x IS NOT NULL)"
    letters = r"regexp_replace(string_split(t, '.')[1], '[^\p{L}]', '', 'g')"
    domain = r"regexp_extract(t, '^[^.]*\.(\p{L}+)\.', 1)"
    words = r"list_filter(string_split(regexp_replace(regexp_replace(t, '^.*\\|@.*$|\([^)]*\)', '', 'g'), '[^\p{L}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    nobody = ", ".join(f"'{x}'" for x in entities.NOBODY)
    return f"""{single},
    {name}w AS (SELECT {key}, CASE WHEN length({letters}) <= 4 THEN {domain} || {letters} ELSE {letters} END AS w, regexp_replace(regexp_replace(string_split(t, '.')[1], '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') AS number FROM {name}r WHERE kind = 'h' AND {letters} <> ''),
    {name}h AS (SELECT {key}, array_to_string(list_transform(list_filter(range(1, length(w) + 1), lambda i: i = 1 OR substr(w, i, 1) <> substr(w, i - 1, 1)), lambda i: substr(w, i, 1)), '') AS letters, number FROM {name}w),
    {name}i AS (SELECT DISTINCT {key}, {_address('a0')} AS ip FROM (SELECT {key}, unnest(CASE WHEN regexp_matches(t, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN regexp_extract_all(t, '(?:^|[^0-9.])((?:[0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}})', 1) WHEN regexp_matches(t, ':.*:') THEN [t] END) AS a0 FROM {name}r WHERE kind = 'i')),
    {name}u AS (SELECT {key}, unnest(CASE WHEN len(ws) = 1 THEN [struct_pack(s := substr(ws[1], 2), f := substr(ws[1], 1, 1))] ELSE [struct_pack(s := ws[1], f := ws[2]), struct_pack(s := ws[2], f := ws[1])] END, recursive := true)
        FROM (SELECT {key}, {words} AS ws FROM {name}r WHERE kind = 'u' AND t NOT IN ({nobody})) WHERE len(ws) BETWEEN 1 AND 2)"""


_ALERT_TEXTS = " UNION ALL ".join(f"SELECT row_id, '{k}' AS kind, unnest({c}) AS x FROM real_alerts_clustered WHERE decoder_name = 'edr-agent'" for k, c in (("h", "entity_hosts"), ("i", "entity_ips"), ("u", "entity_users")))
_STOCK_TEXTS = " UNION ALL ".join(f"SELECT asset_id, '{k}' AS kind, {c} AS x FROM asset_inventory" for k, c in (("h", "device_label"), ("i", "ip_text"), ("u", "owner_text")))
#: Two attributes agree, apart from the writing and a slip of a letter on each side.
_DEVICES = f"""WITH {_devices('a', 'row_id', _ALERT_TEXTS)}, {_devices('b', 'asset_id', _STOCK_TEXTS)},
    agreed AS (SELECT DISTINCT row_id, asset_id, 'h' AS kind FROM ah JOIN bh ON ah.number = bh.number WHERE ah.letters = bh.letters OR (abs(length(ah.letters) - length(bh.letters)) = 1 AND levenshtein(ah.letters, bh.letters) = 1)
    UNION ALL SELECT DISTINCT row_id, asset_id, 'i' FROM ai JOIN bi USING (ip)
    UNION ALL SELECT DISTINCT row_id, asset_id, 'u' FROM au JOIN bu ON length(au.s) > 1 AND length(bu.s) > 1 AND CASE WHEN length(au.f) <= 1 OR length(bu.f) <= 1 THEN left(au.f, 1) = left(bu.f, 1) ELSE damerau_levenshtein(au.f, bu.f) <= 2 END
        AND CASE WHEN least(length(au.s), length(bu.s)) < 4 THEN au.s = bu.s ELSE damerau_levenshtein(au.s, bu.s) <= 2 END)
    SELECT row_id, asset_id FROM agreed GROUP BY 1, 2 HAVING count(*) >= 2"""

SQL = {
    "p2_found": _DEVICES,
    "p3_found": f"WITH {_COPIES} SELECT table_name, min(rec_id) OVER (PARTITION BY table_name, key) AS group_id, rec_id FROM keyed QUALIFY count(*) OVER (PARTITION BY table_name, key) > 1",
    "p3_collapsed": f"WITH {_COPIES} SELECT table_name, min(rec_id) AS rec_id, count(*) AS n_copies FROM keyed GROUP BY table_name, key",
    "p4_found": f"WITH {_WAVES} SELECT bs[1] AS cluster_row_id, unnest(bs) AS row_id FROM closed",
    "p5_found": f"WITH {_SETS} SELECT row_id_a, row_id_b FROM pairs",
    "p5_classes": f"""WITH {_SETS}, l AS (SELECT row_id, count(*) AS k FROM (SELECT row_id_a AS row_id FROM pairs UNION ALL SELECT row_id_b FROM pairs) GROUP BY 1)
        SELECT row_id, min(row_id) OVER (PARTITION BY toks) AS class_id, count(*) OVER (PARTITION BY toks) AS n_copies, coalesce(k, 0) AS n_links FROM big LEFT JOIN l USING (row_id)""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
