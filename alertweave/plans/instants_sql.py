"""SQL for DuckDB that reads timestamps of mixed notations, written from the rules alone: the check of problem 6 and of what builds on it."""

from __future__ import annotations

from alertweave.plans.general import _BLANKS

#: Short names of zones and their minutes, as the zone database has them for 2025.
SHORT_NAMES = {
    "CET": ("Europe/", 60), "CEST": ("Europe/", 120), "WET": ("Europe/Lisbon", 0), "WEST": ("Europe/Lisbon", 60), "BST": ("Europe/London", 60), "IST": ("Asia/Kolkata", 330), "JST": ("Asia/Tokyo", 540), "EET": ("Europe/", 120), "EEST": ("Europe/", 180),
    "EST": ("America/", -300), "EDT": ("America/", -240), "CST": ("America/", -360), "CDT": ("America/", -300), "MST": ("America/", -420), "MDT": ("America/", -360), "PST": ("America/", -480), "PDT": ("America/", -420),
    "AEST": ("Australia/", 600), "AEDT": ("Australia/", 660), "SAST": ("Africa/", 120), "MSK": ("Europe/Moscow", 180), "HKT": ("Asia/Hong_Kong", 480), "KST": ("Asia/Seoul", 540), "EAT": ("Africa/", 180),
}

_TIME = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?|(\d{2})(\d{2})(\d{2}))(?: ?([AaPp][Mm]))?"
_ZONE = r" ?([A-Za-z]{1,5})?([+-]\d{2}:?(?:\d{2})?)?(?:\[([A-Za-z]+(?:/[A-Za-z_+0-9-]+)*)\])?"
_REST = rf"(?:[Tt ]|, )\s*{_TIME}{_ZONE}$"
_HEADS = (r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{4})/(\d{2})/(\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", r"^(?:([A-Za-z]{3}), )?(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4})", r"^([A-Za-z]{3})\s+(\d{1,2})(?:,?\s+(\d{4}))?", r"^(\d{4})(\d{2})(\d{2})")
_GROUPS = "'h', 'mi', 's', 'fr', 'h2', 'mi2', 's2', 'half', 'short', 'off', 'region'"


def _month(name: str) -> str:
    return f"CASE WHEN position(lower({name}) IN 'janfebmaraprmayjunjulaugsepoctnovdec') % 3 = 1 THEN (position(lower({name}) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 END"


def _part(k: int, i: int) -> str:
    return f"regexp_extract(t, '{_HEADS[k]}', {i})"


def sole_instants(source: str, keep: str) -> str:
    """CTEs that end in ``sole`` (``keep``, us): ``source`` is a relation with ``keep``, v (as written) and agent; us is null for no case."""
    kind = " ".join(f"WHEN regexp_matches(t, '{h}{_REST}') THEN {k}" for k, h in enumerate(_HEADS))
    day = lambda y, m, d: f"TRY_CAST(printf('%04d-%02d-%02d', TRY_CAST({y} AS INTEGER), TRY_CAST({m} AS INTEGER), TRY_CAST({d} AS INTEGER)) AS DATE)"
    weekday = f"({_part(4, 1)} = '' OR position(lower({_part(4, 1)}) IN 'montuewedthufrisatsun') = 3 * isodow({day(_part(4, 4), _month(_part(4, 3)), _part(4, 2))}) - 2)"
    months = f"coalesce(nullif({_part(5, 3)}, ''), '2025')"
    named = " ".join(f"WHEN '{k}' THEN CASE WHEN zone LIKE '{z}%' THEN {m} END" for k, (z, m) in SHORT_NAMES.items())
    micros = lambda c: f"CAST(rpad(left({c}, 6), 6, '0') AS BIGINT)"
    offset = lambda days: f"(epoch_us(local + to_days({days})) - epoch_us(timezone(place, local + to_days({days}))))"
    return f"""
    z0 AS (SELECT agent_name, min(zone_name) AS zone, lower(min(date_order)) AS ord FROM agent_zones WHERE agent_name IS NOT NULL GROUP BY 1),
    z1 AS (SELECT {keep}, trim(v, {_BLANKS}) AS t, zone, CASE WHEN ord IN ('dmy', 'mdy', 'ymd') THEN ord END AS ord FROM {source} LEFT JOIN z0 ON agent_name = agent),
    z2 AS (SELECT *, CASE {kind} END AS k, regexp_extract(t, '{_REST}', [{_GROUPS}]) AS g FROM z1),
    z3 AS (SELECT *, CASE k WHEN 0 THEN [{day(_part(0, 1), _part(0, 2), _part(0, 3))}] WHEN 1 THEN [{day(_part(1, 1), _part(1, 2), _part(1, 3))}]
        WHEN 2 THEN list_distinct(list_filter([CASE WHEN ord IS DISTINCT FROM 'mdy' THEN {day(_part(2, 3), _part(2, 2), _part(2, 1))} END, CASE WHEN ord IS NULL OR ord = 'mdy' THEN {day(_part(2, 3), _part(2, 1), _part(2, 2))} END], lambda x: x IS NOT NULL))
        WHEN 3 THEN [{day(_part(3, 3), _part(3, 2), _part(3, 1))}] WHEN 4 THEN [CASE WHEN {weekday} THEN {day(_part(4, 4), _month(_part(4, 3)), _part(4, 2))} END]
        WHEN 5 THEN [{day(months, _month(_part(5, 1)), _part(5, 2))}] WHEN 6 THEN [{day(_part(6, 1), _part(6, 2), _part(6, 3))}] END AS days,
        TRY_CAST(coalesce(nullif(g.h, ''), g.h2) AS INTEGER) AS h0, TRY_CAST(coalesce(nullif(g.mi, ''), g.mi2) AS INTEGER) AS mi, coalesce(TRY_CAST(coalesce(nullif(g.s, ''), nullif(g.s2, '')) AS INTEGER), 0) AS s, replace(g.off, ':', '') AS o, upper(g.short) AS sh FROM z2),
    z4 AS (SELECT *, CASE WHEN g.half = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN lower(g.half) = 'pm' THEN 12 ELSE 0 END ELSE 99 END AS h,
        CASE WHEN o <> '' THEN CASE WHEN CAST(substr(o, 2, 2) AS INTEGER) <= 18 AND coalesce(TRY_CAST(substr(o, 4) AS INTEGER), 0) <= 59 AND sh IN ('', 'UTC', 'GMT')
            THEN (CAST(substr(o, 2, 2) AS INTEGER) * 60 + coalesce(TRY_CAST(substr(o, 4) AS INTEGER), 0)) * CASE WHEN o[1] = '-' THEN -1 ELSE 1 END END
        WHEN sh IN ('Z', 'UTC', 'GMT') THEN 0 WHEN sh <> '' THEN CASE sh {named} END END AS minutes, CASE WHEN o = '' AND sh = '' THEN coalesce(nullif(g.region, ''), zone) END AS place FROM z3),
    z5 AS (SELECT *, CASE WHEN len(days) = 1 AND days[1] IS NOT NULL AND h <= 23 AND mi <= 59 AND s <= 59 THEN CAST(days[1] AS TIMESTAMP) + to_microseconds(CAST(h * 3600 + mi * 60 + s AS BIGINT) * 1000000 + {micros("g.fr")}) END AS local FROM z4),
    z6 AS (SELECT *, CASE WHEN place IS NOT NULL AND local IS NOT NULL THEN list_filter(list_distinct([epoch_us(local) - {offset(-1)}, epoch_us(local) - {offset(1)}]), lambda u: timezone(place, make_timestamptz(u)) = local) END AS us_list FROM z5),
    z7 AS (SELECT {keep}, CASE WHEN regexp_full_match(t, '\\d{{10}}(\\.\\d{{1,9}})?') THEN CAST(left(t, 10) AS BIGINT) * 1000000 + {micros("substr(t, 12)")} WHEN regexp_full_match(t, '\\d{{13}}') THEN CAST(t AS BIGINT) * 1000
        WHEN regexp_full_match(t, '\\d{{16}}') THEN CAST(t AS BIGINT) WHEN regexp_full_match(t, '\\d{{19}}') THEN CAST(CAST(t AS HUGEINT) // 1000 AS BIGINT)
        WHEN minutes IS NOT NULL THEN epoch_us(local) - CAST(minutes AS BIGINT) * 60000000 WHEN len(us_list) = 1 THEN us_list[1] END AS us FROM z6),
    sole AS (SELECT {keep}, CASE WHEN us >= 1735689600000000 AND us < 1767225600000000 THEN us END AS us FROM z7)"""


_STAMPED = """stamped AS (SELECT 'real_alerts_clustered' AS table_name, row_id AS rec_id, 'first_seen' AS field_name, first_seen AS v, agent_name AS agent FROM real_alerts_clustered
    UNION ALL SELECT 'real_alerts_clustered', row_id, 'last_seen', last_seen, agent_name FROM real_alerts_clustered UNION ALL SELECT 'user_logged_in', event_id, 'creation_time', creation_time, collector FROM user_logged_in)"""

SQL = {"p6_found": f"WITH {_STAMPED}, {sole_instants('stamped', 'table_name, rec_id, field_name')} SELECT table_name, rec_id, field_name, us AS utc_us FROM sole WHERE us IS NOT NULL"}
