"""SQL texts shared by the oracle queries."""

from __future__ import annotations

from sensorloom.functions.rules import EQUIP_RULES, NAV_RULES, NO_RULE, UNIT_RULES
from sensorloom.functions.values import NON_FINITE_TEXT, NUMBER_TEXT

IS_NUM = f"(regexp_matches(value, '{NUMBER_TEXT}') OR regexp_matches(value, '{NON_FINITE_TEXT}'))"
KIND = f"CASE WHEN value IN ('True', 'False') THEN 'bool' WHEN {IS_NUM} THEN 'num' ELSE 'str' END"
NUM = f"CASE WHEN {IS_NUM} THEN TRY_CAST(replace(trim(value), '_', '') AS DOUBLE) END"
DATE = "CAST(CAST(datetime AS DATE) AS VARCHAR)"
HOUR = "CAST(hour(datetime) AS VARCHAR)"

UNIQUE_ID = (
    "replace(\"equipRef\" || ' ' || \"groupRef\" || ' ' || \"navName\" || ' ' || \"siteRef\" || ' ' || \"typeRef\","
    " \"siteRef\" || ' ', '')"
)
FLUX_ID = (
    "replace(\"equipRef\" || ' ' || \"groupRef\" || ' ' || \"navName\" || ' ' || \"typeRef\","
    " ' ' || \"siteRef\" || ' ', ' ')"
)
IS_EC = (
    "(unit IN ('kWh', 'm³') OR regexp_matches(\"navName\", '\\bEnergy\\b')"
    " OR regexp_matches(\"typeRef\", '\\bkWh\\b'))"
)
PLAIN = r"regexp_matches(value, '^[0-9]\d*(\.\d+)?$')"

# Readings with value kind, number, state, date, month and hour.
TYPED = f"""typed AS (SELECT *, {KIND} AS kind, {NUM} AS x, {DATE} AS date,
  CAST(month(datetime) AS VARCHAR) AS month, {HOUR} AS hour FROM readings)"""

# Energy meters with their id; other sensors.
EC = f"ec AS (SELECT *, {UNIQUE_ID} AS \"uniqueId\" FROM typed WHERE {IS_EC})"
NC = f"nc AS (SELECT * FROM typed WHERE NOT {IS_EC})"


def _any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def equip_case(c: str = '"equipRef"') -> str:
    arms = " ".join(
        f"WHEN {_any_of([f'contains({c}, {chr(39)}{s}{chr(39)})' for s in subs])} THEN '{g}'" for subs, g in EQUIP_RULES
    )
    return f"CASE {arms} ELSE '{NO_RULE}' END"


def nav_case(c: str = '"navName"') -> str:
    def has(entry: str) -> str:
        if entry.startswith("="):
            return f"contains({c}, '{entry[1:]}')"
        wanted, _, excluded = entry.partition("-")
        hit = f"contains(lower({c}), '{wanted}')"
        return f"({hit} AND NOT contains(lower({c}), '{excluded}'))" if excluded else hit

    arms = " ".join(f"WHEN {_any_of([has(s) for s in subs])} THEN '{g}'" for subs, g in NAV_RULES)
    return f"CASE {arms} ELSE '{NO_RULE}' END"


def unit_case() -> str:
    arms = []
    for rule in UNIT_RULES:
        c = []
        if rule.nav_is:
            c.append("\"navName\" IN (" + ", ".join(f"'{s}'" for s in rule.nav_is) + ")")
        if rule.nav_has:
            c.append(_any_of([f"contains(\"navName\", '{s}')" for s in rule.nav_has]))
        if rule.equip_has:
            c.append(f"contains(\"equipRef\", '{rule.equip_has}')")
        if rule.value_is:
            c.append(f"value = '{rule.value_is}'")
        if rule.unit_is:
            c.append("unit IN (" + ", ".join(f"'{s}'" for s in rule.unit_is) + ")")
        if rule.unit_has:
            c.append(f"contains(unit, '{rule.unit_has}')")
        if rule.type_has:
            c.append(f"contains(\"typeRef\", '{rule.type_has}')")
        result = f"'{rule.result}'"
        if rule.binary:
            result = f"CASE WHEN NOT {IS_NUM} OR ({NUM}) IN (0, 1) THEN {result} END"
        arms.append(f"WHEN {' AND '.join(c)} THEN {result}")
    return f"CASE {' '.join(arms)} ELSE unit END"


def changes_sql(name: str, source: str, group: str, where: str = "kind IN ('bool', 'str')") -> str:
    """Hourly state changes per group as a plain window over whole groups."""
    return f"""{name} AS (SELECT {group}, kind, change_hour, CAST(sum(c) AS BIGINT) AS changes, count(*) AS n FROM (
    SELECT {group}, kind, {HOUR} AS change_hour,
      CASE WHEN row_number() OVER w > 1 AND value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS c
    FROM {source} WHERE {where}
    WINDOW w AS (PARTITION BY {group}, kind ORDER BY datetime, seq)) GROUP BY ALL)"""


def stats_sql(x: str, count: str) -> str:
    return (
        f"avg({x}) AS mean, coalesce(stddev_samp({x}), 0) AS std, max({x}) AS max, min({x}) AS min, {count} AS count"
    )


def agg_all_sql(name: str, source: str, group: str) -> str:
    """All-kinds aggregate of a typed source per group, as several CTEs."""
    return f"""{changes_sql(name + "_ch", source, group)},
{name}_parts AS (
  SELECT {group}, {stats_sql("x", "count(x)")} FROM {source} WHERE kind = 'num' GROUP BY {group}
  UNION ALL
  SELECT {group}, {stats_sql("changes", "CAST(sum(n) AS BIGINT)")} FROM {name}_ch GROUP BY {group}, kind),
{name} AS (SELECT {group}, sum(mean * count) / sum(count) AS mean, sum(std * count) / sum(count) AS std,
  CAST(max(max) AS DOUBLE) AS max, CAST(min(min) AS DOUBLE) AS min, CAST(sum(count) AS BIGINT) AS count
  FROM {name}_parts GROUP BY {group})"""


TAGS = '"groupRef", "equipRef", "navName", "siteRef", "typeRef", unit'
