"""Robots rules as a table: which landed pages a crawler may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.core import BREAKS, let, text_or_empty, trim_ws
from ..session import cut
from .skew import lookup

_RULES = "array<struct<path:string,allow:boolean>>"
_GROUPS = f"array<struct<agents:array<string>,rules:{_RULES}>>"


def _unquote(value: Column) -> Column:
    plus_kept = F.replace(value, F.lit("+"), F.lit("%2B"))
    return F.when(value.contains("%"), F.coalesce(F.try_url_decode(plus_kept), value)).otherwise(value)


def robots_groups(body: Column) -> Column:
    """Groups of a robots file in file order: agent names and their allow/disallow paths."""
    lines = F.transform(
        F.split(text_or_empty(body), rf"\r\n|[{BREAKS}]"),
        lambda raw: let(
            trim_ws(F.regexp_replace(raw, "(?s)#.*", "")),
            lambda line: F.struct(
                (raw == "").alias("blank"),
                F.when(line.contains(":"), F.lower(trim_ws(F.split_part(line, F.lit(":"), F.lit(1))))).otherwise("").alias("key"),
                _unquote(trim_ws(F.regexp_replace(line, "^[^:]*:", ""))).alias("value"),
            ),
        ),
    )

    def state(mode: Column, agents: Column, rules: Column, groups: Column) -> Column:
        return F.struct(mode.alias("mode"), agents.alias("agents"), rules.alias("rules"), groups.alias("groups"))

    no_agents, no_rules = F.array().cast("array<string>"), F.array().cast(_RULES)
    # mode: 0 outside a group, 1 reading agent names, 2 reading rules
    start = state(F.lit(0), no_agents, no_rules, F.array().cast(_GROUPS))

    def closed(acc: Column) -> Column:
        return F.concat(
            acc["groups"], F.array(F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules")))
        )

    def step(acc: Column, line: Column) -> Column:
        key, value, mode = line["key"], line["value"], acc["mode"]
        one_agent = F.array(value)
        rule = F.array(F.struct(value.alias("path"), ((key == "allow") | (value == "")).alias("allow")))
        return (
            F.when(line["blank"] & (mode == 1), state(F.lit(0), no_agents, no_rules, acc["groups"]))
            .when(line["blank"] & (mode == 2), state(F.lit(0), no_agents, no_rules, closed(acc)))
            .when((key == "user-agent") & (mode == 2), state(F.lit(1), one_agent, no_rules, closed(acc)))
            .when(
                key == "user-agent",
                state(F.lit(1), F.concat(acc["agents"], one_agent), acc["rules"], acc["groups"]),
            )
            .when(
                key.isin("allow", "disallow") & (mode > 0),
                state(F.lit(2), acc["agents"], F.concat(acc["rules"], rule), acc["groups"]),
            )
            .when(
                key.isin("crawl-delay", "request-rate") & (mode > 0),
                state(F.lit(2), acc["agents"], acc["rules"], acc["groups"]),
            )
            .otherwise(acc)
        )

    return F.aggregate(
        lines, start, step, lambda acc: F.when(acc["mode"] == 2, closed(acc)).otherwise(acc["groups"])
    )


def rules_for(body: Column, agent: str) -> Column:
    """The rules that bind ``agent``: its own group, else the first ``*`` group, else none."""
    name = F.lit(agent.split("/")[0].lower())

    def pick(groups: Column) -> Column:
        own = F.filter(
            groups,
            lambda g: ~F.array_contains(g["agents"], "*")
            & F.exists(g["agents"], lambda a: name.contains(F.lower(a))),
        )
        general = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
        return F.coalesce(F.get(own, F.lit(0)), F.get(general, F.lit(0)))["rules"]

    return F.coalesce(let(robots_groups(body), pick), F.array().cast(_RULES))


def may_fetch(url: Column, status: Column, rules: Column) -> Column:
    """Refused robots files deny everything, missing ones allow everything, else the first matching rule decides."""
    target = F.regexp_replace(_unquote(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", "")
    target = F.when(target == "", "/").otherwise(target)
    first = let(target, lambda t: F.get(F.filter(rules, lambda r: t.startswith(r["path"])), F.lit(0)))["allow"]
    return (
        F.when(status.isin(401, 403), False)
        .when(status.isNull() | (status >= 400), True)
        .otherwise(F.coalesce(first, F.lit(True)))
    )


def robots_verdicts(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` with ``allowed``.  Pass narrow rows: one origin may hold a large share of them.

    A NULL status in ``robots`` stands for a failed read, an origin without a row for one never tried.
    """
    rows = urls.withColumn("_origin", U.origin(F.col("url")))
    once = robots.groupBy("origin").agg(F.min(F.struct("status", "body")).alias("r"))
    parsed = once.select(
        F.col("origin").alias("_origin"), F.col("r.status").alias("_status"), rules_for(F.col("r.body"), agent).alias("_rules")
    )
    facts = rows.groupBy("_origin").agg(F.count("*").alias("n")).join(parsed, "_origin")
    judged = lookup(rows, facts, ["_origin"], F.col("url"))
    return judged.select(
        *urls.columns, may_fetch(F.col("url"), F.col("_status"), F.col("_rules")).alias("allowed")
    )


def robots_filter(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Pages whose robots file permits ``agent`` to read them."""
    denied = robots_verdicts(pages.select("url").distinct(), robots, agent).where("NOT allowed").select("url")
    denied = cut(denied, "denied-urls")
    return pages.join(denied, "url", "left_anti")
