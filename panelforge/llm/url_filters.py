"""URL filters in time: dated list entries become validity intervals, joined as of each capture.

A list's history is a table of events (list_name, rule, action, at): ``add`` puts a rule on the list,
``remove`` takes it off. Rules are domains and match a host that equals them or lies under them. Events
become half-open intervals [valid_from, valid_to), and captures (id, url, fetched_at) are evaluated against
what was active when they were fetched.

Hosts are made distinct before they are matched, so a host with very many captures is matched once. Intervals
and the distinct (host, fetched_at) meet by host and time slice, so no row or group holds a host's history; the
join back to the captures has one row per host and time on its other side, with what was active then.

Defined cases: a null or host-less url, or a null fetched_at, has no active entries; events with a null
part are ignored; of events at one time, removals come before additions; repeated events change nothing;
repeated captures are evaluated each; extra columns of captures are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a slice of time in which intervals and captures of a host meet.
SLICE_DAYS = 32


def _slice_of(time: Column) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / SLICE_DAYS)


def host_of(url: Column) -> Column:
    """Lower-case host of a url without user, port and closing dots (an IPv6 address keeps its brackets); null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def intervals(events: DataFrame) -> DataFrame:
    """(list_name, rule, valid_from, valid_to): when each rule is on its list; valid_to null is open."""
    rule = F.regexp_replace(F.lower(F.trim("rule")), r"^\.+|\.+$", "")
    known = events.select("list_name", rule.alias("rule"), F.lower("action").alias("action"), "at")
    known = known.where("list_name is not null and rule != '' and action in ('add', 'remove') and at is not null").distinct()
    turn = Window.partitionBy("list_name", "rule").orderBy("at", F.desc("action"))
    changes = known.withColumn("before", F.lag("action").over(turn)).where("before is null or before != action")
    spans = changes.withColumn("valid_to", F.lead("at").over(turn)).where("action = 'add'")
    return spans.where("valid_to is null or at < valid_to").select("list_name", "rule", F.col("at").alias("valid_from"), "valid_to")


def _free(name: str, columns: list[str]) -> str:
    """The name, with more leading underscores while a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures with their host and the entries active at fetch time.

    Adds _host, _active (sorted array of list_name and rule) to the columns of captures; where captures has a column
    of such a name, the added one has another underscore in front.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("row")  # the captures' columns stay apart from our own
    seen = captures.select(row, host_of(F.col("url")).alias("host"), F.col("fetched_at").alias("at"))
    moments = seen.select("host", "at").where("host is not null and at is not null").distinct()
    hosts = moments.groupBy("host").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    matched = hosts.select("*", F.explode(ends).alias("rule")).join(intervals(events), "rule")
    matched = matched.where("valid_from <= until and (valid_to is null or since < valid_to)")
    slices = F.sequence(_slice_of(F.greatest("valid_from", "since")), _slice_of(F.least("valid_to", "until")))
    pieces = matched.select("host", F.explode(slices).alias("slice"), "list_name", "rule", "valid_from", "valid_to")
    found = moments.withColumn("slice", _slice_of(F.col("at"))).join(pieces, ["host", "slice"])
    found = found.where("valid_from <= at and (valid_to is null or at < valid_to)")
    active = found.groupBy("host", "at").agg(F.array_sort(F.collect_set(F.struct("list_name", "rule"))).alias("active"))
    none = F.array().cast("array<struct<list_name:string,rule:string>>")
    joined = seen.join(active, ["host", "at"], "left")
    names = [_free(x, captures.columns) for x in ("_host", "_active")]
    return joined.select(F.col("host").alias(names[0]), "row.*", F.coalesce("active", none).alias(names[1]))
