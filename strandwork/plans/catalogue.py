"""All queries of the core library by name, with their DuckDB SQL.

Audio tables have no counterpart in the test data, so operators are bound to orders, line items, events, documents
and embeddings by column name. Sums of floats are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandwork.functions import keys, music, rules, text, times, urls
from strandwork.operators import aggregates as agg, filters, joins, kernels, resampling, scans, sequences as seq, topk
from strandwork.plans import dashboard, gains, planner
from strandwork.sources import documents as docs, logs
from strandwork.sources.sinks import shared_folder
from strandwork.streaming import events as stream, state, ttl

#: The fixed time of reports and expiry rules over the test data.
NOW = "2024-01-31 00:00:00"

#: Events whose songs one task analyses, and lines of which one task makes seven stems each.
EVENTS_A_TASK, STEM_LINES_A_TASK = 100_000, 200_000

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name; the function gets a reader of tables by name."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        name = f.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


c = F.col


# --- dashboard: scans, counts, top lists, rates --------------------------------------------------------------------------
_RUNS = """WITH e AS (SELECT event_id, event_type AS y, value, ts, json_extract_string(props, '$.k')::INTEGER AS k FROM events), d AS (SELECT * FROM e WHERE y <> 'view'),
    slots AS (SELECT event_id AS o, 0 AS s, 'v' || k % 7 AS id, 'T' || k % 7 AS title FROM d UNION ALL SELECT event_id, 1, 'w' || k % 5, CASE WHEN k >= 50 THEN 'U' ELSE '' END FROM d),
    used AS (SELECT id, title, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min({'o': o, 's': s})) AS place FROM slots GROUP BY 1, 2),
    marks AS (SELECT event_id AS o, 0 AS p, 'f' || k % 4 AS flag FROM e WHERE y IN ('purchase', 'error') UNION ALL SELECT event_id, 1, 'g' FROM e WHERE y = 'purchase' UNION ALL SELECT event_id, 0, 'h' FROM e WHERE y = 'click'),
    flags AS (SELECT flag AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min({'o': o, 'p': p})) AS place FROM marks GROUP BY 1),
    slot_hits AS (SELECT value > 50 AS a, CASE WHEN y = 'purchase' THEN k > 50 END AS b FROM d WHERE y IN ('click', 'purchase'))"""


def log_lines(t) -> DataFrame:
    """(value, line): events as the lines of a log of runs, with lines that are none. Types of events stand for the kinds of records: views are steps, signups have their time as text, errors have no offset and a single flag, clicks a list of flags that is none."""
    k, y = F.get_json_object("props", "$.k").cast("int"), c("event_type")
    quoted = lambda name, x: F.concat(F.lit(f'"{name}":"'), x, F.lit('"'))
    bare = lambda name, x: F.concat(F.lit(f'"{name}":'), x.cast("string"))
    mark = F.concat(F.lit("f"), k % 4)
    fields = F.concat_ws(
        ",", quoted("timestamp", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(y == "error", "").otherwise("+00:00"))), F.when(y != "view", F.lit('"pipeline_step":"summary"')).otherwise(F.lit('"pipeline_step":"load"')),
        F.when(y == "signup", quoted("total_pipeline_time_s", c("value").cast("string"))).when(y != "view", bare("total_pipeline_time_s", c("value"))),
        quoted("song_a_video_id", F.concat(F.lit("v"), k % 7)), quoted("song_a_title", F.concat(F.lit("T"), k % 7)), quoted("song_b_video_id", F.concat(F.lit("w"), k % 5)), F.when(k >= 50, F.lit('"song_b_title":"U"')),
        F.when(y.isin("click", "purchase"), bare("song_a_cache_hit", c("value") > 50)), F.when(y == "purchase", bare("song_b_cache_hit", k > 50)),
        F.when(y == "purchase", F.concat(F.lit('"red_flags":["'), mark, F.lit('","g"]'))).when(y == "error", quoted("red_flag", mark)).when(y == "click", F.lit('"red_flags":"none","red_flag":"h"')),
    )
    broken = t("region").select(F.explode(F.array(*map(F.lit, ("not json", "42", "", "  ", "[1]", '"text"', "{ broken")))).alias("value"), F.lit(-1).cast("long").alias("line"))
    return t("events").select(F.concat(F.lit("{"), fields, F.lit("}")).alias("value"), c("event_id").cast("long").alias("line")).unionByName(broken)


_METRIC = "SELECT '{0}' AS metric, {1} AS key, '' AS label, count(*) AS n, {2} AS value, NULL::INTEGER AS place FROM {3} GROUP BY ALL"


@query(
    _RUNS
    + " "
    + " UNION ALL ".join(
        _METRIC.format(*x)
        for x in (
            ("day", "strftime(ts, '%Y-%m-%d')", "NULL::DOUBLE", "d"), ("week", "strftime(ts, '%G-W%V')", "NULL::DOUBLE", "d"), ("total", "'all'", "NULL::DOUBLE", "d"),
            ("time", "'all'", "round_even(avg(value), 1)", "d WHERE y <> 'signup'"), ("flag", "flag", "NULL::DOUBLE", "marks"),
            ("hit_rate", "'all'", "round_even(avg(a::INT + coalesce(b, false)::INT) * 50, 1)", "slot_hits"), ("hits_a", "'all'", "NULL::DOUBLE", "slot_hits WHERE a"), ("hits_b", "'all'", "NULL::DOUBLE", "slot_hits WHERE b"),
        )
    )
    + " UNION ALL SELECT 'used', id, title, n, NULL, place::INTEGER FROM used WHERE place <= 10"
)
def dashboard_(t):
    """All aggregates of the log in one scan."""
    return dashboard.report(log_lines(t), F.lit(NOW).cast("timestamp"))


def log_part(t, name: str, days: int | None = None) -> DataFrame:
    return dashboard.parts(log_lines(t), F.lit(NOW).cast("timestamp"), days)[name]


@query(
    _RUNS
    + """, p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week FROM d WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
    SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(week) = 0 THEN 'week' ELSE 'total' END AS period, coalesce(day, week, 'all') AS key, count(*) AS n FROM p GROUP BY GROUPING SETS ((day), (week), ())"""
)
def log_periods(t):
    """Completed runs of the last seven days by day, by week and in total."""
    return log_part(t, "periods", 7)


@query(_RUNS + " SELECT round_even(avg(value), 1) AS average_s FROM d WHERE y <> 'signup'")
def log_average_time(t):
    return log_part(t, "average_time")


@query(_RUNS + " SELECT id, title, n FROM used WHERE place <= 10")
def log_most_used(t):
    return log_part(t, "most_used")


@query(_RUNS + " SELECT item, n, place::INTEGER AS place FROM flags")
def log_flags(t):
    return log_part(t, "flags")


@query(_RUNS + " SELECT count(*) AS total, count(*) FILTER (a) AS hits_a, count(*) FILTER (b) AS hits_b, round_even(avg(a::INT + coalesce(b, false)::INT) * 50, 1) AS hit_rate_pct FROM slot_hits")
def log_cache_hits(t):
    return log_part(t, "cache_hits")


@query(
    """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week FROM events)
    SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(week) = 0 THEN 'week' ELSE 'total' END AS period, coalesce(day, week, 'all') AS key, count(*) AS n
    FROM d GROUP BY GROUPING SETS ((day), (week), ())"""
)
def counts_by_period(t):
    rows = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), times.iso_week(c("ts")).alias("week"))
    return agg.counts_by_period(rows, "day", "week")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d')), (event_type), ())")
def event_rollup(t):
    rows = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rows.groupingSets([["day"], ["event_type"], []], "day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round_even(avg(value), 1) AS mean FROM events GROUP BY 1")
def avg_value_guarded(t):
    return t("events").groupBy("event_type").agg(agg.rounded_mean(c("value")).alias("mean"))


@query("SELECT event_type, CAST(sum(json_extract_string(props, '$.k')::BIGINT) AS BIGINT) AS total_k, count(*) AS n FROM events GROUP BY 1")
def json_prop_stats(t):
    rows = t("events").withColumn("j", F.try_parse_json("props"))
    return rows.groupBy("event_type").agg(F.sum(F.try_variant_get("j", F.lit("$.k"), "bigint")).alias("total_k"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (json_extract_string(props, '$.k')::DOUBLE) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def json_numbers(t):
    rows = t("events").withColumn("j", F.try_parse_json("props")).withColumn("k", filters.number_at(c("j"), "$.k"))
    return rows.where("k is not null").select("event_id", "k")


@query(
    """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS o, 'p' || l_partkey AS id, 0 AS slot FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, 's' || l_suppkey, 1 FROM lineitem)
    SELECT id, '' AS title, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, min({'o': o, 's': slot}) LIMIT 10"""
)
def top_keys_unpivot(t):
    rows = t("lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("o"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.lit("").alias("none"))
    return agg.top_pairs(rows, [("a", "none"), ("b", "none")], "o", 10)


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS item FROM documents)
    SELECT item, count(*) AS n FROM w GROUP BY 1"""
)
def word_frequency(t):
    rows = t("documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return agg.frequencies(rows, "words", "doc_id")


@query(
    """SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS hits_a, count(*) FILTER (l_linestatus = 'F') AS hits_b,
    round_even((count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_linestatus = 'F'))::DOUBLE / (2 * count(*)) * 100, 1) AS hit_rate_pct FROM lineitem"""
)
def flag_hit_rate(t):
    rows = t("lineitem").select((c("l_returnflag") == "R").alias("a"), (c("l_linestatus") == "F").alias("b"))
    return agg.hit_rate(rows, "a", "b")


@query("SELECT count(*) AS n, count(*) FILTER (ts IS NULL) AS undated, min(k) AS least FROM (SELECT ts, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE ts >= TIMESTAMP '2024-01-15')")
def tolerant_log_scan(t):
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    broken = t("region").select(F.explode(F.array(F.lit("not json"), F.lit("42"), F.lit(""), F.lit("{ broken"))).alias("value"))
    raw = t("events").select(line.alias("value")).unionByName(broken)
    found = logs.records(raw, since=F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("ts").isNull()).alias("undated"), F.min(F.try_variant_get("j", F.lit("$.k"), "bigint")).alias("least"))


# --- joins -------------------------------------------------------------------------------------------------------------------
@query("SELECT a.conv_id, a.turn, md5(a.text) AS text_a, md5(b.text) AS text_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant'")
def pair_join(t):
    rows = t("conversations").select("conv_id", F.when(c("role") == "user", c("turn")).otherwise(c("turn") - 1).alias("turn"), "role", F.md5("text").alias("text"))
    return joins.role_pairs(rows, ["conv_id", "turn"], "role", "user", "assistant")


@query("SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_left_flag(t):
    return joins.lookup(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query(
    """SELECT doc_id, coalesce(f.quality, s.quality) AS quality, CASE WHEN f.doc_id IS NOT NULL THEN 'fast' ELSE 'slow' END AS source
    FROM (SELECT doc_id, quality FROM labels) f FULL JOIN (SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS quality FROM documents) s USING (doc_id)"""
)
def coalesce_full(t):
    slow = t("documents").select("doc_id", (c("n_chars") % 2).cast("int").alias("quality"))
    return joins.tiered(t("labels").select("doc_id", c("quality").cast("int").alias("quality")), slow, ["doc_id"])


@query(
    """WITH e AS (SELECT l_orderkey AS song, l_orderkey * 8 + floor(l_quantity / 10)::BIGINT AS band, l_orderkey * 8 + l_linenumber AS part, l_returnflag AS side, l_extendedprice::DOUBLE AS x FROM lineitem),
    p AS (SELECT a.song, a.band, a.part AS part_a, b.part AS part_b, a.x AS value_a, b.x AS value_b, least(a.x, b.x) AS severity FROM e a JOIN e b ON a.band = b.band WHERE a.side = 'R' AND b.side = 'A' AND a.x > 20000 AND b.x > 20000)
    SELECT band, part_a, part_b, value_a, value_b, severity, row_number() OVER (PARTITION BY song ORDER BY severity DESC, part_a, part_b, value_a, value_b)::INTEGER AS place FROM p"""
)
def theta_conflicts(t):
    """Orders as pairs of songs, lines as their parts on two sides, quantities as bands; conflicts of a pair by severity."""
    e = t("lineitem").select((c("l_orderkey") * 8 + F.floor(c("l_quantity") / 10)).alias("band"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("part"), c("l_extendedprice").cast("double").alias("x"), "l_returnflag")
    out = joins.both_above(e.where("l_returnflag = 'R'").drop("l_returnflag"), e.where("l_returnflag = 'A'").drop("l_returnflag"), "band", "x", 20000.0, ("part", "part"))
    by_song = Window.partitionBy(F.floor(c("band") / 8)).orderBy(F.desc("severity"), "part_a", "part_b", "value_a", "value_b")
    return out.select("band", "part_a", "part_b", "value_a", "value_b", "severity").withColumn("place", F.row_number().over(by_song))


@query(
    """SELECT p.event_id, v.event_id AS match, abs(epoch_us(v.ts) - epoch_us(p.ts))::DOUBLE AS distance FROM events p JOIN events v USING (user_id)
    WHERE p.event_type = 'purchase' AND v.event_type = 'view'
    QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.event_id) = 1"""
)
def nearest_match(t):
    e = t("events").select("event_id", "user_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).cast("double").alias("us"))
    right = e.where("event_type = 'view'").select("user_id", "us", c("event_id").alias("match"))
    return joins.nearest(e.where("event_type = 'purchase'"), right, ["user_id"], "us", "event_id", "match")


@query("SELECT a.event_id, a.user_id, a.ts, b.ts AS last_click FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_backward(t):
    e = t("events")
    left = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").select("user_id", "ts", c("ts").alias("clicked"))
    return joins.asof_backward(left, right, ["user_id"], "ts", "clicked", "last_click")


@query("SELECT p_partkey, CAST(floor((p_retailprice - 100) / 250) AS INTEGER) AS band FROM part WHERE p_retailprice >= 100 AND p_retailprice < 100 + 250 * 12")
def range_cover(t):
    bands = t("part").sparkSession.range(12).select(c("id").cast("int").alias("band"), (c("id") * 250 + 100).cast("double").alias("lo"), (c("id") * 250 + 350).cast("double").alias("hi"))
    return joins.in_bands(t("part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi").select("p_partkey", "band")


_SPANS = "SELECT s_suppkey, s_acctbal / 5 + 900 AS lo, s_acctbal / 5 + 900 + power(10.0, s_suppkey % 7 - 3) AS hi FROM supplier"


@query(f"WITH b AS ({_SPANS}) SELECT s_suppkey, p_partkey FROM b JOIN part ON p_retailprice >= lo AND p_retailprice < hi WHERE p_partkey % 3 = s_suppkey % 3")
def interval_cover(t):
    """Prices within suppliers' spans, whose lengths are of seven orders of magnitude."""
    low = c("s_acctbal") / 5 + 900
    spans = t("supplier").select("s_suppkey", low.alias("lo"), (low + F.pow(F.lit(10.0), c("s_suppkey") % 7 - 3)).alias("hi"))
    parts = t("part").select("p_partkey", "p_retailprice", (c("p_partkey") % 3).alias("third"))
    return joins.in_bands(parts, spans.withColumn("third", c("s_suppkey") % 3), "p_retailprice", "lo", "hi", on=["third"]).select("s_suppkey", "p_partkey")


@query("SELECT CASE WHEN event_type = 'view' THEN 'view' ELSE 'rest' END AS kind, count(*) AS n, true AS near FROM events GROUP BY 1")
def quantile_sketches(t):
    """Whether quantiles of two keys by mergeable sketches are within 1 % of their ranks, measured on all rows."""
    ranks = (0.1, 0.5, 0.85, 0.99)
    rows = t("events").select(F.when(c("event_type") == "view", "view").otherwise("rest").alias("kind"), "value")
    made = agg.sketched_quantiles(rows, ["kind"], "value", ranks)
    found = agg.ranks_of(rows, ["kind"], "value", made)
    near = [(F.get("ranks", F.lit(k))["below"] <= r + 0.01) & (F.get("ranks", F.lit(k))["upto"] >= r - 0.01) for k, r in enumerate(ranks)]
    return made.join(found, "kind").select("kind", "n", (near[0] & near[1] & near[2] & near[3]).alias("near"))


@query(
    """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS items FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(items, ',') AS items, items = ['A', 'N', 'R'] AS is_valid,
    array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(items, x))), ',') AS missing FROM s"""
)
def set_equal(t):
    out = joins.set_membership(t("lineitem"), ["l_orderkey"], "l_returnflag", {"all": [["A", "N", "R"]]})
    return out.select("l_orderkey", F.array_join("items", ",").alias("items"), "is_valid", F.array_join("missing", ",").alias("missing"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_orphans(t):
    live = t("orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return joins.orphans(t("customer"), live, "c_custkey", "c_acctbal", 5000.0).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS h, lang FROM documents), a AS (SELECT doc_id, h FROM d WHERE lang = 'en'), b AS (SELECT doc_id, h FROM d WHERE lang <> 'en')
    SELECT * FROM a UNION ALL SELECT min(doc_id), h FROM b WHERE h NOT IN (SELECT h FROM a) GROUP BY h"""
)
def merge_if_absent(t):
    d = t("documents").select("doc_id", F.md5("text").alias("h"), "lang")
    return joins.insert_absent(d.where("lang = 'en'").drop("lang"), d.where("lang <> 'en'").drop("lang"), "h", "doc_id")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def shared_items(t):
    return joins.shared_items(t("events"), "event_type", "user_id", "purchase", "error")


@query(
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || o_custkey ELSE 'c' || o_custkey END AS k FROM orders)
    SELECT r.o_orderkey, c.c_name FROM r JOIN customer c ON 'c' || c.c_custkey = replace(r.k, 'u', 'c')"""
)
def alias_resolution(t):
    requests = t("orders").select("o_orderkey", F.concat(F.when(c("o_orderkey") % 3 == 0, "u").otherwise("c"), "o_custkey").alias("k"))
    aliases = t("customer").select(F.concat(F.lit("u"), "c_custkey").alias("alias"), F.concat(F.lit("c"), "c_custkey").alias("content"))
    entries = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("content"), "c_name")
    return joins.through_alias(requests, aliases, entries, "k", "alias", "content").select("o_orderkey", "c_name")


@query(
    """WITH g AS (SELECT user_id, list(floor(epoch(ts) / 100)::BIGINT ORDER BY ts, event_id) AS grid FROM events GROUP BY 1), b AS (SELECT user_id, grid, unnest([0, 5, 400]) AS beat FROM g)
    SELECT user_id, beat, CASE WHEN beat < len(grid) THEN floor(grid[beat + 1] * 1024)::BIGINT
      ELSE floor(grid[-1] * 1024.0 + (beat - len(grid) + 1) * ((grid[-1] - grid[-8])::DOUBLE / 7 * 512 * 2))::BIGINT END AS place FROM b"""
)
def beat_positions(t):
    g = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: F.floor(F.unix_seconds(s["ts"].cast("timestamp")) / 100)).alias("grid"))
    rows = g.withColumn("beat", F.explode(F.array(*map(F.lit, (0, 5, 400)))))
    return rows.select("user_id", "beat", joins.beat_position(c("grid"), c("beat")).alias("place"))


# --- aggregates ------------------------------------------------------------------------------------------------------------
_HOURLY = "WITH h AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS bar,sqrt(avg(value * value)) AS rms FROM events GROUP BY 1, 2)"


def hourly(t) -> DataFrame:
    """(event_type, bar, rms): hours as bars, event types as stems."""
    rows = t("events").withColumn("bar", F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 3600))
    return rows.groupBy("event_type", "bar").agg(agg.rms(c("value")).alias("rms"))


@query(_HOURLY + " SELECT event_type, bar, round(rms, 6) AS rms FROM h")
def bar_rms(t):
    return hourly(t).withColumn("rms", F.round("rms", 6))


_BUCKETS = (
    _HOURLY
    + """, e AS (SELECT bar, sum(CASE WHEN rms < 0.001 THEN 0 ELSE rms END) AS energy FROM h GROUP BY 1),
    p AS (SELECT quantile_cont(energy, 0.99) FILTER (energy > 0) AS p99 FROM e), n AS (SELECT bar, energy / p99 AS norm FROM e, p),
    q AS (SELECT quantile_cont(norm, 0.10) FILTER (norm >= 0.02) AS p10, quantile_cont(norm, 0.50) FILTER (norm >= 0.02) AS p50, quantile_cont(norm, 0.85) FILTER (norm >= 0.02) AS p85 FROM n)"""
)


def energies(t) -> DataFrame:
    e = hourly(t).groupBy("bar").agg(agg.summed_above(c("rms")).alias("energy")).withColumn("song", F.lit(1))
    return agg.classified(agg.normalised_buckets(e, ["song"], "energy"))


@query(_BUCKETS + " SELECT bar, round(norm, 6) AS norm, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p85, 6) AS p85 FROM n, q")
def p99_buckets(t):
    return energies(t).select("bar", *[F.round(x, 6).alias(x) for x in ("norm", "p10", "p50", "p85")])


@query(_BUCKETS + " SELECT CASE WHEN norm < 0.02 THEN 'silent' WHEN norm < p10 THEN 'low' WHEN norm < p50 THEN 'medium' WHEN norm < p85 THEN 'high' ELSE 'peak' END AS energy_class, count(*) AS n FROM n, q GROUP BY 1")
def energy_classes(t):
    return energies(t).groupBy("energy_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT user_id, value > 60 AS active, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, avg(active::INT) AS mean, avg(active::INT) FILTER (k <= greatest(1, n // 3)) AS head, avg(active::INT) FILTER (k > n - greatest(1, n // 3)) AS tail FROM d GROUP BY 1)
    SELECT user_id, CASE WHEN mean > 0.5 AND head > 0.5 AND tail < 0.5 THEN 'vox:fading' WHEN mean > 0.5 THEN 'vox:yes' ELSE 'vox:no' END AS vocal_status FROM s"""
)
def segment_status(t):
    rows = t("events").withColumn("active", c("value") > 60).withColumn("o", F.struct("ts", "event_id"))
    return agg.activity_status(rows, ["user_id"], "active", "o")


@query(
    _HOURLY
    + """, g AS (SELECT *, bar // 24 AS day FROM h), o AS (SELECT event_type, quantile_cont(rms, 0.25) FILTER (rms > 0) AS p25, quantile_cont(rms, 0.9) FILTER (rms > 0) AS p90 FROM h GROUP BY 1),
    s AS (SELECT event_type, day, avg(rms) AS m, max(rms) AS x FROM g GROUP BY 1, 2), a AS (SELECT day, count(*) FILTER (m > p25) AS active, bool_or(x > p90) AS peak FROM s JOIN o USING (event_type) GROUP BY 1)
    SELECT day, active, CASE WHEN active >= 5 AND peak THEN 'full+extra' WHEN active >= 5 THEN 'full' WHEN active >= 3 THEN 'mid' ELSE 'sparse' END AS density FROM a"""
)
def density(t):
    rows = hourly(t).withColumn("day", F.floor(c("bar") / 24)).withColumn("song", F.lit(1))
    return agg.density(rows, ["song"], "day", "event_type", "rms").drop("song")


@query(
    _BUCKETS
    + """, d AS (SELECT bar // 24 AS day, bar, norm, row_number() OVER (PARTITION BY bar // 24 ORDER BY bar) AS k, count(*) OVER (PARTITION BY bar // 24) AS m FROM n),
    t AS (SELECT day, least(3, (k - 1) // greatest(1, m // 3) + 1) AS third, avg(norm) AS x FROM d GROUP BY 1, 2),
    l AS (SELECT day, third, CASE WHEN x < 0.02 THEN 'silent' WHEN x < p10 THEN 'low' WHEN x < p50 THEN 'medium' WHEN x < p85 THEN 'high' ELSE 'peak' END AS c FROM t, q),
    r AS (SELECT *, lag(c) OVER (PARTITION BY day ORDER BY third) AS before FROM l)
    SELECT day, string_agg(c, '->' ORDER BY third) AS trajectory FROM r WHERE before IS NULL OR before <> c GROUP BY 1"""
)
def segment_thirds(t):
    return agg.trajectory(energies(t).withColumn("day", F.floor(c("bar") / 24)), ["day"], "bar")


@query(
    _HOURLY
    + """, a AS (SELECT h.*, bar // 24 AS day, bar IN (SELECT bar FROM h WHERE event_type = 'view' AND rms > 40) AS active FROM h),
    s AS (SELECT day, sum(CASE WHEN event_type = 'view' THEN rms ELSE 0 END) AS v, sum(CASE WHEN event_type <> 'view' THEN rms ELSE 0 END) AS o FROM a WHERE active GROUP BY 1)
    SELECT day, round(CASE WHEN v > 0 AND o > 0 THEN 20 * log10(v / o) END, 6) AS prominence_db FROM s"""
)
def prominence(t):
    h = hourly(t)
    active = h.where("event_type = 'view' and rms > 40").select("bar", F.lit(True).alias("active"))
    rows = h.join(active, "bar", "left").withColumn("active", F.coalesce("active", F.lit(False))).withColumn("day", F.floor(c("bar") / 24))
    return agg.prominence(rows, ["day"], "event_type", "active", "rms", "view").withColumn("prominence_db", F.round("prominence_db", 6))


@query(
    _HOURLY
    + """, s AS (SELECT event_type, avg(rms) FILTER (rms > 0.02) AS m, coalesce(stddev_pop(rms) FILTER (rms > 0.02) / avg(rms) FILTER (rms > 0.02), 0) AS cv FROM h GROUP BY 1)
    SELECT event_type, round(cv, 6) AS cv, CASE WHEN m IS NULL THEN 'consistent low' WHEN cv < 0.15 AND m > 0.6 THEN 'consistent high' WHEN cv < 0.15 THEN 'consistent low' WHEN cv > 0.35 THEN 'wide dynamic range' ELSE 'moderate dynamic range' END AS profile FROM s"""
)
def cv_profile(t):
    return agg.energy_profile(hourly(t), ["event_type"], "rms").withColumn("cv", F.round("cv", 6))


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    s AS (SELECT user_id, quantile_cont(g, 0.5) AS m, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) AS iqr FROM g WHERE g IS NOT NULL GROUP BY 1)
    SELECT user_id, round(60 / m, 9) AS bpm, round(greatest(0, least(1, 1 - iqr / m)), 6) AS confidence FROM s"""
)
def interval_tempo(t):
    out = agg.interval_tempo(t("events"), ["user_id"], F.unix_micros(c("ts").cast("timestamp")) / 1e6, ["ts", "event_id"])
    return out.select("user_id", F.round("bpm", 9).alias("bpm"), F.round("confidence", 6).alias("confidence"))


@query(
    """WITH n AS (SELECT user_id, event_type, count(*) AS n, min({'t': ts, 'e': event_id}) AS f FROM events GROUP BY 1, 2)
    SELECT user_id, event_type AS mode FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"""
)
def first_seen_mode(t):
    return agg.first_seen_mode(t("events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(t):
    return t("events").groupBy("user_id").agg(agg.upper_median("value").alias("median"))


@query(
    """WITH m AS (SELECT user_id, list_sort(list(value * 100 - 5000))[count(*) // 2 + 1] AS med, list(value * 100 - 5000) AS o FROM events GROUP BY 1)
    SELECT user_id, round(med, 6) AS median_offset, abs(med) < 5000 AND len(list_filter(o, lambda x: abs(x - med) < 3000))::DOUBLE / len(o) >= 0.6 AS consistent FROM m"""
)
def offset_consistency(t):
    out = agg.offset_consistency(t("events").withColumn("o", c("value") * 100 - 5000), ["user_id"], "o")
    return out.withColumn("median_offset", F.round("median_offset", 6))


@query(
    _HOURLY
    + """, w AS (SELECT event_type, bar, avg(rms * rms) OVER v AS m, count(*) OVER v AS n FROM h WINDOW v AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
    SELECT event_type, bar AS start, round(m, 6) AS mean_square FROM w WHERE n = 15 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY m DESC, bar) = 1"""
)
def loudest_window(t):
    return agg.loudest_window(hourly(t), ["event_type"], "bar", "rms", 15).withColumn("mean_square", F.round("mean_square", 6))


_PROFILE_ROWS = ", ".join(f"('{s}', {k}, {float(x)}::DOUBLE)" for s, p in (("major", agg.MAJOR_PROFILE), ("minor", agg.MINOR_PROFILE)) for k, x in enumerate(p))


@query(
    f"""WITH e AS (SELECT vec_id, unnest(range(12))::INTEGER AS pitch, unnest(embedding[1:12])::DOUBLE AS x FROM embeddings), p(scale, k, w) AS (VALUES {_PROFILE_ROWS}),
    r AS (SELECT vec_id, t.tonic, scale, corr(x, w) AS r FROM e JOIN (SELECT unnest(range(12))::INTEGER AS tonic) t ON true JOIN p ON (t.tonic + p.k) % 12 = e.pitch GROUP BY 1, 2, 3)
    SELECT vec_id, tonic, scale, round(r, 6) AS correlation FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, tonic) = 1"""
)
def profile_corr(t):
    chroma = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("pitch", "x")).withColumn("x", c("x").cast("double"))
    return agg.key_by_profile(chroma, ["vec_id"], "pitch", "x").select("vec_id", "tonic", "scale", F.round("correlation", 6).alias("correlation"))


@query("SELECT user_id, round(list_reduce(list_prepend(600.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.7 * a + 0.3 * x), 6) AS ema FROM events GROUP BY 1")
def ema_ordered(t):
    return agg.ordered_ema(t("events"), ["user_id"], ["ts", "event_id"], "value", 600.0, 0.3).withColumn("ema", F.round("ema", 6))


@query(
    """WITH d AS (SELECT event_id, row_number() OVER w AS k, list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 150 PRECEDING AND CURRENT ROW) AS v FROM events WINDOW w AS (ORDER BY ts, event_id))
    SELECT event_id, round(list_reduce(CASE WHEN k <= 151 THEN list_prepend(600.0::DOUBLE, v) ELSE v END, lambda a, x: 0.7 * a + 0.3 * x), 6) AS ema FROM d"""
)
def ema_of_all(t):
    """The mean after each event, over all events as one sequence; the SQL starts anew 150 rows before each, which 0.7 ** 150 forgets."""
    return agg.running_emas(t("events").select("event_id", "ts", "value"), [], ["ts", "event_id"], "value", 600.0, 0.3).select("event_id", F.round("ema", 6).alias("ema"))


@query("SELECT o_custkey, round(sqrt(avg(power((a - b) / 2, 2))) / sqrt(avg(power((a + b) / 2, 2))), 9) AS ratio FROM (SELECT o_custkey, o_totalprice AS a, l_extendedprice AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def side_mid(t):
    rows = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey")).select("o_custkey", c("o_totalprice").alias("a"), c("l_extendedprice").alias("b"))
    return rows.groupBy("o_custkey").agg(F.round(agg.side_mid_ratio("a", "b"), 9).alias("ratio"))


@query(
    """WITH l AS (SELECT p_brand, p_size // 10 AS band, 10 * log10(greatest(avg(power(10.0, -p_retailprice / 100)), 1e-12)) AS db FROM part GROUP BY 1, 2)
    SELECT p_brand, band, round(db, 6) AS db, round(db - coalesce(avg(db) FILTER (db > -119) OVER (PARTITION BY p_brand), -120), 6) AS relative_db FROM l"""
)
def band_levels(t):
    rows = t("part").select("p_brand", F.floor(c("p_size") / 10).alias("band"), (-c("p_retailprice") / 10).alias("x"))
    return agg.band_levels(rows, ["p_brand"], "band", "x").select("p_brand", c("band"), F.round("db", 6).alias("db"), F.round("relative_db", 6).alias("relative_db"))


@query(
    """SELECT user_id, count(*) FILTER (value / (value + 40 + 20) > 0.4) AS kick, count(*) FILTER (40 / (value + 60) > 0.3) AS snare, count(*) FILTER (20 / (value + 60) > 0.3) AS hihat, count(*) AS total FROM events GROUP BY 1"""
)
def hit_classes(t):
    rows = t("events").select("user_id", c("value").alias("low"), F.lit(40.0).alias("mid"), F.lit(20.0).alias("high"))
    return agg.hit_classes(rows, ["user_id"])


@query("SELECT r.r_name, coalesce(n, 0) AS n FROM region r LEFT JOIN (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY 1) x USING (r_name)")
def counts_with_absent(t):
    rows = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region").where("r_regionkey < 3"), c("n_regionkey") == c("r_regionkey"))
    return agg.counts_of_all(rows, t("region"), "r_name")


@query("SELECT event_type, round(avg(rms), 6) AS mean, CASE WHEN avg((rms > 45)::INT) < 0.3 THEN 'rare' WHEN avg((rms > 45)::INT) < 0.6 THEN 'partial' ELSE 'constant' END AS presence FROM (" + _HOURLY + " SELECT * FROM h) GROUP BY 1")
def stem_character(t):
    return agg.stem_character(hourly(t), ["event_type"], "rms", 45.0).withColumn("mean", F.round("mean", 6))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) <= 2 AND bool_or(o_orderpriority IN ('high', 'peak')) THEN 'flat loud' WHEN count(DISTINCT o_orderpriority) >= 4 THEN 'wide' ELSE 'moderate' END AS dynamics FROM orders GROUP BY 1")
def dynamics(t):
    return agg.dynamics(t("orders"), ["o_custkey"], "o_orderpriority")


@query("WITH s AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1) SELECT source, bytes, round(bytes / sum(bytes) OVER (), 9) AS share FROM s")
def cache_totals(t):
    return agg.cache_totals(t("documents"), "source", "n_chars").withColumn("share", F.round("share", 9))


# --- sequences ---------------------------------------------------------------------------------------------------------------
@query(_HOURLY + " SELECT event_type, bar, round(rms - lag(rms) OVER (PARTITION BY event_type ORDER BY bar), 6) AS diff FROM h QUALIFY diff IS NOT NULL")
def consecutive_diff(t):
    return seq.differences(hourly(t), ["event_type"], ["bar"], "rms").select("event_type", "bar", F.round("diff", 6).alias("diff"))


@query(_HOURLY + " SELECT event_type, bar, round(sum(rms) OVER (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS smooth FROM h")
def moving_avg_same(t):
    return hourly(t).select("event_type", "bar", F.round(seq.smoothed("rms", seq.by(["event_type"], ["bar"])), 6).alias("smooth"))


_CHANGES = (
    _HOURLY
    + """, s AS (SELECT event_type, bar, sum(rms) OVER (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS s FROM h),
    d AS (SELECT bar, abs(s - lag(s) OVER (PARTITION BY event_type ORDER BY bar)) AS d FROM s), c AS (SELECT bar, max(d) AS change FROM d WHERE d IS NOT NULL GROUP BY 1)"""
)


def changes(t) -> DataFrame:
    return seq.change_signal(hourly(t).withColumn("song", F.lit(1)), ["song"], "bar", "event_type", "rms")


@query(_CHANGES + " SELECT bar, round(change, 6) AS change FROM c")
def boundary_signal(t):
    return changes(t).select("bar", F.round("change", 6).alias("change"))


@query(
    _CHANGES
    + """, l AS (SELECT greatest(3 * quantile_cont(change, 0.5), 0.05) AS lim FROM c), n AS (SELECT bar, change, lag(change) OVER (ORDER BY bar) AS a, lead(change) OVER (ORDER BY bar) AS b FROM c)
    SELECT bar, round(change, 6) AS change FROM n, l WHERE change > a AND change > b AND change >= lim"""
)
def boundary_peaks(t):
    return seq.boundary_candidates(changes(t), ["song"], "bar").select(c("bar").cast("bigint").alias("bar"), F.round("change", 6).alias("change"))


@query()
def spaced_boundaries(t):
    """Distance suppression has no SQL; tests compare it with a plain loop."""
    return seq.boundaries(changes(t), ["song"], "bar").select(F.posexplode("bars").alias("place", "bar"))


_ACTIVE = (
    _HOURLY
    + """, p AS (SELECT *, max(rms) OVER (PARTITION BY event_type) AS peak FROM h),
    s AS (SELECT event_type, bar, coalesce(last_value(CASE WHEN rms > 0.9 * peak THEN 1 WHEN rms <= 0.75 * peak THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bar), 0) AS state FROM p),
    r AS (SELECT *, sum((state IS DISTINCT FROM before)::INT) OVER (PARTITION BY event_type ORDER BY bar) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY bar) AS before FROM s)),
    k AS (SELECT event_type, bar, state, state = 1 AND count(*) OVER (PARTITION BY event_type, run) >= 2 AS active FROM r)"""
)


def active_bars(t) -> DataFrame:
    return seq.activity(hourly(t), ["event_type"], "bar", "rms", 0.9, 0.75, 2)


@query(_ACTIVE + " SELECT event_type, bar, state FROM s")
def hysteresis(t):
    peak = F.max("rms").over(Window.partitionBy("event_type"))
    rows = hourly(t).withColumn("peak", peak)
    return rows.select("event_type", "bar", seq.hysteresis(c("rms"), 0.9 * c("peak"), 0.75 * c("peak"), seq.by(["event_type"], ["bar"])).alias("state"))


@query(_ACTIVE + " SELECT event_type, bar, active FROM k")
def min_run(t):
    return active_bars(t).select("event_type", "bar", "active")


@query(
    _ACTIVE
    + """, g AS (SELECT *, sum((active IS DISTINCT FROM before)::INT) OVER (PARTITION BY event_type ORDER BY bar) AS run FROM (SELECT *, lag(active) OVER (PARTITION BY event_type ORDER BY bar) AS before FROM k))
    SELECT event_type, min(bar) AS start, max(bar) AS end, count(*) AS length FROM g WHERE NOT active GROUP BY event_type, run HAVING count(*) >= 2"""
)
def gaps(t):
    return seq.gaps(active_bars(t), ["event_type"], "bar", "active", 2).select("event_type", "start", "end", "length")


@query(
    """SELECT event_id, user_id, sum(CASE WHEN g > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM
    (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)"""
)
def sessionize(t):
    return seq.sessions(t("events"), ["user_id"], F.unix_micros(c("ts").cast("timestamp")) / 1e6, ["ts", "event_id"], 3600).select("event_id", "user_id", c("session").cast("bigint").alias("session"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def adjacent_dedup(t):
    return seq.changes_only(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query(
    """WITH r AS (SELECT *, sum((event_type IS DISTINCT FROM b)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events))
    SELECT user_id, event_type, run, min(event_id) AS start, max(event_id) AS "end", count(*) AS n_merged, max(value) AS value FROM r GROUP BY user_id, run, event_type"""
)
def run_merge(t):
    rows = t("events").select("user_id", "event_type", c("event_id").alias("run"), c("event_id").alias("start"), c("event_id").alias("end"), "value")
    return seq.merged_runs(rows, ["user_id"], "run", "event_type", "start", "end", {"value": c("value")})


_SPANS = "WITH s AS (SELECT o_custkey AS plan, o_orderkey AS id, (epoch(o_orderdate) // 86400)::BIGINT AS a, (epoch(o_orderdate) // 86400)::BIGINT + o_orderkey % 200 AS b, 60::BIGINT AS t FROM orders)"


@query(
    _SPANS
    + """, l AS (SELECT *, lead(a) OVER (PARTITION BY plan ORDER BY a, b, id) AS nx FROM s), e AS (SELECT plan, id, a, t, CASE WHEN b > nx OR nx - b > 1 THEN nx ELSE b END AS b, nx IS NULL AS final FROM l),
    k AS (SELECT *, lead(a) OVER (PARTITION BY plan ORDER BY a, b, id) IS NULL AS last FROM e WHERE b - a >= 4)
    SELECT plan, id, a, CASE WHEN last THEN CAST(ceil(b / 4.0) * 4 AS BIGINT) ELSE b END AS b, least(t, (b - a) // 2) AS t FROM k"""
)
def interval_repair(t):
    day = F.floor(F.unix_seconds(c("o_orderdate").cast("timestamp")) / 86400)
    rows = t("orders").select(c("o_custkey").alias("plan"), c("o_orderkey").alias("id"), day.alias("a"), (day + c("o_orderkey") % 200).alias("b"), F.lit(60).cast("bigint").alias("t"))
    return seq.repaired(rows, ["plan"], "a", "b", 4, "t", ties=["id"])


@query(
    """SELECT o_orderkey, CASE WHEN s < least(210, m) * 0.7 THEN 'short' WHEN s > 315 THEN 'long' ELSE 'ok' END AS verdict,
    CASE WHEN s > 315 AND NOT s < least(210, m) * 0.7 THEN CAST(floor(315.0 * bpm / 60) AS INTEGER) ELSE beats END AS max_beats
    FROM (SELECT o_orderkey, CAST(o_totalprice / 300 AS INTEGER) AS beats, 60 + o_orderkey % 120 AS bpm, 100.0 + o_orderkey % 200 AS m, CAST(o_totalprice / 300 AS INTEGER) * 60.0 / (60 + o_orderkey % 120) AS s FROM orders)"""
)
def duration_gate(t):
    rows = t("orders").select("o_orderkey", F.rint(c("o_totalprice") / 300).cast("int").alias("beats"), (60 + c("o_orderkey") % 120).alias("bpm"), (100.0 + c("o_orderkey") % 200).alias("m"))
    return seq.duration_gate(rows, "beats", "bpm", "m").select("o_orderkey", "verdict", "max_beats")


@query(
    """SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source) - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents) WHERE rest > 60000"""
)
def lru_evict(t):
    return seq.evicted(t("documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 60000).select("source", "doc_id")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) * 600 AS BIGINT) AS eta_s FROM orders")
def queue_position(t):
    out = seq.queue_positions(t("orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", c("position").cast("bigint").alias("position"), c("eta_s").cast("bigint").alias("eta_s"))


@query("SELECT event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m")
def high_water(t):
    return seq.high_water(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value")


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS low FROM events")
def lookahead_min(t):
    return t("events").select("event_id", seq.lookahead_min("value", seq.by(["user_id"], ["ts", "event_id"]), 5).alias("low"))


@query(
    _HOURLY
    + """, w AS (SELECT event_type, bar, sqrt(avg(rms * rms / 10000) OVER v + 1e-20) AS level, count(*) OVER v AS n FROM h WINDOW v AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    f AS (SELECT * FROM w WHERE n = 4), t AS (SELECT event_type, quantile_cont(level, 0.5) AS wanted FROM f WHERE level > power(10, -2.25) GROUP BY 1)
    SELECT event_type, bar, round(level, 6) AS level, round(greatest(-4, least(6, 20 * log10(wanted / level))), 6) AS gain_db FROM f JOIN t USING (event_type)"""
)
def level_windows(t):
    out = seq.level_windows(hourly(t).withColumn("e", c("rms") * c("rms") / 10000), ["event_type"], "bar", "e")
    return out.select("event_type", "bar", F.round("level", 6).alias("level"), F.round("gain_db", 6).alias("gain_db"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 3 OR k IN (0, (n - 1) // 2, n - 1)")
def even_sample(t):
    return seq.evenly(t("conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn")


@query(
    """WITH s AS (SELECT o_custkey AS plan, o_orderkey AS idx, o_totalprice / 500000 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    b AS (SELECT *, (k - 1) * 32 AS a, k * 32 AS e, lag(g) OVER (PARTITION BY plan ORDER BY idx) AS p, max(k * 32) OVER (PARTITION BY plan) AS last FROM s)
    SELECT plan, idx, greatest(0, a - 4) AS from_beat, least(last, a + 4) AS to_beat, p AS gain_from, g AS gain_to FROM b WHERE p IS NOT NULL AND abs(p - g) >= 0.001"""
)
def gain_transitions(t):
    k = F.row_number().over(seq.by(["o_custkey"], ["o_orderkey"]))
    rows = t("orders").select(c("o_custkey").alias("plan"), c("o_orderkey").alias("idx"), (c("o_totalprice") / 500000).alias("g"), k.alias("k"))
    rows = rows.select("plan", "idx", "g", ((c("k") - 1) * 32).alias("start_beat"), (c("k") * 32).alias("end_beat"), F.lit(8).alias("transition_beats"))
    out = seq.transitions(rows, ["plan"], "idx", "g")
    return out.select("plan", "idx", c("from_beat").cast("bigint").alias("from_beat"), c("to_beat").cast("bigint").alias("to_beat"), "gain_from", "gain_to")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / 1e5 AS first, l.e / 1e5 AS last FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS e FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)
    SELECT o_orderkey, coalesce(p > 0.01 AND first > p * 1.5, false) AS is_drop FROM (SELECT *, lag(last) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM s)"""
)
def section_drops(t):
    last = t("lineitem").groupBy("l_orderkey").agg((F.max("l_extendedprice") / 1e5).alias("last"))
    rows = t("orders").join(last, c("o_orderkey") == c("l_orderkey")).select("o_custkey", "o_orderkey", (c("o_totalprice") / 1e5).alias("first"), "last")
    return seq.drops(rows, ["o_custkey"], "o_orderkey", "first", "last").select("o_orderkey", "is_drop")


@query(
    """WITH d AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, max(n) AS n, avg(value) FILTER (k <= greatest(1, n // 4)) AS a, avg(value) FILTER (k > n - greatest(1, n // 4)) AS b FROM d GROUP BY 1)
    SELECT user_id, n >= 4 AND a > 0.01 AND b > a * 1.5 AS is_build FROM s"""
)
def build_detection(t):
    return seq.builds(t("events").withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", "value").select("user_id", "is_build")


# --- ranking, de-duplication, sets ---------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def topk_per_group(t):
    return topk.first_per(t("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 2).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """WITH g AS (SELECT l_suppkey, l_quantity, l_orderkey * 8 + l_linenumber AS o, -l_discount * 100 AS gain FROM lineitem), d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY gain, o) = 1)
    SELECT l_suppkey, l_quantity, greatest(-4, least(0, gain)) AS gain FROM d QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY gain, o) <= 4"""
)
def dedupe_keep_min(t):
    rows = t("lineitem").select("l_suppkey", "l_quantity", (c("l_orderkey") * 8 + c("l_linenumber")).alias("o"), (-c("l_discount") * 100).alias("gain"))
    return topk.capped_corrections(rows, ["l_suppkey"], "l_quantity", "gain", "o").select("l_suppkey", "l_quantity", "gain")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def hash_dedup(t):
    return topk.distinct_by(t("documents").select("doc_id", "text"), F.md5("text"), ["doc_id"]).select("doc_id")


@query(
    """WITH k AS (SELECT o_orderkey AS id, o_orderpriority AS f FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT f, count(*) AS c FROM k GROUP BY 1), s AS (SELECT o_orderkey AS id, o_orderpriority AS f FROM orders WHERE o_orderstatus <> 'P'),
    r AS (SELECT s.id, s.f, row_number() OVER (ORDER BY coalesce(c, 0), s.id) AS r FROM s LEFT JOIN n USING (f))
    SELECT id, f FROM k UNION ALL SELECT id, f FROM r WHERE r <= (SELECT count(*) // 2 FROM orders) - (SELECT count(*) FROM k)"""
)
def backfill(t):
    """Pending orders, filled up to half of all orders from the others."""
    rows = t("orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("f"), "o_orderstatus")
    pending = c("o_orderstatus") == "P"
    return topk.backfilled(rows.where(pending).drop("o_orderstatus"), rows.where(~pending).drop("o_orderstatus"), "id", "f", "id", rows.count() // 2)


@query(
    """SELECT n_nationkey, CASE WHEN h.k IS NULL THEN 'add' WHEN s.k IS NULL AND managed THEN 'drop' ELSE 'keep' END AS action
    FROM nation n LEFT JOIN (SELECT n_nationkey AS k, n_name < 'NATION_2' AS managed FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') h ON n.n_nationkey = h.k
    LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 6000) s ON n.n_nationkey = s.k WHERE h.k IS NOT NULL OR s.k IS NOT NULL"""
)
def reconcile(t):
    """What is on the shelf (nations but Asia's) against what is wanted (nations of rich suppliers); some are managed."""
    have = t("nation").join(t("region").where("r_name <> 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    want = t("supplier").where("s_acctbal > 6000").select(c("s_nationkey").alias("n_nationkey")).distinct()
    return topk.reconciled(have, want, "n_nationkey", c("n_name") < "NATION_2")


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(t):
    return t("nation").select("n_nationkey").exceptAll(t("supplier").where("s_acctbal > 5000").select("s_nationkey").distinct()).distinct()


@query("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < -900")
def set_intersection(t):
    return t("supplier").where("s_acctbal < 0").select(c("s_nationkey").alias("k")).intersect(t("customer").where("c_acctbal < -900").select("c_nationkey"))


@query(
    """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_filter(['A', 'N', 'X'], lambda x: NOT list_contains(r, x))) AS missing, len(list_filter(r, lambda x: NOT list_contains(['A', 'N', 'X'], x))) AS extra FROM s"""
)
def set_report(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("r"))
    report = topk.set_report(F.array(*map(F.lit, "ANX")), c("r"))
    return rows.select("l_orderkey", F.size(report["missing"]).cast("bigint").alias("missing"), F.size(report["extra"]).cast("bigint").alias("extra"))


# --- scalar functions -------------------------------------------------------------------------------------------------------------
@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def url_parse(t):
    return t("pages").select("page_id", urls.host(c("url")).alias("host"), urls.query_value(c("url"), "page").alias("page"), urls.scheme(c("url")).alias("scheme"))


@query(
    """SELECT page_id, CASE WHEN NOT u LIKE 'https://%' THEN 'scheme' WHEN u LIKE '%@%' THEN 'user' WHEN regexp_matches(u, ':\\d+') AND NOT u LIKE '%:443%' THEN 'port' WHEN NOT regexp_matches(u, '^https://(www\\.|m\\.)?youtube\\.com') THEN 'unknown host' ELSE 'ok' END AS verdict
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || page_id WHEN 1 THEN 'https://youtube.com@evil.example/' || page_id WHEN 2 THEN 'https://m.youtube.com:8443/' WHEN 3 THEN 'https://m.youtube.com:443/x' ELSE url END AS u FROM pages)"""
)
def url_validate(t):
    n = c("page_id") % 5
    u = F.when(n == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), "page_id")).when(n == 1, F.concat(F.lit("https://youtube.com@evil.example/"), "page_id")).when(n == 2, F.lit("https://m.youtube.com:8443/")).when(n == 3, F.lit("https://m.youtube.com:443/x")).otherwise(c("url"))
    return t("pages").select("page_id", urls.verdict(u).alias("verdict"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'id' || page_id WHEN 1 THEN 'v' || page_id WHEN 2 THEN 's' || page_id END AS video_id,
    CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=id' || page_id WHEN 1 THEN 'https://www.youtube.com/watch?v=v' || page_id WHEN 2 THEN 'https://www.youtube.com/watch?v=s' || page_id ELSE 'https://x.example/p?a=2&b=1' END AS normal FROM pages"""
)
def video_ids(t):
    n, i = c("page_id") % 4, c("page_id").cast("string")
    u = F.when(n == 0, F.concat(F.lit("https://youtu.be/id"), i, F.lit("?t=3"))).when(n == 1, F.concat(F.lit("https://youtube.com/watch?a=b&v=v"), i)).when(n == 2, F.concat(F.lit("https://www.youtube.com/shorts/s"), i, F.lit("/"))).otherwise(F.lit("https://x.example/p/?b=1&a=2#f"))
    return t("pages").select("page_id", urls.video_id(u).alias("video_id"), urls.normalized(u).alias("normal"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'Artist ' || doc_id ELSE 'Artist ' || doc_id || ' Song' END AS artist,
    CASE WHEN doc_id % 7 = 0 THEN 'Part ' || source WHEN doc_id % 3 = 0 THEN 'Song - Part ' || source ELSE 'Song ' || source END AS title FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 3 = 0"""
)
def filename_parse(t):
    name = F.concat(F.lit("0"), (c("doc_id") % 9 + 1).cast("string"), F.lit(". Artist_"), c("doc_id").cast("string"), F.when(c("doc_id") % 7 == 0, F.lit("_")).otherwise(F.lit(" - ")), F.when(c("doc_id") % 3 == 0, F.lit("Song - Part ")).otherwise(F.lit("Song ")), c("source"), F.lit(" (Official Audio) [HD] (Live at Home).mp3"))
    rows = t("documents").select("doc_id", text.artist_title(name).alias("p"))
    return rows.where("p is not null").select("doc_id", "p.artist", "p.title")


@query(
    """SELECT doc_id, s.i AS line, greatest(0, s.i * 61 + 0.25 - 0.5)::DOUBLE AS seconds, source || ' ' || s.i AS text FROM documents, (SELECT unnest(range(3)) AS i) s"""
)
def lrc_explode(t):
    line = lambda k: F.concat(F.lit(f"[{k * 61 // 60}:{k * 61 % 60:02d}.25] "), c("source"), F.lit(f" {k}"))
    lrc = F.concat_ws("\n", F.lit("[ar:x]"), F.lit("[offset: -500]"), line(2), F.lit(""), line(0), F.lit("no stamp"), line(1))
    rows = t("documents").select("doc_id", F.posexplode(text.lyric_lines(lrc)).alias("line", "e"))
    return rows.select("doc_id", c("line").cast("bigint").alias("line"), "e.seconds", "e.text")


@query("SELECT doc_id, count(*) FILTER (x <> '') AS lines FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS x FROM documents) GROUP BY 1")
def plain_lines(t):
    return t("documents").select("doc_id", F.size(text.plain_lines(c("text"))).cast("bigint").alias("lines"))


@query("SELECT doc_id, sha256(source || ':' || lang || ':' || lower(trim('  ' || text, ' '))) AS key FROM documents")
def cache_key(t):
    return t("documents").select("doc_id", keys.content_key(c("source"), c("lang"), F.concat(F.lit("  "), "text")).alias("key"))


@query(
    """SELECT page_id, '#' || substr(h, 1, 6) AS c0, '#' || substr(h, 19, 6) AS c3, ('0x' || substr(h, 25, 2))::INTEGER % 3 AS variant FROM (SELECT page_id, sha256(url) AS h FROM pages)"""
)
def sleeve_palette(t):
    rows = t("pages").select("page_id", keys.palette(c("url")).alias("p"))
    return rows.select("page_id", "p.c0", "p.c3", "p.variant")


@query(
    """SELECT doc_id, CASE WHEN m LIKE '%video unavailable%' OR m LIKE '%geo%' OR m LIKE '%region%' OR m LIKE '%country%' OR m LIKE '%terminated%' THEN 'permanent'
    WHEN m LIKE '%403%' OR m LIKE '%429%' OR m LIKE '%rate%' OR m LIKE '%connection%' OR m LIKE '%network%' OR m LIKE '%resolve%' OR m LIKE '%timeout%' THEN 'transient' WHEN s >= 500 OR s IN (429, 400) THEN 'transient' ELSE 'permanent' END AS error_class
    FROM (SELECT doc_id, CAST(400 + doc_id % 110 AS INTEGER) AS s, CASE doc_id % 6 WHEN 0 THEN 'video unavailable' WHEN 1 THEN 'http error 403' WHEN 2 THEN 'geo blocked, timeout' WHEN 3 THEN 'rate limit' ELSE 'boom' END AS m FROM documents)"""
)
def error_class(t):
    n = c("doc_id") % 6
    m = F.when(n == 0, "Video unavailable").when(n == 1, "HTTP error 403").when(n == 2, "Geo blocked, timeout").when(n == 3, "RATE limit").otherwise("boom")
    return t("documents").select("doc_id", rules.error_class((400 + c("doc_id") % 110).cast("int"), m).alias("error_class"))


_BPM = "SELECT l_orderkey, l_linenumber, l_quantity * 3 + 50 AS v, l_discount * 1000 + 70 AS i FROM lineitem"
_TARGET = """CASE WHEN abs(v - i) / greatest(v, i) <= 0.04 THEN i WHEN abs(v - i) / greatest(v, i) <= 0.10 THEN i * 0.65 + v * 0.35 WHEN abs(v - i) / greatest(v, i) <= 0.20 OR abs(v - (i * 0.7 + v * 0.3)) / v <= 0.12 THEN i * 0.7 + v * 0.3
    WHEN v > i * 0.7 + v * 0.3 THEN v * 0.88 ELSE v * 1.12 END"""


def tempos(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") * 3 + 50).alias("v"), (c("l_discount") * 1000 + 70).alias("i"))


@query(f"SELECT l_orderkey, l_linenumber, round({_TARGET}, 6) AS target FROM ({_BPM})")
def target_bpm(t):
    return tempos(t).select("l_orderkey", "l_linenumber", F.round(music.target_bpm(c("v"), c("i")), 6).alias("target"))


@query(
    f"""WITH t AS (SELECT *, {_TARGET} AS t FROM ({_BPM})), r AS (SELECT *, v / t AS rv, i / t AS ri, abs(1 - v / t) AS dv, abs(1 - i / t) AS di FROM t),
    l AS (SELECT *, CASE WHEN rv > 1 THEN (dv > 0.25)::INT + (dv > 0.35)::INT ELSE (dv > 0.30)::INT + (dv > 0.45)::INT END AS lv,
      CASE WHEN ri > 1 THEN (di > 0.25)::INT + (di > 0.35)::INT ELSE (di > 0.25)::INT + (di > 0.45)::INT END AS li0 FROM r), k AS (SELECT *, CASE WHEN lv < 2 AND di > 0.001 THEN li0 ELSE 0 END AS li FROM l)
    SELECT l_orderkey, l_linenumber, lv < 2 AND li < 2 AS sv, lv < 2 AND li < 2 AND di > 0.001 AS si, (lv = 2 OR li = 2)::INT + (lv = 1 OR li = 1)::INT AS n_warnings,
    round(greatest(CASE WHEN lv < 2 AND li < 2 THEN abs(t - v) / v * 100 ELSE 0 END, CASE WHEN lv < 2 AND li < 2 AND di > 0.001 THEN abs(t - i) / i * 100 ELSE 0 END), 6) AS pct FROM k"""
)
def tempo_plan(t):
    rows = tempos(t).withColumn("p", music.tempo_plan(c("v"), c("i")))
    return rows.select("l_orderkey", "l_linenumber", c("p.stretch_vocals").alias("sv"), c("p.stretch_instrumentals").alias("si"), F.size("p.warnings").alias("n_warnings"), F.round("p.stretch_pct", 6).alias("pct"))


@query(
    f"""WITH t AS (SELECT *, {_TARGET} AS t, (100 + l_orderkey % 300)::DOUBLE AS da, (90 + l_orderkey % 250)::DOUBLE AS db FROM ({_BPM}))
    SELECT l_orderkey, l_linenumber, round(least(least(210, da * 0.75) * (v / t), least(210, db * 0.75) * (i / t)), 6) AS budget FROM t"""
)
def material_budget(t):
    rows = tempos(t).withColumn("t", music.target_bpm(c("v"), c("i")))
    return rows.select("l_orderkey", "l_linenumber", F.round(music.material_budget(c("v"), 100.0 + c("l_orderkey") % 300, c("i"), 90.0 + c("l_orderkey") % 250, c("t")), 6).alias("budget"))


_NOTES = ", ".join(f"'{n}'" for n in music.SHARPS)


@query(
    f"""WITH p AS (SELECT l_orderkey AS i, l_linenumber AS j, (l_partkey % 13)::INTEGER AS a, (l_suppkey % 12)::INTEGER AS b, CASE WHEN l_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS sa, CASE WHEN l_suppkey % 3 = 0 THEN 'major' ELSE 'minor' END AS sb,
      l_partkey % 13 = 12 OR l_quantity < 5 OR coalesce(CASE WHEN l_linenumber < 7 THEN l_discount * 10 END < 0.4, false) OR l_tax > 0.07 AS none FROM lineitem),
    r AS (SELECT *, CASE WHEN sa = 'minor' THEN (a + 3) % 12 ELSE (a + 9) % 12 END AS a1, CASE WHEN sb = 'minor' THEN (b + 3) % 12 ELSE (b + 9) % 12 END AS b2 FROM p),
    d AS (SELECT *, least(abs(a1 - b), 12 - abs(a1 - b)) AS d1, least(abs(a - b2), 12 - abs(a - b2)) AS d2 FROM r),
    e AS (SELECT *, CASE WHEN sa = sb OR d1 > d2 THEN a ELSE a1 END AS ea, CASE WHEN sa = sb OR d1 <= d2 THEN b ELSE b2 END AS eb, CASE WHEN sa = sb OR d1 <= d2 THEN sb ELSE sa END AS sc FROM d),
    f AS (SELECT *, least(abs(ea - eb), 12 - abs(ea - eb)) AS dist, (ea - eb + 12) % 12 AS up FROM e),
    g AS (SELECT *, CASE WHEN dist = 0 THEN 0 ELSE (CASE WHEN up BETWEEN 1 AND 6 THEN 1 ELSE -1 END) * least(dist, 4) END AS shift_b, CASE WHEN dist <= 4 THEN 0 ELSE (CASE WHEN (eb - ea + 12) % 12 BETWEEN 1 AND 6 THEN 1 ELSE -1 END) * (dist - 4) END AS shift_a FROM f)
    SELECT i, j, CASE WHEN none OR dist = 0 THEN 'skip' WHEN dist = 6 THEN 'warning' ELSE 'shift' END AS action, CASE WHEN none THEN 0 ELSE shift_a END::DOUBLE AS shift_a, CASE WHEN none THEN 0 ELSE shift_b END::DOUBLE AS shift_b,
      CASE WHEN none THEN '' ELSE ([{_NOTES}])[(eb + shift_b + 12) % 12 + 1] END AS target_key, CASE WHEN none THEN '' ELSE sc END AS target_scale, CASE WHEN none THEN 0 ELSE dist END::INTEGER AS distance FROM g"""
)
def key_plan(t):
    """Lines as pairs of songs; a thirteenth key is unknown, and low confidence (null is none) and rap skip a pair."""
    name = lambda k, n: F.when(k % n < 12, music.note_name((k % n).cast("int")))
    scale = lambda k, n: F.when(k % n == 0, "major").otherwise("minor")
    sure_a, sure_b = F.when(c("l_quantity") < 5, 0.1).otherwise(0.9), F.when(c("l_linenumber") < 7, c("l_discount") * 10)
    plan = music.key_plan(name(c("l_partkey"), 13), scale(c("l_partkey"), 2), sure_a, name(c("l_suppkey"), 12), scale(c("l_suppkey"), 3), sure_b, c("l_tax") > 0.07)
    return t("lineitem").select(c("l_orderkey").alias("i"), c("l_linenumber").alias("j"), plan.alias("p")).select("i", "j", "p.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN x < -60 THEN 1.0 WHEN x < -28 THEN 1.3 WHEN x < -23 THEN 1.15 WHEN x <= -18 THEN 1.0 WHEN x < -13 THEN 0.9 ELSE 0.8 END::DOUBLE AS factor FROM (SELECT l_orderkey, l_linenumber, -l_quantity * 1.5 AS x FROM lineitem)")
def lufs_adj(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", music.lufs_adjustment(-c("l_quantity") * 1.5).alias("factor"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN age >= 1200000 WHEN 'O' THEN age >= 9000000 ELSE age > 100000000 END AS expired,
    CASE WHEN o_orderkey % 11 = 0 THEN 'not_found' WHEN CASE o_orderstatus WHEN 'P' THEN age >= 1200000 WHEN 'O' THEN age >= 9000000 ELSE age > 100000000 END THEN 'expired' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'processing' END AS state
    FROM (SELECT *, epoch(TIMESTAMP '2024-01-31') - epoch(o_orderdate) AS age FROM orders)"""
)
def ttl_status(t):
    status = F.when(c("o_orderstatus") == "P", "processing").when(c("o_orderstatus") == "O", "queued").otherwise("complete")
    age = times.age_seconds(c("o_orderdate").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    gone = rules.expired(status, age, 1e8, 1.2e6, 9e6)
    return t("orders").select("o_orderkey", gone.alias("expired"), rules.public_state(c("o_orderkey") % 11 != 0, gone, status).alias("state"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 600.0 ELSE least(600.0, 30.0 * power(2, o_orderkey % 8)) END::DOUBLE AS delay FROM orders")
def retry_delays(t):
    code = F.when(c("o_orderkey") % 4 == 0, "invalid_input").otherwise("transient")
    return t("orders").select("o_orderkey", rules.retry_delay(code, c("o_orderkey") % 8 + 1).alias("delay"))


@query(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 40 > 16 THEN 'long_intro' END, CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 200 > 120 THEN 'zero_start_instrumental' END,
    CASE WHEN o_totalprice / 10000 > 25 THEN 'high_stretch_' || CAST(round_even(o_totalprice / 10000, 0) AS INTEGER) || '%' END, CASE WHEN o_orderkey % 9 - 4 NOT BETWEEN -3 AND 3 THEN 'high_key_shift' END, CASE WHEN o_orderstatus = 'P' THEN 'beat_grid_fallback' END,
    CASE WHEN -20 - o_custkey % 40 BETWEEN -50 AND -35 THEN 'borderline_stem' END, CASE WHEN o_custkey % 30 / 1000.0 < 0.01 AND o_orderpriority < '3' THEN 'ghost_stem' END,
    CASE WHEN o_orderkey % 100 > 0 AND o_custkey % 100 > 0 AND abs(o_orderkey % 100 - o_custkey % 100)::DOUBLE / (o_custkey % 100) > 0.1 THEN 'duration_mismatch' END], lambda x: x IS NOT NULL), ',') AS flags FROM orders"""
)
def red_flags(t):
    """All eight rules over columns that make each fire and not fire."""
    cust, key = c("o_custkey"), c("o_orderkey")
    active = F.when(c("o_orderpriority") < "3", F.array(F.lit("guitar"))).otherwise(F.array(F.lit("drums")))
    columns = {
        "intro_beats": key % 40, "start_b": cust % 5, "duration_b": (key % 200).cast("double"), "stretch_pct": c("o_totalprice") / 10000, "inst_semitones": key % 9 - 4, "grid": F.when(c("o_orderstatus") == "P", "scaled_fallback").otherwise("grid"),
        "lufs": F.create_map(F.lit("vocals"), (-20 - cust % 40).cast("double")), "rms": F.create_map(F.lit("guitar"), cust % 30 / 1000.0, F.lit("piano"), F.lit(0.5)), "active": active, "rendered": (key % 100).cast("double"), "estimated": (cust % 100).cast("double"),
    }
    return t("orders").select("o_orderkey", F.array_join(rules.run_flags(columns.get), ",").alias("flags"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))")
def outcome_counts(t):
    return t("events").groupingSets([["user_id", "event_type"], ["user_id"]], "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") > 50).alias("high"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Cmaj7' WHEN 1 THEN 'F#m' WHEN 2 THEN 'Bb7' WHEN 3 THEN 'Dm7/F' ELSE 'N' END AS sheet, CASE p_partkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'F#m' WHEN 2 THEN 'Bb7' WHEN 3 THEN 'ii' ELSE 'N' END AS roman FROM part")
def chord_names(t):
    jams = F.get(F.array(*map(F.lit, ("C:maj7", "F#:min", "Bb:7", "D:min7/b3", "N"))), (c("p_partkey") % 5).cast("int"))
    return t("part").withColumn("sheet", music.lead_sheet(jams)).select("p_partkey", "sheet", music.roman(c("sheet"), F.lit("C")).alias("roman"))


@query(
    """SELECT p_partkey, CASE WHEN t = 0 THEN 'silent' WHEN t < 10 THEN 'sparse' WHEN k::DOUBLE / t > 0.35 AND h::DOUBLE / t < 0.4 THEN 'four_on_floor' WHEN k::DOUBLE / t > 0.3 AND h::DOUBLE / t > 0.4 THEN 'trap' WHEN h::DOUBLE / t > 0.5 THEN 'breakbeat' ELSE 'standard' END AS style
    FROM (SELECT p_partkey, p_size AS k, p_partkey % 40 AS h, p_size + p_partkey % 40 + p_partkey % 7 AS t FROM part)"""
)
def drum_styles(t):
    k, h = c("p_size"), c("p_partkey") % 40
    return t("part").select("p_partkey", music.drum_style(k, h, k + h + c("p_partkey") % 7).alias("style"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN hz BETWEEN 2000 AND 5000 OR pv >= po THEN o ELSE v END AS cut, greatest(1.5, least(3.0, l_quantity / 4.0)) AS q
    FROM (SELECT *, CASE v WHEN 'vocals' THEN 100 ELSE 20 END AS pv, CASE o WHEN 'bass' THEN 80 WHEN 'drums' THEN 60 ELSE 20 END AS po FROM
      (SELECT *, l_quantity * 200 AS hz, CASE WHEN l_linenumber % 2 = 0 THEN 'vocals' ELSE 'lead_vocals' END AS v, CASE l_suppkey % 3 WHEN 0 THEN 'bass' WHEN 1 THEN 'drums' ELSE 'pad' END AS o FROM lineitem))"""
)
def cut_resolution(t):
    v = F.when(c("l_linenumber") % 2 == 0, "vocals").otherwise("lead_vocals")
    o = F.when(c("l_suppkey") % 3 == 0, "bass").when(c("l_suppkey") % 3 == 1, "drums").otherwise("pad")
    return t("lineitem").select("l_orderkey", "l_linenumber", music.cut_stem(v, o, c("l_quantity") * 200).alias("cut"), music.filter_q(c("l_quantity")).alias("q"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v < -40 OR w < -40 THEN 1.0 ELSE round(power(10, greatest(-12, least(12, w + 2 - v)) / 20), 9) END AS gain FROM (SELECT l_orderkey, l_linenumber, -l_quantity AS v, -l_tax * 500 AS w FROM lineitem)")
def level_gains(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(music.level_gain(-c("l_quantity"), -c("l_tax") * 500), 9).alias("gain"))


# --- plans ---------------------------------------------------------------------------------------------------------------------------
def intents(t) -> DataFrame:
    """Orders as plans: lines as sections, flags and quantities as roles. Lines are dealt by plan, and stems are made of them where they lie."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = lines.repartition(scans.shares(lines, STEM_LINES_A_TASK), "l_orderkey")
    label = F.get(F.array(*map(F.lit, ("intro", "verse", "chorus", "breakdown", "drop", "bridge", "outro"))), (c("l_linenumber") - 1) % 7)
    energy = F.get(F.array(*map(F.lit, ("low", "medium", "high", "peak"))), (c("l_suppkey") % 4).cast("int"))
    role = lambda k: F.get(F.array(*map(F.lit, ("lead", "support", "silent", "texture", "silent", "background"))), ((c("l_partkey") + c("l_linenumber") * k + k * k) % 6).cast("int"))
    roles = F.create_map(*[x for k, s in enumerate(gains.STEMS) for x in (F.lit(s), role(k))])
    idx = F.row_number().over(seq.by(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))
    return lines.select(c("l_orderkey").alias("plan_id"), idx.alias("idx"), label.alias("label"), energy.alias("energy"), roles.alias("stem_roles"))


def intent_rows(t) -> DataFrame:
    rows = gains.every_stem(intents(t))
    return rows.withColumn("lufs", F.when(c("pos") % 2 == 0, -10.0 - (c("plan_id") + c("pos") * 7) % 25))


_STEM_ROWS = """WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS idx FROM lineitem),
    r AS (SELECT l_orderkey AS plan_id, idx, (['intro', 'verse', 'chorus', 'breakdown', 'drop', 'bridge', 'outro'])[(l_linenumber - 1) % 7 + 1] AS label, (['low', 'medium', 'high', 'peak'])[l_suppkey % 4 + 1] AS energy, k AS pos,
      (['lead_vocals', 'backing_vocals', 'drums', 'bass', 'guitar', 'piano', 'other'])[k + 1] AS stem, (['lead', 'support', 'silent', 'texture', 'silent', 'background'])[(l_partkey + l_linenumber * k + k * k) % 6 + 1] AS role, CASE WHEN k % 2 = 0 THEN -10.0 - (l_orderkey + k * 7) % 25 END AS lufs
    FROM l, (SELECT unnest(range(7)) AS k)),
    b AS (SELECT *, CASE role WHEN 'lead' THEN 0.92 WHEN 'support' THEN 0.82 WHEN 'background' THEN 0.55 WHEN 'texture' THEN 0.30 ELSE 0 END::DOUBLE * CASE energy WHEN 'low' THEN 0.75 WHEN 'medium' THEN 0.9 WHEN 'high' THEN 1.0 ELSE 1.05 END::DOUBLE
      * CASE WHEN role = 'silent' OR lufs IS NULL THEN 1.0 WHEN lufs < -28 THEN 1.3 WHEN lufs < -23 THEN 1.15 WHEN lufs <= -18 THEN 1.0 WHEN lufs < -13 THEN 0.9 ELSE 0.8 END::DOUBLE AS g0, CASE role WHEN 'support' THEN 0.6 WHEN 'background' THEN 0.4 WHEN 'texture' THEN 0.2 ELSE 0 END::DOUBLE AS floor,
      CASE energy WHEN 'peak' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS e, pos >= 2 AS inst FROM r),
    s0 AS (SELECT *, greatest(floor, least(1.0, g0)) AS gain FROM b)"""


@query(_STEM_ROWS + " SELECT plan_id, idx, stem, round(gain, 6) AS gain FROM s0")
def section_gains(t):
    return gains.base_gains(intent_rows(t)).select("plan_id", "idx", "stem", F.round("gain", 6).alias("gain"))


@query(
    _STEM_ROWS
    + """, s1 AS (SELECT * REPLACE (CASE WHEN low AND label NOT IN ('intro', 'outro') AND turn <= 3 - active THEN 0.3 ELSE gain END AS gain) FROM (SELECT *, inst AND gain <= 0.1 AS low, count(*) FILTER (inst AND gain > 0.1) OVER (PARTITION BY plan_id, idx) AS active,
      row_number() OVER (PARTITION BY plan_id, idx ORDER BY (NOT (inst AND gain <= 0.1)), gain, pos) AS turn FROM s0)),
    s2 AS (SELECT * REPLACE (CASE WHEN inst AND top = 0 AND best = 1 THEN 0.3 ELSE gain END AS gain) FROM (SELECT *, max(gain) OVER (PARTITION BY plan_id, stem) AS top, row_number() OVER (PARTITION BY plan_id, stem ORDER BY e DESC, idx) AS best FROM s1)),
    s3 AS (SELECT * REPLACE (CASE WHEN z AND place <= excess THEN 0.25 ELSE gain END AS gain) FROM (SELECT *, inst AND gain = 0 AS z, count(*) FILTER (inst AND gain = 0) OVER (PARTITION BY plan_id) - floor(count(*) FILTER (inst) OVER (PARTITION BY plan_id) * 0.15) AS excess,
      row_number() OVER (PARTITION BY plan_id ORDER BY (NOT (inst AND gain = 0)), e DESC, idx, pos) AS place FROM s2)),
    s4 AS (SELECT *, sum(gain) OVER (PARTITION BY plan_id, idx) AS total, CASE label WHEN 'intro' THEN 1.5 WHEN 'outro' THEN 1.5 WHEN 'verse' THEN 3.0 WHEN 'bridge' THEN 3.0 WHEN 'breakdown' THEN 2.0 ELSE 4.0 END AS least_total FROM s3)
    SELECT plan_id, idx, stem, round(CASE WHEN total < least_total - 1e-12 AND gain > 0 THEN least(1.0, gain * least_total / total) ELSE gain END, 6) AS gain FROM s4"""
)
def gain_constraints(t):
    return gains.gains(intent_rows(t)).select("plan_id", "idx", "stem", F.round("gain", 6).alias("gain"))


def song_pairs(t) -> DataFrame:
    return t("orders").select("o_orderkey", (60.0 + c("o_orderkey") % 100).alias("bpm_a"), (120.0 + c("o_custkey") % 240).alias("duration_a"), (70.0 + c("o_custkey") % 90).alias("bpm_b"), (100.0 + c("o_orderkey") % 260).alias("duration_b"))


_PAIRS = f"""WITH p AS (SELECT o_orderkey, (60 + o_orderkey % 100)::DOUBLE AS v, (120 + o_custkey % 240)::DOUBLE AS da, (70 + o_custkey % 90)::DOUBLE AS i, (100 + o_orderkey % 260)::DOUBLE AS db FROM orders), t AS (SELECT *, {_TARGET} AS t FROM p),
    b AS (SELECT *, greatest(32, (floor(least(floor(t * 210 / 60), floor(t * least(least(210, da * 0.75) * (v / t), least(210, db * 0.75) * (i / t)) / 60)) / 4) * 4)::INTEGER) AS total_beats FROM t)"""


@query(_PAIRS + " SELECT o_orderkey, round(t, 6) AS target_bpm, total_beats FROM b")
def beat_budgets(t):
    return planner.budgets(song_pairs(t)).select("o_orderkey", F.round("target_bpm", 6).alias("target_bpm"), "total_beats")


@query()
def candidates(t):
    """Distinct plans of every order; boundaries are folded in order, so tests compare all with plain loops."""
    plans = planner.candidates(song_pairs(t))
    edges = F.array_join(F.transform("sections", lambda x: x["end_beat"].cast("string")), " ")
    return plans.select("o_orderkey", "family", "variant", "total_beats", F.size("sections").alias("n_sections"), edges.alias("edges"), "hash")


@query(
    _PAIRS
    + """, l AS (SELECT o_orderkey, total_beats, CASE WHEN total_beats >= 192 THEN 8 WHEN total_beats >= 96 THEN 6 ELSE 5 END AS n FROM b) SELECT n AS n_sections, count(*) AS plans, CAST(sum(total_beats) AS BIGINT) AS beats FROM l GROUP BY 1"""
)
def fallback_layouts(t):
    plans = planner.fallback(planner.budgets(song_pairs(t)))
    rows = plans.select(F.size("sections").alias("n_sections"), F.element_at("sections", -1)["end_beat"].alias("end"))
    return rows.groupBy("n_sections").agg(F.count(F.lit(1)).alias("plans"), F.sum("end").alias("beats"))


@query()
def song_sections(t):
    """Section analysis of users as songs, whose bars are the days on which they have events, and whose stems are event types."""
    from strandwork.plans import sections

    names = dict(zip(("view", "click", "purchase", "error", "signup"), ("vocals", "drums", "bass", "guitar", "piano")))
    day = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 86400)
    events = t("events").select("user_id", "ts", "event_type", "value")
    tasks = scans.shares(events, EVENTS_A_TASK)
    events = events.repartition(tasks, "user_id")  # all that follows is by song
    rows = events.groupBy(c("user_id").alias("song_id"), day.alias("day"), rules.lookup(c("event_type"), names, "other").alias("stem")).agg((agg.rms(c("value")) / 100).alias("rms"))
    bar = F.dense_rank().over(Window.partitionBy("song_id").orderBy("day")) - 1
    return sections.analysed(rows.select("song_id", "stem", bar.alias("bar"), "rms"), tasks)


# --- documents, states, streams, kernels ---------------------------------------------------------------------------------------------
@query("SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def nested_round_trip(t):
    lyrics = F.struct(F.lit("a").alias("artist"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.struct(s["text"].alias("text"), s["turn"].cast("double").alias("timestamp_seconds"))).alias("lines"))
    rows = t("conversations").groupBy("conv_id").agg(docs.encoded(lyrics).alias("json")).withColumn("doc", docs.decoded(c("json"), docs.LYRICS))
    return rows.select("conv_id", F.size("doc.lines").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("doc.lines", lambda x: x["text"]), "|")).alias("digest"))


@query("SELECT o_orderkey, o_orderstatus AS status, CAST(o_orderkey % 5 AS INTEGER) AS attempt FROM orders")
def state_codec(t):
    names = {"video_id": c("o_orderkey").cast("string"), "status": c("o_orderstatus"), "attempt": (c("o_orderkey") % 5).cast("int"), "manifest": F.array(F.lit("a"), F.lit("b"))}
    fields = [f.split(":")[0] for f in docs.STATE[len("struct<") : -1].split(",")]
    made = F.struct(*[names.get(f, F.lit(None).cast("string")).alias(f) for f in fields])
    back = t("orders").select("o_orderkey", docs.state_of(docs.state_fields(made)).alias("s"))
    return back.where("s.manifest = array('a', 'b') and s.role is null").select("o_orderkey", "s.status", "s.attempt")


def _streamed(t, name: str, build: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run a stream over the events table once and return its table; a name of its own for each run."""
    import uuid

    events = t("events")
    spark, path = events.sparkSession, events.inputFiles()[0]
    folder = path.rsplit("/", 1)[0]
    if folder.endswith("/events.parquet"):  # a table of several files
        raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    else:
        raw = spark.readStream.schema(events.schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(folder)
    return stream.drained(build(stream.as_timestamp(raw)), f"{name}_{uuid.uuid4().hex}", mode, shared_folder(spark))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(t):
    out = _streamed(t, "windows", lambda e: stream.window_counts(e, "ts", "event_type", "1 day", value="value"))
    return out.select(c("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    """One event of each user and type within a time that covers the log."""
    return _streamed(t, "dedup", lambda e: stream.deduplicated(e, "ts", ["user_id", "event_type"], "400 days"), "append").select("user_id", "event_type")


@query(
    """WITH g AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(b) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events))
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s"""
)
def stream_sessions(t):
    out = _streamed(t, "sessions", lambda e: stream.session_counts(e, "ts", "user_id", "1 hour"))
    return out.select("user_id", c("session_start").cast("timestamp_ntz").alias("session_start"), c("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT user_id, max(value) AS highest FROM events GROUP BY 1")
def stream_monotone(t):
    """The last of each user's rising values is its highest."""
    return _streamed(t, "monotone", lambda e: state.monotone(e.select("user_id", "ts", "value"), "user_id", "value"), "append").groupBy("user_id").agg(F.max("value").alias("highest"))


_LIVES = {"view": 36_000.0, "click": 86_400.0, "purchase": 604_800.0}  # seconds


@query(
    """WITH e AS (SELECT user_id, event_type AS status, ts, CASE event_type WHEN 'view' THEN INTERVAL 10 HOUR WHEN 'click' THEN INTERVAL 1 DAY WHEN 'purchase' THEN INTERVAL 7 DAY END AS life,
      lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS after, max(ts) OVER () AS now FROM events)
    SELECT user_id, status, CAST(date_trunc('millisecond', ts) + life AS TIMESTAMP) AS expired_at FROM e WHERE life IS NOT NULL AND date_trunc('millisecond', coalesce(after, now)) > date_trunc('millisecond', ts) + life"""
)
def stream_expirations(t):
    """States of users that lived out their status's time, by timers of a stream."""
    out = _streamed(t, "expirations", lambda e: ttl.expirations(e, "user_id", "event_type", _LIVES), "append")
    return out.select("user_id", "status", c("expired_at").cast("timestamp_ntz").alias("expired_at"))


@query(
    """WITH u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events),
    g AS (SELECT user_id FROM events JOIN u USING (user_id), n WHERE ts = last AND date_trunc('millisecond', now) > date_trunc('millisecond', ts) + CASE event_type WHEN 'view' THEN INTERVAL 10 HOUR WHEN 'click' THEN INTERVAL 1 DAY WHEN 'purchase' THEN INTERVAL 7 DAY END)
    SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM g)"""
)
def orphan_sweep(t):
    """Customers whose state as users has expired for good."""
    events = t("events").withColumn("ts", c("ts").cast("timestamp"))
    now = events.select(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_type")).alias("l")).select("user_id", "l.*").join(F.broadcast(now))
    return ttl.swept(t("customer").select("c_custkey"), ttl.expired(last, "user_id", "event_type", _LIVES, c("now")).withColumnRenamed("user_id", "c_custkey"), "c_custkey")


@query(
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts FROM events WHERE event_type IN ('purchase', 'view')),
    w AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) AS now),
    f AS (SELECT event_id, a.user_id, a.ts AS asked, min(b.ts) AS ready FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR GROUP BY ALL)
    SELECT event_id, user_id, CASE WHEN ready IS NULL THEN 'takeover' ELSE 'waited' END AS outcome, ready FROM f, w WHERE ready IS NOT NULL OR date_trunc('millisecond', asked) + INTERVAL 6 HOUR < date_trunc('millisecond', now)"""
)
def stream_waits(t):
    """Clicks as requests that wait up to six hours for a view or purchase of their user, or take over."""

    def build(e: DataFrame) -> DataFrame:
        asked = e.where("event_type = 'click'").select("event_id", "user_id", c("ts").alias("asked"))
        ready = e.where("event_type IN ('purchase', 'view')").select("user_id", c("ts").alias("ready"))
        return stream.waits(asked, ready, "user_id", "event_id", "asked", "ready", "6 hours")

    out = stream.settled(_streamed(t, "waits", build, "append"), "event_id", "user_id", "asked", "ready")
    return out.select("event_id", "user_id", "outcome", c("ready").cast("timestamp_ntz").alias("ready"))


@query()
def lease_replay(t):
    """A lease protocol replayed over events has no SQL; tests replay it in a plain loop."""
    op = F.get(F.array(*map(F.lit, ("acquire", "renew", "ready", "fail", "release"))), (c("event_id") % 5).cast("int"))
    rows = t("events").select(c("user_id").alias("key"), op.alias("op"), (c("event_id") % 3).cast("string").alias("token"), (F.unix_seconds(c("ts").cast("timestamp")) / 60).alias("t"))
    return state.replay_leases(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def signals(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.lit(0).alias("chunk"), F.lit(8000).alias("rate"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


@query(
    """WITH x AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value FROM events),
    m AS (SELECT event_type, unnest(range(CAST(ceil(count(*) * 147 / 160) AS BIGINT))) AS m FROM x GROUP BY 1),
    d AS (SELECT event_type, m, (m * 160) // 147 AS i, ((m * 160) % 147) / 147 AS p, unnest(range(36)) AS tap FROM m),
    w AS (SELECT event_type, m, i - 17 + tap AS pos, p + 17 - tap AS d FROM d),
    s AS (SELECT *, CASE WHEN abs(d) < 1e-12 THEN 1 ELSE sin(d * 0.91875 * pi()) / (d * 0.91875 * pi()) END * power(cos(d * pi() / 36), 2) AS w FROM w)
    SELECT event_type, m AS place, round(sum(w * coalesce(value, 0)) / sum(w), 6) AS y FROM s LEFT JOIN x USING (event_type, pos) GROUP BY 1, 2"""
)
def resampled_values(t):
    """Values of each type of event as a signal at 147 samples for every 160, in chunks."""
    rows = scans.places(t("events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"])
    chunks = resampling.chunked(rows.withColumn("at", c("place") - 1), ["event_type"], "at", "value", 256)
    made = resampling.resampled(chunks, ["event_type"], 48000, 44100, 256)
    out = made.select("event_type", "first", F.posexplode("samples").alias("k", "y"))
    return out.select("event_type", (c("first") + c("k")).alias("place"), F.round("y", 6).alias("y"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def rms_kernel(t):
    return signals(t).select("vec_id", F.round(agg.array_rms(c("samples")), 6).alias("rms"))


@query("SELECT vec_id, round(max(CASE WHEN abs(x) <= k THEN x ELSE sign(x) * (k + (0.2 - k) * (1 - 2 / (exp(2 * (abs(x) - k) / (0.2 - k)) + 1))) END), 6) AS top FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, 0.2 / power(10, 0.2) AS k FROM embeddings) GROUP BY 1")
def soft_clip_kernel(t):
    rows = signals(t).select("vec_id", F.explode("samples").alias("x"))
    return rows.groupBy("vec_id").agg(F.round(F.max(kernels.soft_clip(c("x"), 0.2)), 6).alias("top"))


@query()
def compress_kernel(t):
    """Recursive smoothing has no SQL; tests compare it with a plain loop."""
    return kernels.per_signal(signals(t), ["vec_id"], lambda x, rate: kernels.compress(x, 1600)).select("vec_id", F.round(agg.array_rms(c("samples")), 6).alias("rms"))


@query()
def spectrum_kernel(t):
    """Third-octave levels of spectra; tests compare a sine's band with theory, and all signals with a plain transform."""
    return kernels.band_profiles(signals(t), "vec_id").select("vec_id", "band", F.round("db", 3).alias("db"), F.round("relative_db", 3).alias("relative_db"))


from strandwork.plans import catalogue_files, catalogue_rules  # noqa: E402,F401  (registers its queries)
