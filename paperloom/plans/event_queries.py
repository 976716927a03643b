"""Queries on the event log, conversations and study histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, score, store
from .registry import query, table

#: "Now" of the retention queries, epoch milliseconds of 2024-01-20.
NOW = 1705708800000
#: The table's times bear no zone; they are read as UTC whatever the session's zone.
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_SIZE = "octet_length(encode(event_type || '|' || coalesce(props, '')))"


def _log(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.withColumn("t", F.expr(MILLIS)).withColumn("size", F.octet_length(F.concat_ws("|", "event_type", F.coalesce("props", F.lit("")))))


@query(
    """
    SELECT event_id, user_id, event_type, value FROM events WHERE user_id IS NOT NULL AND (user_id > 5 OR (user_id = 5 AND event_id >= 100)) AND user_id < 40
    ORDER BY user_id DESC, event_id DESC LIMIT 500
    """
)
def range_scan_limit_desc(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    q = {"from": [5, 100], "to": [40], "toExclusive": True, "direction": "prev", "limit": 500}
    return store.scan(own, ["user_id", "event_id"], ["event_id"], q)


@query("SELECT event_id AS seq, event_type AS op, user_id, event_id AS nextSeq FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 1000")
def change_feed_since(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), "user_id")
    return store.changes_since(own, 700, 1000)


@query(
    f"""
    WITH own AS (SELECT *, (epoch_us(ts) // 1000) AS t, {_SIZE} + 1 AS n FROM events),
    fresh AS (SELECT * FROM own WHERE t BETWEEN {NOW} - 604800000 AND {NOW} + 60000),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id % 8 ORDER BY t DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM fresh)
    SELECT event_id, t FROM s WHERE total + 1 <= 4000
    """
)
def retention_bytes(spark, sf_dir):
    own = _log(spark, sf_dir).withColumn("log", F.col("user_id") % 8)
    return events.retain(own, NOW, F.col("size"), "log", cap=4000, tie="event_id").select("event_id", "t")


@query(
    f"""
    WITH own AS (SELECT event_id AS key, user_id, (epoch_us(ts) // 1000) AS t, {_SIZE} AS bytes FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, key DESC) AS k FROM own),
    s AS (SELECT *, sum(bytes) OVER (ORDER BY t DESC, key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM k WHERE k <= 20)
    SELECT key, 'document' AS reason FROM k WHERE k > 20 UNION ALL SELECT key, 'bytes' FROM s WHERE total > 60000
    """
)
def evict_two_limits(spark, sf_dir):
    own = _log(spark, sf_dir).select(F.col("event_id").alias("key"), "user_id", F.col("t").alias("decidedAt"), F.col("size").alias("bytes"))
    return events.evict(own, 20, 60000, "user_id")


@query(
    """
    SELECT user_id % 10 AS g, count(*) FILTER (WHERE event_type = 'view') AS swaps, count(*) FILTER (WHERE event_type = 'view' AND value > 50) AS pageSwaps,
           count(*) FILTER (WHERE event_type = 'view' AND value > 50) * 1.0 / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS rate
    FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY user_id % 10
    """
)
def event_rates_null_safe(spark, sf_dir):
    own = table(spark, sf_dir, "events").where("event_type = 'view'").select((F.col("user_id") % 10).alias("g"), F.lit("mm.page.ok").alias("type"), (F.col("value") > 50).alias("pageSwap"))
    return events.swap_rate(own, ["g"])


@query(
    """
    SELECT user_id % 10 AS g, sum(greatest(coalesce(floor(value), 0), 0))::DOUBLE AS gapsIn, sum(greatest(coalesce(floor(value / 2), 0), 0))::DOUBLE AS gapsFilled,
           sum(greatest(coalesce(floor(value / 2), 0), 0)) / nullif(sum(greatest(coalesce(floor(value), 0), 0)), 0) AS rate FROM events GROUP BY user_id % 10
    """
)
def gap_fill_rate(spark, sf_dir):
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), F.lit("mm.page.reconcile").alias("type"), F.col("value").alias("gapsIn"), (F.col("value") / 2).alias("gapsFilled"))
    out = events.gap_fill(own, ["g"])
    return out.select("g", F.col("gapsIn").cast("double").alias("gapsIn"), F.col("gapsFilled").cast("double").alias("gapsFilled"), (F.col("gapsFilled") / F.col("gapsIn")).alias("rate"))


FACETS = {"all": "true", "paid": "event_type = 'purchase'", "large": "value > 50", "active": "event_type in ('click', 'view')"}


@query(
    """
    SELECT user_id % 5 AS g, count(*) AS "all", count(*) FILTER (WHERE event_type = 'purchase') AS paid, count(*) FILTER (WHERE value > 50) AS large,
           count(*) FILTER (WHERE event_type IN ('click', 'view')) AS active FROM events GROUP BY user_id % 5
    """
)
def facet_counts(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 5)
    return store.facet_counts(own, FACETS, ["g"])


_ARMS, _CHANNELS = ["click", "view", "absent"], [("p0", "m"), ("p1", "m"), ("p9", "m")]
_AB = """
    WITH r AS (SELECT event_type AS arm, 'p' || (user_id % 2) AS provider, 'm' AS model, user_id % 3 > 0 AS sent, user_id % 4 > 0 AS measured, value > 30 AS verified, value > 60 AS matches,
                      (event_id % 500)::BIGINT AS latencyMs FROM events),
    spine AS (SELECT * FROM (VALUES ('click'), ('view'), ('absent')) a(arm), (VALUES ('p0', 'm'), ('p1', 'm'), ('p9', 'm')) c(provider, model)),
    g AS (SELECT arm, provider, model, count(*) AS n, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE measured) AS measured, count(*) FILTER (WHERE measured AND verified) AS verified,
                 count(*) FILTER (WHERE measured AND matches) AS matches, sum(latencyMs) FILTER (WHERE measured) AS latencyMs FROM r GROUP BY ALL),
    s AS (SELECT arm, provider, model, coalesce(n, 0) AS n, coalesce(sent, 0) AS sent, coalesce(measured, 0) AS measured, coalesce(verified, 0) AS verified, coalesce(matches, 0) AS matches,
                 coalesce(latencyMs, 0)::BIGINT AS latencyMs FROM spine LEFT JOIN g USING (arm, provider, model)),
    o AS (SELECT *, verified * 1.0 / nullif(measured, 0) AS verifiedRate, matches * 1.0 / nullif(measured, 0) AS matchRate, latencyMs * 1.0 / nullif(measured, 0) AS meanLatency FROM s)
"""


def _ab(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("provider"), F.lit("m").alias("model"), (F.col("user_id") % 3 > 0).alias("sent"),
        (F.col("user_id") % 4 > 0).alias("measured"), (F.col("value") > 30).alias("verified"), (F.col("value") > 60).alias("matches"), (F.col("event_id") % 500).alias("latencyMs"),
    )
    return score.ab_summary(rows, spark.createDataFrame([(a,) for a in _ARMS], "arm string"), spark.createDataFrame(_CHANNELS, "provider string, model string"))


@query(_AB + "SELECT * FROM o")
def ab_summary_zero_filled(spark, sf_dir):
    return _ab(spark, sf_dir)


@query(
    _AB
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY matchRate DESC NULLS LAST, verifiedRate DESC NULLS LAST, meanLatency ASC NULLS LAST, provider = 'p0' DESC, provider, model) AS k
    FROM o WHERE measured > 0) SELECT * EXCLUDE (k) FROM k WHERE k = 1"""
)
def ab_recommend(spark, sf_dir):
    return score.ab_best(_ab(spark, sf_dir), "p0")


@query(
    """
    WITH f AS (SELECT conv_id, turn AS page, arg_min(struct_pack(role := role, n := length(text)), turn) AS r FROM conversations GROUP BY conv_id, turn)
    SELECT conv_id, count(*) FILTER (WHERE page > 0 AND r.role = 'assistant' OR page = 0 AND r.role = 'system') AS translated, count(*) FILTER (WHERE r.role = 'user') AS incomplete FROM f GROUP BY conv_id
    """
)
def page_outcomes_distinct(spark, sf_dir):
    state = F.when(F.col("role") == "user", "partial").when(F.col("role").isin("assistant", "system"), "done")
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), (F.col("turn") + 1).alias("page"), state.alias("runState"), F.lit(False).alias("skipped"), F.lit(False).alias("any_translation"))
    out = store.page_outcomes(own, "conv_id")
    return out


@query(
    """
    WITH f AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS f FROM conversations GROUP BY conv_id),
    d AS (SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY abs(c.turn - f.f) NULLS LAST, c.turn) AS k
          FROM conversations c JOIN f USING (conv_id) WHERE f.f IS NULL OR c.turn <> f.f)
    SELECT conv_id, turn, role FROM d WHERE k <= 2
    """
)
def neighbour_window(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "role")
    focus = own.where("role = 'assistant'").groupBy("conv_id").agg(F.min("ord").alias("ord"))
    return events.neighbours(own, focus, 2, "conv_id").select("conv_id", F.col("ord").alias("turn"), "role")


@query(
    """
    SELECT conv_id, turn, coalesce(string_agg(role || ':' || length(text), ',' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
    FROM conversations
    """
)
def history_prefix(spark, sf_dir):
    own = events.history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    line = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.length(h["text"]).cast("string")))
    return own.select("conv_id", "turn", F.array_join(line, ",").alias("history"))


@query(
    """
    WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, event_id, event_type FROM l WHERE b IS NULL OR b <> event_type
    """
)
def changed_lines(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), F.col("event_type").alias("text"))
    return events.changed_lines(own, "user_id").select("user_id", F.col("t").alias("event_id"), F.col("text").alias("event_type"))


@query(
    """
    WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (event_id % 6)::DOUBLE AS q FROM events),
    s AS (
      SELECT user_id, 0::BIGINT AS k, 0 AS reps, 2.5::DOUBLE AS ease, 0.0::DOUBLE AS interval FROM (SELECT DISTINCT user_id FROM g)
      UNION ALL
      SELECT n.user_id, n.k, n.reps, n.ease, CASE WHEN n.q < 3 OR n.reps = 1 THEN 1.0 WHEN n.reps = 2 THEN 3.0 ELSE floor(n.was * n.ease + 0.5) END
      FROM (SELECT g.user_id, g.k, g.q, CASE WHEN g.q < 3 THEN 0 ELSE s.reps + 1 END AS reps, greatest(1.3, s.ease + (0.1 - (5 - g.q) * (0.08 + (5 - g.q) * 0.02))) AS ease, s.interval AS was
            FROM s JOIN g ON g.user_id = s.user_id AND g.k = s.k + 1) n
    )
    SELECT user_id, reps, floor(ease * 1000 + 0.5) / 1000 AS ease, interval FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM s) WHERE last = 1
    """
)
def srs_fold(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 6).alias("q"))
    g = own.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "q"))), lambda x: x["q"]).alias("grades"))
    s = g.select("user_id", text.review_fold(F.col("grades")).alias("s"))
    return s.select("user_id", "s.reps", score.round3(F.col("s.ease")).alias("ease"), F.col("s.interval").alias("interval"))


@query()
def commit_guards(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), "event_type", F.col("event_id").alias("seq"), F.col("event_type").alias("value"), (F.col("event_id") % 3 > 0).alias("verified"),
        (F.col("event_id") % 7).alias("epoch"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("writer"), F.col("event_id").alias("serial"), F.expr(MILLIS).alias("at"),
    ).drop("event_type")
    return events.fold_commits(own)


@query(
    """
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE props IS NOT NULL) AS with_props, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type
    """
)
def event_props(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
