"""The dataflow operators over the test tables, each with the same result in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import errors, paths, scalars
from millrace.operators import broadcast, changelog, keyed, results, stats, topics
from millrace.plans import autoscale, etl
from millrace.plans.pipeline import FAILS, Pipeline, Stage, mux
from millrace.sources import readers, sinks
from millrace.streaming import processors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with pos, their submit position."""
    return table(spark, d, "events").withColumn("pos", F.col("event_id"))


def flat(df: DataFrame) -> DataFrame:
    """err as two columns, which SQL twins have too."""
    return df.withColumns({"err_kind": F.col("err.kind"), "err_permanent": F.col("err.permanent")}).drop("err")


@query(
    "q01_top_groups",
    """SELECT o_custkey, count(o_custkey) AS num_orders FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'
       GROUP BY o_custkey ORDER BY num_orders DESC, o_custkey LIMIT 20""",
)
def top_groups(spark, d):
    live = table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return etl.top_groups(live, "o_custkey").withColumnRenamed("n", "num_orders")


@query("q02_block_counts", "SELECT event_id // 1000 AS block_id, count(*) AS n, min(event_id) AS first_pos FROM events GROUP BY 1")
def block_counts(spark, d):
    return readers.blocks(events(spark, d), 1000).groupBy("block_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


MAPPED = "SELECT event_id AS pos, value, CASE WHEN value >= 50 THEN sqrt(value - 50) END AS v, CASE WHEN value < 50 THEN 'user' END AS err_kind, CASE WHEN value < 50 THEN false END AS err_permanent FROM events"


def mapped(spark, d):
    x = F.col("value") - 50
    return results.item(events(spark, d).select("pos", "value"), F.sqrt(F.greatest(x, F.lit(0.0))), errors.when(x < 0, "user", "the root of a negative number"))


@query("q03_value_or_error", MAPPED)
def value_or_error(spark, d):
    return flat(mapped(spark, d))


@query("q04_stop_on_error", f"WITH m AS ({MAPPED}) SELECT * FROM m WHERE pos <= coalesce((SELECT min(pos) FROM m WHERE err_kind IS NOT NULL), pos)")
def stop_on_error(spark, d):
    return flat(results.stop_on_error(mapped(spark, d)))


@query(
    "q05_contiguous_prefix",
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events),
       k AS (SELECT * FROM s WHERE event_id % 97 <> 13), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS n FROM k)
       SELECT user_id, seq, event_id FROM n WHERE n = seq""",
)
def contiguous_prefix(spark, d):
    s = keyed.sequence(events(spark, d), "user_id").select("user_id", "seq", "event_id")
    return results.contiguous(s.filter("event_id % 97 <> 13"), "seq", "user_id")


@query(
    "q06_sequencer_turn",
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events),
       k AS (SELECT * FROM s WHERE event_id % 97 <> 13), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS n FROM k)
       SELECT user_id, (count(*) FILTER (n = seq))::BIGINT AS turn FROM n GROUP BY user_id""",
)
def sequencer_turn(spark, d):
    s = keyed.sequence(events(spark, d), "user_id").select("user_id", "seq", "event_id")
    return results.turns(s.filter("event_id % 97 <> 13"), "seq", "user_id")


PATTERNS = ("click/*", "click/u1", "*/u2/*", "view/**", "**", "error/u3/p/*", "*/*/p/x", "/purchase/**", "signup/u4", "a//b", "x/**/y", "view*/u1")
PATTERN_ROWS = ", ".join(f"('{p}')" for p in PATTERNS)
TOPICS_SQL = "(SELECT event_id AS seq, event_type || '/u' || (user_id % 10) || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '/p' ELSE '/p/x' END AS topic FROM events)"
#: A pattern as a regular expression, for the twins.
AS_REGEX = "'^' || regexp_replace(replace(CASE WHEN p = '**' THEN '.*' WHEN p LIKE '%/**' THEN p[:-4] || '(/.*)?' ELSE p END, '/*', '/[^/]+'), '^\\*', '[^/]+') || '$'"
VALID_SQL = f"""(SELECT DISTINCT regexp_replace(p, '^/', '') AS p FROM (VALUES {PATTERN_ROWS}) t(p)
    WHERE p <> '' AND p NOT LIKE '%/' AND NOT contains(regexp_replace(p, '^/', ''), '//') AND regexp_replace(p, '^/', '') NOT LIKE '/%'
      AND len(list_filter(string_split(p, '/'), lambda s: contains(s, '*') AND s NOT IN ('*', '**'))) = 0
      AND NOT list_contains(string_split(p, '/')[:-2], '**'))"""


def sends(spark, d):
    tail = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "/p").otherwise("/p/x")
    topic = F.concat("event_type", F.lit("/u"), (F.col("user_id") % 10).cast("string"), tail)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), topic.alias("topic"))


def patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


@query("q07_topic_match", f"SELECT pattern, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, p AS pattern FROM {TOPICS_SQL} t, {VALID_SQL} v WHERE regexp_matches(topic, {AS_REGEX})) GROUP BY pattern")
def topic_match(spark, d):
    return topics.match(sends(spark, d), patterns(spark)).groupBy("pattern").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


PATHS = ("", "/", "a", "/a", "a/", "a//b", "a/b", "*", "a/*", "a/*/b", "**", "a/**", "a/**/b", "a/b*", "***", "//a", "/a/b/c")
PATH_ROWS = ", ".join(f"('{p}')" for p in PATHS)


@query(
    "q08_path_validity",
    f"""WITH p AS (SELECT path, regexp_replace(path, '^/', '') AS c FROM (VALUES {PATH_ROWS}) t(path)),
        s AS (SELECT path, c, string_split(c, '/') AS segs, path = '' OR path LIKE '%/' OR list_contains(string_split(c, '/'), '') AS bad FROM p)
        SELECT path, CASE WHEN NOT bad THEN c END AS canonical, bad OR contains(path, '*') AS topic_invalid,
               bad OR len(list_filter(segs, lambda x: contains(x, '*') AND x NOT IN ('*', '**'))) > 0 OR list_contains(segs[:-2], '**') AS pattern_invalid FROM s""",
)
def path_validity(spark, d):
    p = F.col("path")
    df = spark.createDataFrame([(x,) for x in PATHS], "path string")
    return df.select("path", F.when(paths.path_error(p).isNull(), paths.canonical(p)).alias("canonical"), paths.topic_error(p).isNotNull().alias("topic_invalid"), paths.pattern_error(p).isNotNull().alias("pattern_invalid"))


@query(
    "q09_topic_metrics",
    f"""WITH m AS (SELECT seq, count(*) AS m FROM {TOPICS_SQL} t, {VALID_SQL.replace("('**'), ", "")} v WHERE regexp_matches(topic, {AS_REGEX}) GROUP BY seq)
        SELECT (SELECT count(*) FROM events) AS sends, (SELECT sum(m)::BIGINT FROM m) AS matches, (SELECT count(*) FROM events) - (SELECT count(*) FROM m) AS unmatched, (SELECT count(*) FROM {VALID_SQL.replace("('**'), ", "")}) AS topics""",
)
def topic_metrics(spark, d):
    return topics.metrics(sends(spark, d), patterns(spark).filter("pattern <> '**'"))


SUBS = ((1, "click/*", 0, None), (2, "click/*", 500, 900), (3, "view/**", 100, 4000), (4, "**", 990, 1010), (5, "/purchase/**", 0, None))
SUB_ROWS = ", ".join(f"({a}, '{b}', {c}, {'NULL' if e is None else e})" for a, b, c, e in SUBS)


@query(
    "q10_topic_delivery",
    f"""WITH s AS (SELECT a AS sub_id, regexp_replace(b, '^/', '') AS p, c AS lo, e AS hi FROM (VALUES {SUB_ROWS}) t(a, b, c, e))
        SELECT sub_id::BIGINT AS sub_id, count(*) AS delivered, min(seq) AS first_seq, max(seq) AS last_seq FROM s, {TOPICS_SQL} t
        WHERE regexp_matches(topic, {AS_REGEX}) AND seq >= lo AND seq < coalesce(hi, 1152921504606846976) GROUP BY sub_id""",
)
def topic_delivery(spark, d):
    subs = spark.createDataFrame(SUBS, "sub_id long, pattern string, start_idx long, end_idx long")
    got = topics.deliver(topics.match(sends(spark, d), subs.select("pattern")), subs)
    return got.groupBy("sub_id").agg(F.count("*").alias("delivered"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "q11_live_patterns",
    """WITH c AS (SELECT event_id AS seq, event_type || '/u' || (user_id % 10) AS pattern, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS step FROM events),
       p AS (SELECT pattern, step, sum(step) OVER (PARTITION BY pattern ORDER BY seq) AS so_far FROM c)
       SELECT pattern, (sum(step) - least(0, min(so_far)))::BIGINT AS n FROM p GROUP BY pattern HAVING sum(step) - least(0, min(so_far)) > 0""",
)
def live_patterns(spark, d):
    e = events(spark, d)
    changes = e.select(F.col("pos").alias("seq"), F.when(F.col("pos") % 2 == 0, "Add").otherwise("Delete").alias("op"), F.concat("event_type", F.lit("/u"), (F.col("user_id") % 10).cast("string")).alias("pattern"))
    return topics.live_patterns(changes)


@query("q12_keyed_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def keyed_sequence(spark, d):
    return keyed.sequence(events(spark, d), "user_id").select("user_id", "event_id", "seq")


@query("q13_item_numbers", "SELECT event_type AS group_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS item_num FROM events")
def item_numbers(spark, d):
    return keyed.sequence(events(spark, d), "event_type", name="item_num", hot=True).select(F.col("event_type").alias("group_id"), "event_id", "item_num")


@query("q14_global_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def global_index(spark, d):
    return readers.indexed(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", chunks=16).select("o_orderkey", "pos")


POISON_SQL = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
    f AS (SELECT user_id, min(seq) AS first FROM s WHERE event_type = 'error' GROUP BY user_id)
    SELECT s.user_id, s.event_id, CASE WHEN seq > first THEN 'key_failed' WHEN event_type = 'error' THEN 'user' END AS err_kind FROM s LEFT JOIN f USING (user_id)"""


def poisoned(spark, d):
    s = keyed.sequence(events(spark, d), "user_id").withColumn("own_err", F.when(F.col("event_type") == "error", F.lit("an error event")))
    return keyed.poison(s, "user_id")


@query("q15_poison_status", f"SELECT coalesce(err_kind, 'ok') AS status, count(*) AS n FROM ({POISON_SQL}) GROUP BY 1")
def poison_status(spark, d):
    return poisoned(spark, d).groupBy(F.coalesce("err.kind", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))


@query("q16_poison_rows", POISON_SQL)
def poison_rows(spark, d):
    return poisoned(spark, d).select("user_id", "event_id", F.col("err.kind").alias("err_kind"))


@query("q17_keyed_running", "SELECT user_id, event_id, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS state FROM events")
def keyed_running(spark, d):
    return keyed.running(events(spark, d), "user_id", F.col("event_id") % 7).select("user_id", "event_id", "state")


SESSION_SQL = """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, false)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g"""


@query("q18_idle_sessions", SESSION_SQL)
def idle_sessions(spark, d):
    return keyed.sessions(events(spark, d), "user_id", "ts", "6 HOURS").select("user_id", "event_id", "session")


@query("q19_session_state", f"SELECT user_id, event_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) - 1 AS seq_in_session FROM ({SESSION_SQL})")
def session_state(spark, d):
    s = keyed.sessions(events(spark, d), "user_id", "ts", "6 HOURS").select("user_id", "event_id", "session")
    return s.withColumn("seq_in_session", (F.row_number().over(Window.partitionBy("user_id", "session").orderBy("event_id")) - 1).cast("long"))


@query(
    "q20_cohorts",
    """WITH f AS (SELECT *, ts + to_minutes((value * 3)::BIGINT) AS gone FROM events),
       g AS (SELECT *, coalesce(ts >= max(gone) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INT AS fresh FROM f)
       SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cohort FROM g""",
)
def cohorts(spark, d):
    e = events(spark, d).withColumn("gone", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.rint(F.col("value") * 3).cast("int"), F.lit(0)))
    return keyed.cohorts(e, "user_id", "ts", "gone").select("user_id", "event_id", "cohort")


@query("q21_lanes", "SELECT count(DISTINCT user_id) AS keys, 1::BIGINT AS most_lanes_of_a_key FROM events")
def one_lane(spark, d):
    per = keyed.lanes(events(spark, d), "user_id", 8).groupBy("user_id").agg(F.count_distinct("lane").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.max("n").alias("most_lanes_of_a_key"))


CHANGES_SQL = "(SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Add' END AS op, user_id AS k, event_id % 1000 AS v FROM events)"


def changes(spark, d):
    op = F.when(F.col("event_type") == "error", "Delete").otherwise("Add")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("k"), (F.col("event_id") % 1000).alias("v"), F.lit(None).cast("string").alias("err"))


@query("q22_last_op_wins", f"SELECT k, arg_max(v, seq) AS v FROM {CHANGES_SQL} GROUP BY k HAVING arg_max(op, seq) = 'Add'")
def last_op_wins(spark, d):
    return changelog.materialise(changes(spark, d))


ACCEPT_SQL = f"WITH c AS {CHANGES_SQL}, g AS (SELECT k, max(seq) FILTER (op = 'Delete') AS gone FROM c GROUP BY k) SELECT c.k, max(v) AS v FROM c JOIN g USING (k) WHERE op = 'Add' AND (gone IS NULL OR seq > gone) GROUP BY c.k"


@query("q23_accept_greater", ACCEPT_SQL)
def accept_greater(spark, d):
    return changelog.accept_greater(changes(spark, d))


def only_greater(k, v, prev, replaced):
    return not replaced or v > prev


@query("q24_accept_hook", ACCEPT_SQL)
def accept_hook(spark, d):
    return changelog.accept(changes(spark, d), on_set=only_greater).select("k", "v")


@query(
    "q25_feed_cut",
    f"WITH c AS {CHANGES_SQL}, cut AS (SELECT min(seq) AS ends FROM c WHERE seq % 1777 = 1500) SELECT k, arg_max(v, seq) AS v FROM c, cut WHERE ends IS NULL OR seq < ends GROUP BY k HAVING arg_max(op, seq) = 'Add'",
)
def feed_cut(spark, d):
    ops = changes(spark, d).withColumn("err", F.when(F.col("seq") % 1777 == 1500, "broken"))
    return changelog.materialise(changelog.cut_at_error(ops))


@query(
    "q26_upsert",
    f"""WITH t AS (SELECT DISTINCT user_id AS k, 0::BIGINT AS v FROM events WHERE user_id % 2 = 0), c AS {CHANGES_SQL},
        l AS (SELECT k, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM c WHERE seq % 5 = 0 GROUP BY k)
        SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE op = 'Add' ORDER BY k""",
)
def upsert(spark, d):
    kv = table(spark, d, "events").filter("user_id % 2 = 0").select(F.col("user_id").alias("k"), F.lit(0).cast("long").alias("v")).distinct()
    last = changes(spark, d).filter("seq % 5 = 0").groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("s")).select("k", "s.op", "s.v")
    return sinks.upsert(kv, last, "k").orderBy("k")


LOG_SUBS = ((1, 0, None, None), (2, 100, 5000, 40), (3, 9000, 20000, None), (4, 10**9, None, None), (5, 7, 7, None))
LOG_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in LOG_SUBS)


def log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), "event_type")


def log_subs(spark):
    return spark.createDataFrame(LOG_SUBS, "sub_id long, start_idx long, end_idx long, consume long")


@query(
    "q27_deliveries",
    f"SELECT a::BIGINT AS sub_id, count(*) AS n, min(event_id) AS first_idx, max(event_id) AS last_idx FROM (VALUES {LOG_ROWS}) s(a, b, c, e) JOIN events ON event_id >= b AND event_id < coalesce(c, 1152921504606846976) GROUP BY a",
)
def deliveries(spark, d):
    got = broadcast.deliveries(log(spark, d), log_subs(spark).drop("consume"))
    return got.groupBy("sub_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


LAG_SQL = f"""WITH t AS (SELECT max(event_id) + 1 AS tail FROM events), r AS (SELECT a, e, greatest(0, least(coalesce(c, tail), tail) - b) AS room FROM (VALUES {LOG_ROWS}) s(a, b, c, e), t)
    SELECT a::BIGINT AS sub_id, least(coalesce(e, room), room)::BIGINT AS delivered, (room - least(coalesce(e, room), room))::BIGINT AS pending FROM r"""


@query("q28_pending", LAG_SQL)
def pending(spark, d):
    return broadcast.lag(log_subs(spark), log(spark, d))


@query("q29_broadcast_metrics", f"SELECT (SELECT count(*) FROM events) AS sends, count(*) AS subscribers, sum(delivered)::BIGINT AS delivered, sum(pending)::BIGINT AS pending FROM ({LAG_SQL})")
def broadcast_metrics(spark, d):
    return broadcast.metrics(log(spark, d), log_subs(spark))


@query("q30_mux_demux", "SELECT 0::BIGINT AS group_id, count(*) AS n, min(event_id) AS first_pos FROM events WHERE event_type = 'click' UNION ALL SELECT 1, count(*), min(event_id) FROM events WHERE event_type = 'view'")
def mux_demux(spark, d):
    e = events(spark, d)
    both = mux({0: e.filter("event_type = 'click'"), 1: e.filter("event_type = 'view'")})
    return both.groupBy("group_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def routed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus", F.col("o_totalprice").alias("price")).withColumn("work", F.lit(0).cast("long"))
    by = F.when(F.col("o_orderstatus") == "F", "fill").when(F.col("o_orderstatus") == "O", "hold")
    stages = [Stage("start", next=by), Stage("fill", {"work": F.col("work") + 10}, next="end"), Stage("hold", {"work": F.col("work") + 1}, next="end"), Stage("end", {"work": F.col("work") * 2}, fails=F.when(F.col("price") > 400000, F.lit("too dear")))]
    return Pipeline(stages, "start").run(o)


ROUTED_SQL = """SELECT o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'start -> fill -> end' WHEN 'O' THEN 'start -> hold -> end' ELSE 'start' END AS route,
    CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'O' THEN 2 ELSE 0 END::BIGINT AS work, CASE WHEN o_orderstatus IN ('F', 'O') AND o_totalprice > 400000 THEN 'user' END AS err_kind FROM orders"""


@query("q31_routed_orders", ROUTED_SQL)
def routed_orders(spark, d):
    return routed(spark, d).select("pos", F.array_join("visited", " -> ").alias("route"), "work", F.col("err.kind").alias("err_kind"))


@query("q32_cycle_rejected", "SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'cyclic' END AS err_kind, CASE WHEN event_id % 2 = 0 THEN 'a -> b' END AS err_msg, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 2 END AS hops FROM events")
def cycle_rejected(spark, d):
    stages = [Stage("a", next="b"), Stage("b", next=F.when(F.col("pos") % 2 == 0, "a"))]
    return Pipeline(stages, "a", dag=True).run(events(spark, d).select("pos")).select("pos", F.col("err.kind").alias("err_kind"), F.col("err.msg").alias("err_msg"), "hops")


@query("q33_bounded_loop", "SELECT event_id AS pos, (event_id % 4)::BIGINT AS n, (event_id % 4 + 1)::INT AS hops FROM events")
def bounded_loop(spark, d):
    e = events(spark, d).select("pos").withColumn("n", F.lit(-1).cast("long"))
    again = Stage("again", {"n": F.col("n") + 1}, next=F.when(F.col("n") + 1 < F.col("pos") % 4, "again"))
    return Pipeline([again], "again", max_hops=5).run(e).select("pos", "n", "hops")


@query("q34_preprocessor", "SELECT event_id AS pos, (event_id % 10 + 2) * 3 AS v FROM events")
def preprocessor(spark, d):
    e = events(spark, d).select("pos", (F.col("pos") % 10).alias("v"))
    stages = [Stage("first", next="second"), Stage("second", {"v": F.col("v") * 3})]
    return Pipeline(stages, "first", preprocessors=[lambda df: {"v": F.col("v") + 1}]).run(e).select("pos", "v")


@query("q35_branch_order", "SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'work' ELSE 'skip' END AS branch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def branch_order(spark, d):
    e = keyed.sequence(events(spark, d), "user_id").select("user_id", "event_id", "seq").withColumn("branch", F.lit(""))
    stages = [Stage("start", next=F.when(F.col("event_id") % 2 == 0, "work").otherwise("skip")), Stage("work", {"branch": F.lit("work")}), Stage("skip", {"branch": F.lit("skip")})]
    return Pipeline(stages, "start").run(e, "user_id", "seq").select("user_id", "event_id", "branch", "seq")


@query(
    "q36_run_times",
    """SELECT event_type, (count(*) FILTER (value >= 50))::BIGINT AS completed, count(*) AS ingested, coalesce(min(r) FILTER (value >= 50), 0) AS run_min, coalesce((sum(r) FILTER (value >= 50))::BIGINT // count(*) FILTER (value >= 50), 0) AS run_avg,
       coalesce(max(r) FILTER (value >= 50), 0) AS run_max, min(w) AS wait_min, coalesce(sum(w)::BIGINT // count(*) FILTER (value >= 50), 0) AS wait_avg, max(w) AS wait_max
       FROM (SELECT *, floor(value * 1000)::BIGINT AS r, event_id % 100 AS w FROM events) GROUP BY event_type""",
)
def run_times(spark, d):
    e = events(spark, d).withColumns({"run_ns": F.floor(F.col("value") * 1000), "wait_ns": F.col("event_id") % 100})
    return stats.times(e, "event_type", wait="wait_ns", done=F.col("value") >= 50)


@query(
    "q37_in_flight",
    """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, 1 AS n FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 90 MINUTE), -1 FROM events),
       g AS (SELECT b, sum(n) AS n FROM s GROUP BY b) SELECT b AS begin, sum(n) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM g""",
)
def in_flight(spark, d):
    e = events(spark, d).withColumn("gone", F.col("ts") + F.expr("INTERVAL 90 MINUTES"))
    return stats.in_flight(e, "ts", "gone", "1 hour")


@query("q38_autoscale_trace")
def autoscale_trace(spark, d):
    """Each user's events are ticks of one pool; SQL has no twin, the decision table is in the tests."""
    e = keyed.sequence(events(spark, d), "user_id", name="tick")
    w = Window.partitionBy("user_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    s = e.select("user_id", "tick", (F.col("tick") / 2.0).alias("t"), F.sum(F.floor("value")).over(w).alias("completed"), (F.col("event_id") % 13).alias("running"), (F.col("event_id") % 4 * 3 + 3).alias("workers"))
    return autoscale.trace(s, "user_id", 3, 3, 24)


@query("q39_admission")
def admission(spark, d):
    """At most 4 of a user in flight; a fold that SQL has no twin for, held against brute force in the tests."""
    e = events(spark, d).select("user_id", "pos", F.col("event_id").alias("at"), (F.col("event_id") % 500 + 1).alias("work"))
    return keyed.admission(e, "user_id", "at", "work", 4)


VIOLATION_ROWS = (
    ("Cafe, The", "Active", "Fail", "dust", "2017-03-01 10:00:00", "open", "*", "a", "1 St", "B", "02101"),
    ("Cafe, The", "Active", "Fail", "mice", "2018-03-01 10:00:00", "open", "***", "b", "1 St", "B", "02101"),
    ("Bar", "Active", "Pass", "", "", "shut", "**", "", "2 St", "B", "02102"),
    ("Inn", "Inactive", "Fail", "soap", "2019-01-01 00:00:00", "open", "", "c", "3 St", "B", "02103"),
    ("Pub", "Active", "Fail", "cold", " ", "open", "*", "d", "4 St", "B", "02104"),
    ("Pub", "Active", "Fail", "heat", "2019-13-01 00:00:00", "open", "x", "e", "4 St", "B", "02104"),
    ("Deli", "Active", "Fail", "heat", "2016-01-01 00:00:00", "open", "**", "f", "5 St", "B", "02105"),
)
VIOLATION_SQL = "(SELECT col0 AS business_name, col1 AS license_status, col2 AS result, col3 AS description, CASE WHEN col4 = '' THEN TIMESTAMP '0001-01-01 00:00:00' ELSE try_strptime(col4, '%Y-%m-%d %H:%M:%S') END AS time, col5 AS status, CASE col6 WHEN '*' THEN 1 WHEN '**' THEN 2 WHEN '***' THEN 3 ELSE -1 END AS level, col7 AS comments, col8 AS address, col9 AS city, col10 AS zip FROM (VALUES " + ", ".join(str(r) for r in VIOLATION_ROWS) + "))"


def violations(spark) -> DataFrame:
    names = list(readers.VIOLATIONS)
    return spark.createDataFrame(VIOLATION_ROWS, ", ".join(f"{n} string" for n in names))


@query("q40_etl_typed", f"SELECT business_name, license_status, result, description, time::VARCHAR AS time, status, level, comments, address, city, zip, CASE WHEN time IS NULL THEN 'user' END AS err_kind, CASE WHEN time IS NULL THEN false END AS err_permanent FROM {VIOLATION_SQL}")
def etl_typed(spark, d):
    return flat(etl.typed(violations(spark)).withColumn("time", F.col("time").cast("string")))


@query("q41_etl_counts", f"SELECT count(*) + 1 AS records, count(*) FILTER (time IS NULL) AS errors, count(*) FILTER (time IS NULL) / (count(*) + 1) <= 0.1 AS commits FROM {VIOLATION_SQL}")
def etl_counts(spark, d):
    return etl.counts(etl.typed(violations(spark)))


@query("q42_etl_report", f"SELECT business_name, count(business_name) AS num_violations FROM {VIOLATION_SQL} WHERE license_status = 'Active' AND time >= TIMESTAMP '2016-01-01' GROUP BY business_name ORDER BY num_violations DESC, business_name LIMIT 20")
def etl_report(spark, d):
    rows = etl.typed(violations(spark))
    return etl.report(rows.filter("err IS NULL"))


@query("q43_block_failure", "WITH b AS (SELECT l_orderkey // 100 AS block_id, max((l_quantity >= 50 AND l_discount >= 0.1)::INT) AS bad, count(*) AS n FROM lineitem GROUP BY 1) SELECT block_id, n, bad = 1 AS failed FROM b")
def block_failure(spark, d):
    rows = readers.blocks(table(spark, d, "lineitem"), 100, "l_orderkey")
    rows = rows.withColumn("err", errors.when((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1), "user", "too much"))
    out = etl.by_block(rows).groupBy("block_id").agg(F.count("*").alias("n"), F.count("err").alias("bad"))
    return out.select("block_id", "n", (F.col("bad") > 0).alias("failed"))


@query("q44_singleflight", "SELECT event_id, user_id, user_id * user_id AS squared FROM events")
def singleflight(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return keyed.singleflight(e, "user_id", lambda keys: keys.withColumn("squared", F.col("user_id") * F.col("user_id")))


@query("q45_first_n", f"WITH m AS ({MAPPED}) SELECT * FROM m ORDER BY pos LIMIT 25")
def first_n(spark, d):
    return flat(results.first_n(mapped(spark, d), 25))


@query("q46_sweep", f"WITH m AS ({MAPPED}) SELECT pos, CASE WHEN pos % 3 > 0 THEN v END AS v, CASE WHEN pos % 3 = 0 THEN 'cancelled' ELSE err_kind END AS err_kind, CASE WHEN pos % 3 = 0 THEN false ELSE err_permanent END AS err_permanent FROM m")
def sweep(spark, d):
    m = mapped(spark, d)
    return flat(results.sweep(m.select("pos"), m.filter("pos % 3 > 0")))


@query("q47_opaque_map", "SELECT event_id AS pos, CASE WHEN event_id % 10 <> 3 THEN event_id * 2 END AS v, CASE WHEN event_id % 10 = 3 THEN 'user' END AS err_kind, CASE WHEN event_id % 10 = 3 THEN false END AS err_permanent, CASE WHEN event_id % 10 = 3 THEN 2 ELSE 1 END AS calls FROM events")
def opaque_map(spark, d):
    def double(x):
        if x % 10 == 3:
            raise ValueError("no threes")
        return x * 2

    return flat(results.item_func(events(spark, d).select("pos", F.col("pos").alias("v")), double, "bigint", attempts=2))


@query(
    "q48_scalars",
    """SELECT event_id, CASE (event_id % 4)::INT WHEN 0 THEN 'UnknownOp' WHEN 1 THEN 'Add' WHEN 2 THEN 'Delete' ELSE 'Op(3)' END AS op_name,
       least(greatest(event_id % 50, 3), 24) AS clamped, least(greatest(event_id % 20 + 3, 3), 24) - event_id % 20 AS moved,
       (event_id >> (event_id % 8)::INT) & 1 = 1 AS bit_on, event_id | (1::BIGINT << (event_id % 8)::INT) AS bit_set, upper(reverse(event_type)) AS reversed, length(event_type)::INT AS len, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS ten_k FROM events""",
)
def scalar_functions(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    n = (i % 8).cast("int")
    return e.select(
        "event_id",
        scalars.op_name((i % 4).cast("int")).alias("op_name"),
        scalars.clamp(i % 50, F.lit(3), F.lit(24)).alias("clamped"),
        scalars.clamp_delta(F.lit(3), i % 20, F.lit(3), F.lit(24)).alias("moved"),
        scalars.bit(i, n).alias("bit_on"),
        scalars.set_bit(i, n).alias("bit_set"),
        F.upper(scalars.reverse_bytes(F.col("event_type").cast("binary")).cast("string")).alias("reversed"),
        F.length("event_type").alias("len"),
        (F.get_json_object("props", "$.k").try_cast("bigint") * 10).alias("ten_k"),
    )


@query("q49_slots", "SELECT p_partkey AS id, p_size::BIGINT + p_partkey + (p_size::BIGINT - 25) AS sum3, p_size::BIGINT + p_partkey + trunc((p_size - 25) / 3)::BIGINT AS sum4 FROM part")
def slots(spark, d):
    """Five slots: the fourth is the sum of the first three, the fifth adds a third of the third only."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.col("p_partkey"), F.col("p_size").cast("long") - 25, F.lit(0).cast("long"), F.lit(0).cast("long")).alias("data"))
    a, b, c = (F.get("data", F.lit(k)) for k in range(3))
    p = p.withColumns({"sum3": F.lit(0).cast("long"), "sum4": F.lit(0).cast("long")})
    bad = F.when(F.size("data") != 5, F.lit("there must be five slots"))
    stages = [Stage("sum", {"sum3": a + b + c}, next="avg", fails=bad), Stage("avg", {"sum4": a + b + scalars.quotient(c, 3)}, fails=bad)]
    return Pipeline(stages, "sum").run(p).select("id", "sum3", "sum4")


@query("q50_enrich", "SELECT c_custkey, (TIMESTAMP '0001-01-01' + to_days(c_custkey::INT))::VARCHAR AS birth, 'Nashville' AS birth_town, 'Tennessee' AS birth_state, CASE WHEN c_custkey % 500 = 0 THEN 'first is empty' END AS problem FROM customer")
def enrich(spark, d):
    """Names are trimmed and checked, the first empty one is the error; then an identity service fills in the rest."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 500 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("first"), F.col("c_name").alias("last"), F.col("c_custkey").cast("string").alias("id"))
    trimmed = {k: scalars.trim_space(F.col(k)) for k in ("first", "last", "id")}
    problem = F.coalesce(*(F.when(v == "", F.lit(f"{k} is empty")) for k, v in trimmed.items()))
    c = c.withColumn("problem", problem)
    birth = F.lit(scalars.ZERO_TIME).cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))
    return c.select("c_custkey", birth.cast("string").alias("birth"), F.lit("Nashville").alias("birth_town"), F.lit("Tennessee").alias("birth_state"), "problem")


@query("q51_array_and_map_sources", "SELECT pos, k, v FROM (SELECT unnest(range(3)) AS pos, unnest(['a', 'b', 'c']) AS k, unnest([10, 20, 30]) AS v)")
def array_and_map_sources(spark, d):
    one = spark.range(1).select(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("xs"), F.create_map(F.lit("a"), F.lit(10), F.lit("b"), F.lit(20), F.lit("c"), F.lit(30)).alias("m"))
    a = readers.from_array(one, "xs").select(F.col("pos").cast("long").alias("pos"), F.col("v").alias("k"))
    return a.join(readers.from_map(one, "m"), "k").select("pos", "k", "v")


@query("q52_torn_down", "SELECT event_id AS pos, CASE WHEN event_id >= 4321 THEN 'torn_down' END AS err_kind, CASE WHEN event_id >= 4321 THEN true END AS err_permanent FROM events")
def torn_down(spark, d):
    return flat(keyed.torn_down(events(spark, d).select("pos"), F.col("pos") == 4321))


def folder(spark) -> str:
    """A place for a stream's output: the cluster's shared folder, or in local mode a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not readers.is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@query("q53_stream_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def stream_sequence(spark, d):
    stream = processors.read_table(spark, d, "events")
    return processors.drain(processors.sequence(stream, "user_id", "event_id"), folder(spark))


@query("q54_stream_feed", f"SELECT k, arg_max(v, seq) AS v FROM {CHANGES_SQL} GROUP BY k HAVING arg_max(op, seq) = 'Add'")
def stream_feed(spark, d):
    op = F.when(F.col("event_type") == "error", "Delete").otherwise("Add")
    stream = processors.read_table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("k"), (F.col("event_id") % 1000).alias("v"))

    def fold(before, batch):
        new = batch.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("s")).select("k", "s.op", "s.v")
        return new.filter("op = 'Add'").select("k", "v") if before is None else sinks.upsert(before, new, "k")

    return spark.read.parquet(processors.feed(stream, folder(spark), fold))


@query("q55_stream_windows", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS begin, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    stream = processors.windowed_counts(processors.read_table(spark, d, "events"), "ts", "event_type", "1 day", "1 day")
    out = f"w{uuid.uuid4().hex}"
    place = folder(spark)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/{out}-{number}")
        made.append(f"{place}/{out}-{number}")

    made: list[str] = []
    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(made[-1]) if made else spark.createDataFrame([], stream.schema)


@query("q56_stream_sessions", f"SELECT user_id, event_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) - 1 AS seq FROM ({SESSION_SQL})")
def stream_sessions(spark, d):
    stream = processors.read_table(spark, d, "events")
    return processors.drain(processors.sessions(stream, "user_id", "ts", "event_id", 6 * 3600.0), folder(spark))


@query(
    "q57_send_errors",
    "SELECT seq, CASE WHEN seq >= 5000 THEN 'closed' WHEN topic LIKE '%*%' OR topic LIKE '%/' THEN 'invalid_path' END AS err_kind, CASE WHEN seq >= 5000 OR topic LIKE '%*%' OR topic LIKE '%/' THEN true END AS err_permanent FROM (SELECT event_id AS seq, event_type || CASE event_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/*' ELSE '/x' END AS topic FROM events)",
)
def send_errors(spark, d):
    end = F.when(F.col("event_id") % 5 == 0, "/").when(F.col("event_id") % 5 == 1, "/*").otherwise("/x")
    s = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat("event_type", end).alias("topic"))
    return flat(topics.send_errors(s, 5000)).select("seq", "err_kind", "err_permanent")


@query(
    "q58_csv_load",
    """SELECT 'n' || event_id AS business_name, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, event_id % 50 = 7 AS bad FROM events WHERE event_id % 50 <> 7""",
)
def csv_load(spark, d):
    """Strings written as CSV, read back, typed, held to the error budget and published; what is published."""
    n, where = F.col("event_id"), folder(spark)
    rows = {c: F.concat(F.lit("n"), n.cast("string")) for c in readers.VIOLATIONS} | {"viollevel": F.element_at(F.array(F.lit("*"), F.lit("**"), F.lit("***")), (n % 3 + 1).cast("int"))}
    rows["violdttm"] = F.when(n % 50 == 7, "no time").otherwise("2017-01-01 10:00:00")
    table(spark, d, "events").select(*(v.alias(k) for k, v in rows.items())).write.option("header", True).csv(f"{where}/csv")
    typed = etl.typed(readers.violations_csv(spark, f"{where}/csv"))
    if not sinks.error_budget(typed, f"{where}/table"):
        raise ValueError("the budget does not hold")
    return sinks.loaded(spark, f"{where}/table").select("business_name", F.col("level").cast("int").alias("level"), F.lit(False).alias("bad"))


@query("q59_fail_fast_load", "SELECT count(*) AS n, min(o_orderkey) AS low, false AS second FROM orders")
def fail_fast_load(spark, d):
    """A load without errors is published; one with an error leaves what was there."""
    where = f"{folder(spark)}/table"
    orders = table(spark, d, "orders").select("o_orderkey").withColumn("err", errors.none())
    first = sinks.fail_fast(orders, where)
    second = sinks.fail_fast(orders.withColumn("err", errors.when(F.col("o_orderkey") % 1000 == 1, "user", "bad")), where)
    return sinks.loaded(spark, where).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low")).withColumn("second", F.lit(not first or second))


@query("q60_failing_preprocessor", "SELECT event_id AS pos, CASE WHEN event_id % 10 = 3 THEN event_id % 10 ELSE (event_id % 10 + 1) * 3 END AS v, CASE WHEN event_id % 10 = 3 THEN 'user' END AS err_kind FROM events")
def failing_preprocessor(spark, d):
    """A preprocessor's error ends a request before the stage's body."""
    e = events(spark, d).select("pos", (F.col("pos") % 10).alias("v"))
    before = lambda df: {FAILS: F.when(F.col("v") == 3, "three"), "v": F.when(F.col("v") == 3, F.col("v")).otherwise(F.col("v") + 1)}
    out = Pipeline([Stage("only", {"v": F.col("v") * 3})], "only", preprocessors=[before]).run(e)
    return out.select("pos", "v", F.col("err.kind").alias("err_kind"))


@query("q61_unfinished_loop", "SELECT event_id AS pos, least(event_id % 8, 5) AS rounds, CASE WHEN event_id % 8 > 5 THEN 'config' END AS err_kind FROM events")
def unfinished_loop(spark, d):
    """A loop as long as the data says; rows that are not at its end after max_hops say so."""
    e = events(spark, d).select("pos", (F.col("pos") % 8).alias("todo")).withColumn("rounds", F.lit(0).cast("long"))
    again = F.when(F.col("rounds") + 1 < F.col("todo"), "again")
    loop = Stage("again", {"rounds": F.when(F.col("todo") > 0, F.col("rounds") + 1).otherwise(0)}, next=again)
    out = Pipeline([loop], "again", max_hops=5).run(e)
    return out.select("pos", "rounds", F.col("err.kind").alias("err_kind"))


@query("q62_unknown_operation", f"SELECT k, arg_max(v, seq) AS v FROM {CHANGES_SQL} WHERE seq < 500 GROUP BY k HAVING arg_max(op, seq) = 'Add'")
def unknown_operation(spark, d):
    """An operation of no known kind ends the feed."""
    ops = changes(spark, d).withColumn("op", F.when(F.col("seq") == 500, "Bogus").otherwise(F.col("op")))
    return changelog.materialise(changelog.cut_at_error(ops))


@query("q63_delete_hook", "SELECT k, arg_max(v, seq) AS v FROM (SELECT event_id AS seq, user_id AS k, event_id % 1000 AS v, event_type FROM events) WHERE event_type <> 'error' GROUP BY k")
def delete_hook(spark, d):
    """A hook that refuses every Delete, of absent keys as of present ones."""
    return changelog.accept(changes(spark, d), on_delete=lambda k, prev, found: False).select("k", "v")


@query("q64_ordered_output", "SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS at, event_id AS pos FROM events ORDER BY event_id DESC LIMIT 100")
def ordered_output(spark, d):
    """Each row with the place at which it came out, so that the order shows."""
    e = events(spark, d).select((-F.col("pos")).alias("pos"))
    rows = results.first_n(results.ordered(e), 100).collect()  # a report of a hundred rows
    return spark.createDataFrame([(i, -r["pos"]) for i, r in enumerate(rows)], "at long, pos long")


@query("q65_taken_channel", "SELECT event_id AS pos, user_id FROM events WHERE event_id < 250")
def taken_channel(spark, d):
    return readers.take_channel(events(spark, d), 250).select("pos", "user_id")


@query("q66_get", f"SELECT k, arg_max(v, seq) AS v FROM {CHANGES_SQL} WHERE k = 7 GROUP BY k HAVING arg_max(op, seq) = 'Add'")
def get_key(spark, d):
    return changelog.get(changelog.materialise(changes(spark, d)), 7)
