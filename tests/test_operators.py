import random
from datetime import datetime, timedelta

import pytest
from millrace.functions import errors
from millrace.operators import broadcast, changelog, keyed, results, stats, topics
from millrace.plans import autoscale, etl
from millrace.plans.autoscale import Memory, decide
from millrace.plans.pipeline import Pipeline, Stage, mux
from millrace.sources import readers, sinks
from pyspark.sql import functions as F


def positions(spark, values):
    return readers.from_slice(spark, values, "long")


def test_map_keeps_every_row_and_input_order(spark):
    df = positions(spark, [1, 2, 3, 4])
    got = results.ordered(results.item(df, F.col("v") * 2, errors.when(F.col("v") == 2, "user", "no"))).collect()
    assert [(r.pos, r.v, r.err and r.err.kind) for r in got] == [(0, 2, None), (1, None, "user"), (2, 6, None), (3, 8, None)]
    assert results.item(positions(spark, []).limit(0), F.col("v")).count() == 0


@pytest.mark.parametrize("fail,permanent,attempts,calls", [(0, False, 3, 1), (2, False, 3, 3), (9, True, 3, 1), (9, False, 2, 2)])
def test_retries(spark, fail, permanent, attempts, calls):
    class Final(Exception):
        pass

    def func(x):
        tries.append(x)
        if len(tries) <= fail:
            raise Final("x") if permanent else ValueError("x")
        return x

    tries: list = []
    r = results.item_func(positions(spark, [7]), func, "bigint", attempts=attempts, permanent=Final).first()
    assert r.calls == calls and (r.err is None) == (fail < attempts and not permanent)
    assert r.err is None or r.err.permanent == permanent


def test_stop_sweep_and_prefix(spark):
    m = results.item(positions(spark, list(range(10))), F.col("v"), errors.when(F.col("v").isin(4, 7), "user", "no"))
    assert sorted(r.pos for r in results.stop_on_error(m).collect()) == [0, 1, 2, 3, 4]
    swept = {r.pos: r.err and r.err.kind for r in results.sweep(m, m.filter("pos < 3")).collect()}
    assert swept == {p: None if p < 3 else "cancelled" for p in range(10)}
    s = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1), ("c", 0)], "k string, pos long")
    assert sorted((r.k, r.pos) for r in results.contiguous(s, "pos", "k").collect()) == [("a", 0), ("a", 1), ("c", 0)]


@pytest.mark.parametrize("dones,turn", [([], 0), ([0, 2], 1), ([1, 2, 0], 3), ([1], 0), ([0, 1, 2, 5], 3)])
def test_turns(spark, dones, turn):
    df = spark.createDataFrame([("k", x) for x in [*dones, 10**6]], "k string, pos long")
    assert results.turns(df, "pos", "k").first().turn == turn


def test_index_is_dense(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(500)]
    got = readers.indexed(spark.createDataFrame(rows, "a long, b long"), "a", "b", chunks=7).orderBy("pos").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(500))


def test_blocks(spark):
    assert [r.n for r in readers.blocks(positions(spark, list(range(250))), 100).groupBy("block_id").agg(F.count("*").alias("n")).orderBy("block_id").collect()] == [100, 100, 50]
    with pytest.raises(ValueError):
        readers.blocks(positions(spark, [1]), 99)


def test_poison(spark):
    rows = [(k, s, "boom" if (k, s) in {("a", 2), ("a", 4)} else None) for k in "ab" for s in range(6)]
    got = {(r.k, r.seq): r.err and r.err.kind for r in keyed.poison(spark.createDataFrame(rows, "k string, seq long, own_err string"), "k").collect()}
    assert [got["a", s] for s in range(6)] == [None, None, "user", "key_failed", "key_failed", "key_failed"]
    assert {got["b", s] for s in range(6)} == {None}


def test_sessions_and_cohorts(spark):
    t = datetime(2024, 1, 1)
    rows = [("k", i, t + timedelta(milliseconds=i if i < 5 else 150 + i), t + timedelta(milliseconds=i + 10 if i < 5 else 160 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, pos long, ts timestamp_ntz, gone timestamp_ntz")
    for out, name in ((keyed.sessions(df, "k", "ts", "0.03 SECONDS"), "session"), (keyed.cohorts(df, "k", "ts", "gone"), "cohort")):
        assert [r[name] for r in out.orderBy("pos").collect()] == [0] * 5 + [1] * 5


def test_admission_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, i * 3, r.randint(1, 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, pos long, at long, work long")
    for depth in (0, 1, 3):
        got = {x.pos: (x.begin, x.finish) for x in keyed.admission(df, "k", "at", "work", depth).collect()}
        for key in "ab":
            live: list = []
            for _, pos, at, work in [x for x in rows if x[0] == key]:
                begin = at
                if depth and len(live) >= depth:
                    begin = max(at, sorted(live)[-depth])
                live.append(begin + work)
                assert got[pos] == (begin, begin + work)


@pytest.mark.parametrize("key,stages,stop,depth,want", [(True, 1, False, None, 4), (True, 1, True, 0, 0), (True, 64, False, 2, 2), (False, 0, False, None, 4), (True, 0, False, None, None), (False, 1, False, None, None), (False, 0, True, None, None), (False, 0, False, 3, None), (True, 65, False, None, None), (True, 1, False, -1, None)])
def test_config(key, stages, stop, depth, want):
    if want is None:
        with pytest.raises(ValueError):
            keyed.config(key, stages, stop, depth)
    else:
        assert keyed.config(key, stages, stop, depth) == want


def ops(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, op string, k string, v long, err string")


def test_changelog(spark):
    log = ops(spark, [("Add", "a", 1, None), ("Add", "b", 2, None), ("Delete", "a", None, None), ("Delete", "zz", None, None)])
    assert [tuple(r) for r in changelog.materialise(log).collect()] == [("b", 2)]
    cut = ops(spark, [("Add", "a", 1, None), ("Add", "b", 2, "broken"), ("Delete", "a", None, None)])
    assert [tuple(r) for r in changelog.materialise(changelog.cut_at_error(cut)).collect()] == [("a", 1)]
    up = ops(spark, [("Add", "a", 5, None), ("Add", "a", 3, None), ("Add", "b", 9, None), ("Delete", "b", None, None), ("Add", "b", 1, None)])
    want = [("a", 5), ("b", 1)]
    assert sorted(tuple(r) for r in changelog.accept_greater(up).collect()) == want
    hook = changelog.accept(up, on_set=lambda k, v, prev, found: not found or v > prev)
    assert sorted((r.k, r.v) for r in hook.collect()) == want


def test_hooks_that_deny_or_raise(spark):
    log = ops(spark, [("Add", "a", 1, None), ("Delete", "a", None, None)])
    assert [(r.k, r.v) for r in changelog.accept(log, on_delete=lambda k, prev, found: False).collect()] == [("a", 1)]

    def angry(k, prev, found):
        raise RuntimeError("never")

    r = changelog.accept(log, on_delete=angry).first()
    assert (r.v, r.err) == (1, "never")
    assert changelog.accept(log, on_set=lambda *a: False).count() == 0


def test_broadcast(spark):
    log = spark.createDataFrame([(i, i * 10) for i in range(5)], "idx long, v long")
    subs = spark.createDataFrame([(1, 0, None, None), (2, 3, None, 1), (3, 2, 4, None), (4, 9, None, None)], "sub_id long, start_idx long, end_idx long, consume long")
    got = sorted((r.sub_id, r.idx) for r in broadcast.deliveries(log, subs.drop("consume"), width=2).collect())
    assert got == [(1, i) for i in range(5)] + [(2, 3), (2, 4), (3, 2), (3, 3)]
    assert {r.sub_id: (r.delivered, r.pending) for r in broadcast.lag(subs, log).collect()} == {1: (5, 0), 2: (1, 1), 3: (2, 0), 4: (0, 0)}
    assert tuple(broadcast.metrics(log, subs).first()) == (5, 4, 8, 1)
    assert broadcast.deliveries(log.limit(0), subs.drop("consume")).count() == 0


def test_last_subscription_out_removes_the_pattern(spark):
    changes = spark.createDataFrame([(0, "Add", "a/*"), (1, "Add", "/a/*"), (2, "Delete", "a/*"), (3, "Add", "b"), (4, "Delete", "b"), (5, "Add", "bad//x")], "seq long, op string, pattern string")
    assert [tuple(r) for r in topics.live_patterns(changes).collect()] == [("a/*", 1)]


def test_pipeline_routes_cycles_and_checks(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "num long")
    even = Pipeline([Stage("a", next="b"), Stage("b", next=F.when(F.col("num") % 2 == 0, "a"))], "a", dag=True).run(df)
    assert [(r.err and (r.err.kind, r.err.msg), r.hops) for r in even.orderBy("num").collect()] == [(("cyclic", "a -> b"), 2), (None, 2)] * 2
    loop = Pipeline([Stage("a", next="a")], "a").run(df).first()
    assert loop.err.kind == "config"
    fails = Pipeline([Stage("a", {"num": F.col("num") + 1}, "b", F.when(F.col("num") == 1, F.lit("one"))), Stage("b", {"num": F.col("num") * 10})], "a").run(df)
    assert sorted((r.num, r.err and r.err.msg) for r in fails.collect()) == [(2, "one"), (10, None), (30, None), (40, None)]
    for bad in (dict(stages=[], start="a"), dict(stages=[Stage("a"), Stage("a")], start="a"), dict(stages=[Stage("a")], start="b"), dict(stages=[Stage("a")], start="a", max_hops=0)):
        with pytest.raises(ValueError):
            Pipeline(**bad)


def test_mux(spark):
    df = positions(spark, [5])
    assert sorted(r.group_id for r in mux({0: df, 3: df}).collect()) == [0, 3]


SAMPLE = dict(width=3, low=3, high=24, seeded=True, rate=100.0, base=100.0)


@pytest.mark.parametrize(
    "memory,before,now,want",
    [
        (dict(seeded=False), (0, 0, 9, 9), (1, 100, 9, 9), 0),
        ({}, (0, 0, 9, 9), (0, 100, 9, 9), 0),
        ({}, (0, 0, 9, 9), (1, 100, 9, 9), 3),
        (dict(climbing=True), (0, 0, 9, 9), (1, 200, 9, 9), 3),
        (dict(climbing=True), (0, 0, 9, 9), (1, 100, 9, 9), -3),
        (dict(climbing=True), (0, 0, 9, 9), (1, 0, 9, 9), -3),
        (dict(climbing=True), (0, 0, 24, 24), (1, 200, 24, 24), 0),
        (dict(ceiling=9), (0, 0, 9, 9), (1, 100, 9, 9), 0),
        (dict(ceiling=9, since_probe=19), (0, 0, 9, 9), (1, 100, 9, 9), 3),
        ({}, (0, 0, 1, 24), (1, 100, 1, 24), -21),
        (dict(low=9), (0, 0, 0, 12), (1, 0, 0, 12), -3),
        ({}, (0, 0, 6, 9), (1, 100, 6, 9), 0),
        (dict(hold=2), (0, 0, 9, 9), (1, 200, 9, 9), 0),
    ],
)
def test_decisions(memory, before, now, want):
    assert decide(Memory(**(SAMPLE | memory)), before, now)[1] == want


def test_trace_equals_the_fold(spark):
    r = random.Random(3)
    rows = [(k, i, float(i), i * r.randint(1, 9), r.randint(0, 12), r.choice([3, 6, 9])) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, tick long, t double, completed long, running long, workers long")
    got = {(x.k, x.tick): x.change for x in autoscale.trace(df, "k", 3, 3, 24).collect()}
    for k in (1, 2):
        memory, mine = Memory(3, 3, 24), [x for x in rows if x[0] == k]
        for a, b in zip(mine, mine[1:], strict=False):
            memory, change = decide(memory, a[2:], b[2:])
            assert got[k, b[1]] == change
    with pytest.raises(ValueError):
        Memory(1, 5, 4)


def test_times(spark):
    df = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", None, 9)], "k string, run_ns long, wait long")
    r = stats.times(df, "k", wait="wait", done=F.col("run_ns").isNotNull()).first()
    assert tuple(r) == ("a", 2, 3, 10, 15, 20, 1, 6, 9)
    none = stats.times(df.filter("run_ns IS NULL"), "k", done=F.col("run_ns").isNotNull()).first()
    assert tuple(none) == ("a", 0, 1, 0, 0, 0)


CSV = """businessname,other,licstatus,result,violdesc,violdttm,violstatus,viollevel,comments,address,city,zip
"Cafe, A",x,Active,Fail,d,2017-01-01 10:00:00,o,*,c,s,b,1
Bar,x,Active,Fail,d,,o,**,c,s,b,1
Pub,x,Active,Fail,d, ,o,x,c,s,b,1
"""


def test_etl(spark, tmp_path):
    (tmp_path / "v.csv").write_text(CSV)
    rows = etl.typed(readers.violations_csv(spark, str(tmp_path / "v.csv")))
    got = rows.withColumn("time", F.col("time").cast("string")).collect()
    assert [(r.business_name, r.level, r.time, r.err is None) for r in got] == [("Cafe, A", 1, "2017-01-01 10:00:00", True), ("Bar", 2, "0001-01-01 00:00:00", True), ("Pub", -1, None, False)]
    assert tuple(etl.counts(rows).first()) == (4, 1, False)
    assert [tuple(r) for r in etl.report(rows).collect()] == [("Cafe, A", 1)]
    failed = etl.by_block(rows.withColumn("block_id", F.lit(0)))
    assert failed.filter("err IS NULL").count() == 0
    out = str(tmp_path / "out")
    assert not sinks.fail_fast(rows, out) and not sinks.error_budget(rows, out)
    with pytest.raises(ValueError):
        sinks.published(spark, out)
    assert sinks.error_budget(rows, out, budget=0.25) and sinks.loaded(spark, out).count() == 2
    assert sinks.fail_fast(rows.filter("err IS NULL").limit(1), out) and sinks.loaded(spark, out).count() == 1
    assert not sinks.fail_fast(rows, out) and sinks.loaded(spark, out).count() == 1


def test_index_of_many_wide_rows_is_dense(spark):
    """Both reads of the ranges agree, whatever columns they take."""
    df = spark.range(3_000_000, numPartitions=8).select((F.col("id") * 7919 % 3_000_017).alias("v"), F.md5(F.col("id").cast("string")).alias("payload"))
    got = readers.indexed(df, "v", chunks=64).selectExpr("pos", "v", "length(payload) AS n")
    ends = got.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum("n")).first()
    assert tuple(ends) == (3_000_000, 3_000_000, 0, 2_999_999, 96_000_000)
    want = df.select("v").orderBy("v").limit(2000).toPandas()["v"].tolist()
    assert got.filter("pos < 2000").orderBy("pos").toPandas()["v"].tolist() == want


def test_sequence_of_hot_keys_equals_the_plain_one(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 5 > 1, 1).when(F.col("id") % 5 == 1, 2).alias("k"), (F.col("id") * 37 % 5003).alias("pos"))
    plain, hot = (sorted(map(str, keyed.sequence(df, "k", hot=h).select("k", "pos", "seq").collect())) for h in (False, True))
    assert plain == hot


def test_batches_are_retried_and_their_errors_are_rows(spark, tmp_path):
    def write(block, rows):
        (tmp_path / f"{block}-{len(list(tmp_path.iterdir()))}").touch()
        if any(r["v"] == 7 for r in rows):
            raise ValueError("permanent")
        if len([p for p in tmp_path.iterdir() if p.name.startswith(f"{block}-")]) < 2:
            raise OSError("try again")

    df = spark.range(0, 10, numPartitions=1).withColumnRenamed("id", "v")
    got = sinks.write_batches(df, write, items=4, attempts=3, permanent=lambda e: isinstance(e, ValueError)).collect()
    assert [(r.block, r.rows, r.err and (r.err.msg, r.err.permanent)) for r in got] == [("0-0", 4, None), ("0-1", 4, ("permanent", True)), ("0-2", 2, None)]


def test_null_keys_and_unknown_operations(spark):
    ops = spark.createDataFrame([(0, "Add", None, 5), (1, "Add", None, 3), (2, "Add", 1, 1), (3, "Bogus", 1, None), (4, "Add", 2, 4), (5, "Delete", 2, None)], "seq long, op string, k long, v long")
    got = changelog.accept(ops, on_set=lambda k, v, prev, found: not found or v > prev).collect()
    assert sorted((r.k or 0, r.v, r.err) for r in got) == [(0, 5, None), (1, 1, "no such operation: Bogus")]
    assert sorted((r.k or 0, r.v) for r in changelog.accept_greater(ops).collect()) == [(0, 5), (1, 1)]
    ended = changelog.cut_at_error(ops.withColumn("err", F.lit(None).cast("string")))
    assert sorted(r.seq for r in ended.collect()) == [0, 1, 2]


def test_a_delete_of_nothing_is_nothing(spark):
    rows = [(0, "Delete", "a/b"), (1, "Add", "a/b"), (70_000, "Delete", "c"), (70_001, "Delete", "c"), (140_000, "Add", "c"), (140_001, "Add", "c"), (210_000, "Delete", "c"), (3, "Add", "d"), (4, "Delete", "d")]
    changes = spark.createDataFrame(rows, "seq long, op string, pattern string")
    assert sorted(tuple(r) for r in topics.live_patterns(changes).collect()) == [("a/b", 1), ("c", 1)]


def test_routes_that_do_not_end_say_so(spark):
    again = Stage("again", {"v": F.col("v") + 1}, next=F.when(F.col("v") < 8, "again"))
    got = Pipeline([again], "again", max_hops=5).run(positions(spark, [0, 6])).collect()
    assert [(r.v, r.err and r.err.kind) for r in got] == [(5, "config"), (9, None)]


def test_feed_goes_on_from_its_folder(spark, tmp_path):
    from millrace.streaming import processors

    (tmp_path / "in").mkdir()
    fold = lambda before, batch: batch.select("k", "v") if before is None else before.join(batch, "k", "left_anti").unionByName(batch.select("k", "v"))
    for n, rows in enumerate([[(1, 1), (2, 2)], [(3, 3), (2, 5)], []]):
        if rows:
            spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
        last = processors.feed(stream, str(tmp_path / "feed"), fold)
        want = [[(1, 1), (2, 2)], [(1, 1), (2, 5), (3, 3)], [(1, 1), (2, 5), (3, 3)]][n]
        assert sorted(tuple(r) for r in spark.read.parquet(last).collect()) == want


def test_streamed_sequences_cross_batches_and_drop_late_rows(spark, tmp_path):
    from millrace.streaming import processors

    for n, rows in enumerate([[("a", 0), ("b", 1), ("a", 4)], [("a", 3), ("a", 6), ("b", 5)]]):
        spark.createDataFrame(rows, "k string, pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, pos long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = processors.sequence(stream, "k", "pos").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0, 0), ("a", 4, 1), ("a", 6, 2), ("b", 1, 0), ("b", 5, 1)]


def test_whole_division_truncates(spark):
    from millrace.functions import scalars

    rows = spark.createDataFrame([(-7,), (7,), (-9,), (9007199254740995,)], "a long").select(scalars.quotient(F.col("a"), 3).alias("q")).collect()
    assert [r.q for r in rows] == [-2, 2, -3, 3002399751580331]


def test_sinks(spark, tmp_path):
    def touch(row):
        (tmp_path / str(row.v)).touch()
        raise RuntimeError("dropped")

    sinks.for_each(positions(spark, [1, 2, 3]), touch, 1)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2", "3"]
    for worker, size in ((touch, 0), (None, 1)):
        with pytest.raises(ValueError):
            sinks.for_each(positions(spark, [1]), worker, size)
    assert sinks.is_permanent("FATAL", "") and sinks.is_permanent("ERROR", "42601") and not sinks.is_permanent("ERROR", "40001")
    table = spark.createDataFrame([("alice", 1), ("bob", 2)], "k string, v long")
    change = spark.createDataFrame([("Delete", "alice", None), ("Add", "carl", 3)], "op string, k string, v long")
    assert sorted(tuple(r) for r in sinks.upsert(table, change, "k").collect()) == [("bob", 2), ("carl", 3)]


def test_fold_streams_keys_in_order(spark):
    rows = [(k, p) for p in range(200) for k in "abc"]
    df = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "k string, pos long")
    got = keyed.fold(df, "k", "pos", lambda n, r: (n + 1, [(r.k, r.pos, n)]), int, "k string, pos long, n long").collect()
    assert all(r.pos == r.n for r in got) and len(got) == 600


def test_retry():
    calls: list = []

    def act():
        calls.append(1)
        raise OSError("down")

    for attempts, permanent, want in ((3, False, 3), (3, True, 1)):
        calls.clear()
        with pytest.raises(OSError):
            sinks.retry(act, attempts, lambda e, p=permanent: p, lambda n: 0.0)
        assert len(calls) == want
    assert sinks.retry(lambda: 5, 1) == 5


def test_closed_comes_before_a_bad_path(spark):
    sends = spark.createDataFrame([(0, "a"), (1, "a/"), (2, "a"), (3, "a/")], "seq long, topic string")
    got = [r.err and r.err.kind for r in topics.send_errors(sends, 2).orderBy("seq").collect()]
    assert got == [None, "invalid_path", "closed", "closed"]
    assert [r.err and r.err.kind for r in topics.send_errors(sends, None).orderBy("seq").collect()] == [None, "invalid_path", None, "invalid_path"]


def test_table_reset_and_insert(spark, tmp_path):
    schema = "a long, b string"
    for _ in range(2):
        sinks.reset_table(spark, "millrace_test", schema)
        sinks.insert(spark.createDataFrame([("x", 9, 1)], "b string, extra long, a long"), "millrace_test")
    assert [tuple(r) for r in spark.table("millrace_test").collect()] == [(1, "x")]
    spark.sql("DROP TABLE millrace_test")


def test_workers_json_and_observation(spark):
    assert Pipeline([Stage("a"), Stage("b")], "a").workers(3, 1) == 9
    with pytest.raises(ValueError):
        Pipeline([Stage("a")], "a").workers(0)
    from millrace.functions import scalars

    df = results.item(positions(spark, [1, 2]), F.col("v"), errors.when(F.col("v") == 2, "user", "no"))
    watched, o = stats.observed(df, "run")
    assert watched.select(scalars.as_json("pos").alias("j"), "err").collect()[0].j == '{"pos":0}'
    assert o.get == {"rows": 2, "errors": 1}
