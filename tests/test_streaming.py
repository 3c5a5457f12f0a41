"""Streams over files, run to the end, must give what the batch forms give."""

import pytest

from rulelens.operators import activity, admission, tasks
from rulelens.plans import catalog
from rulelens.sources import results, views, webhooks
from rulelens.streaming import jobs


def run(stream, mode, name, spark, tmp_path):
    query = (
        stream.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(name)


def as_stream(df, spark, tmp_path, name, files=1):
    path = str(tmp_path / name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each, opened and written in every micro-batch
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_admission(spark, data, tmp_path, rocks):
    args = (views.rules(spark, data), views.users(spark, data), views.repo_configs(spark, data), catalog._existing(spark, data))
    events = views.pr_events(spark, data)
    stream = jobs.admit(as_stream(events, spark, tmp_path, "events"), *args)
    got = run(stream, "append", "admitted", spark, tmp_path).select("event_id", "admitted", "reason", "eval_no")
    want = admission.admit(events, *args).select("event_id", "admitted", "reason", "eval_no")
    assert rows(got) == rows(want)
    assert got.filter("admitted").count() > 0


def test_installations(spark, data, tmp_path, rocks):
    events, users = views.installation_events(spark, data), views.users(spark, data)
    stream = jobs.installations(as_stream(events, spark, tmp_path, "inst"), users)
    got = run(stream, "update", "installed", spark, tmp_path).filter("present").drop("present")
    want = admission.installations_after(events, users).select("installation_id", "user_id", "account_login")
    assert rows(got) == rows(want)


@pytest.fixture()
def single_rows(spark):
    """One row per Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    yield
    spark.conf.set(key, before)


def test_admission_of_shuffled_single_rows(spark, tmp_path, rocks, single_rows):
    from test_operators import admission_case

    events, args = admission_case(spark, 25, 30)
    got = run(jobs.admit(as_stream(events, spark, tmp_path, "late", 3), *args), "append", "admitted_late", spark, tmp_path)
    want = admission.admit(events, *args)
    columns = ["event_id", "admitted", "reason", "eval_no"]
    assert rows(got.select(*columns)) == rows(want.select(*columns)) and got.filter("admitted").count() == 25


def test_installations_in_any_order(spark, tmp_path, rocks, single_rows):
    import datetime as dt
    import random

    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    users = spark.createDataFrame([(7, "a"), (8, "b")], "user_id bigint, login string")
    schema = "event_id bigint, ts timestamp, installation_id bigint, action string, sender_login string, account_login string"
    acts = [(1, at(10), 1, "created", "a", "x"), (2, at(20), 1, "deleted", "a", "x"), (3, at(5), 2, "created", "b", "y"), (4, at(15), 2, "created", "a", "z")]
    acts += [(5, at(1), 3, "created", "a", "p"), (6, at(2), 3, "suspend", "a", "p"), (7, at(3), 3, "created", "b", "q"), (8, at(4), 3, "unsuspend", "a", "r")]
    for seed in range(3):
        random.Random(seed).shuffle(acts)
        path = tmp_path / f"in{seed}"
        for act in acts:  # a micro-batch for each
            spark.createDataFrame([act], schema).coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(path))
        got = run(jobs.installations(stream, users), "update", f"order{seed}", spark, tmp_path)
        # the memory sink appends updates: the state is the last row of each installation
        last = {}
        for r in got.collect():
            last[r["installation_id"]] = (r["user_id"], r["account_login"]) if r["present"] else None
        want = {r["installation_id"]: (r["user_id"], r["account_login"]) for r in admission.installations_after(spark.createDataFrame(acts, schema), users).collect()}
        assert {k: v for k, v in last.items() if v} == want == {2: (8, "z"), 3: (8, "r")}


def by_file(spark, path, schema, batches):
    """A stream that reads one file a micro-batch, in the order given."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def kept_rows(name, stream, mode, tmp_path):
    """(output rows, rows of state after the last micro-batch)."""
    query = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p.stateOperators]
    return stream.sparkSession.table(name).collect(), progress[-1].stateOperators[0].numRowsTotal


DAY = 24 * 3600 * 1000


def day(n):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_old_pull_requests_leave_the_state(spark, tmp_path, rocks):
    from test_operators import admission_case

    _, args = admission_case(spark, 2, 0)
    schema = "event_id bigint, ts timestamp, action string, repository_full_name string, pr_number bigint"

    def event(i, at, pr):
        return (i, day(at), "opened", "o/r", pr)

    batches = [[event(1, 0, 1), event(2, 0.1, 1), event(3, 0.2, 1)], [event(4, 5, 2)], [event(5, 20, 2)], [event(6, 21, 1)], [event(7, 2, 3)]]
    stream = jobs.admit(by_file(spark, tmp_path / "prs", schema, batches), *args, ttl_ms=10 * DAY, late="1 day")
    got, held = kept_rows("prs", stream, "append", tmp_path)
    assert {r["event_id"]: r["eval_no"] for r in got} == {
        1: 1, 2: 2, 3: None,  # the cap
        4: 1, 5: 2,  # a quiet pull request is kept for ten days behind the watermark
        6: 1,  # forgotten on day 11.2, it counts anew
    }  # event 7 is behind the watermark
    only_old = [[event(1, 0, 1)], [event(2, 1, 2)], [event(3, 40, 3)], [event(4, 41, 3)]]
    stream = jobs.admit(by_file(spark, tmp_path / "old", schema, only_old), *args, ttl_ms=10 * DAY, late="1 day")
    _, left = kept_rows("old", stream, "append", tmp_path)
    assert left < held  # a single pull request


def test_ended_tasks_leave_the_state(spark, tmp_path, rocks):
    schema = "event_id bigint, task_id bigint, type string, progress int, message string, ts timestamp"

    def event(i, task, kind, at, progress=None):
        return (i, task, kind, progress, None, day(at))

    batches = [
        [event(1, 1, "task_progress", 0, 10), event(2, 2, "task_progress", 0, 5), event(3, 3, "task_progress", 0, 1)],
        [event(4, 1, "task_completed", 1), event(5, 2, "task_progress", 1, 50)],
        [event(6, 3, "task_progress", 6, 2)],  # task 1 ended, tasks 2 and 3 go on
        [event(7, 2, "task_progress", 7, 60), event(8, 1, "task_progress", 7, 1)],  # task 1 begins anew
        [event(9, 2, "task_failed", 2)],  # behind the watermark
    ]
    stream = jobs.task_state(by_file(spark, tmp_path / "te", schema, batches), ended_ms=DAY, quiet_ms=30 * DAY, late="1 day")
    got, _ = kept_rows("ended", stream, "update", tmp_path)
    last = {}
    for r in got:
        last[r["task_id"]] = (r["status"], r["progress"], r["events"])
    assert last == {1: ("running", 1, 1), 2: ("running", 60, 3), 3: ("running", 2, 2)}
    sizes = []
    for n, kind in enumerate(("task_completed", "task_progress")):
        batches = [[event(k, k, kind, 0) for k in range(50)], [event(99, 99, "task_progress", 9)], [event(100, 99, "task_progress", 10)]]
        stream = jobs.task_state(by_file(spark, tmp_path / f"t{n}", schema, batches), ended_ms=DAY, quiet_ms=30 * DAY, late="1 day")
        sizes.append(kept_rows(f"sizes{n}", stream, "update", tmp_path)[1])
    assert 50 * sizes[0] < 2 * sizes[1]


def test_task_state_in_any_order(spark, data, tmp_path, rocks, single_rows):
    events = views.task_events(spark, data).filter("event_id < 60")
    stream = jobs.task_state(as_stream(events.orderBy("message"), spark, tmp_path, "any", 3), late="9999 days")
    last = {r["task_id"]: tuple(r) for r in run(stream, "update", "any", spark, tmp_path).collect()}
    assert sorted(last.values(), key=repr) == rows(admission.task_state(events))


def test_task_state(spark, data, tmp_path, rocks):
    events = views.task_events(spark, data)
    got = run(jobs.task_state(as_stream(events, spark, tmp_path, "te")), "update", "states", spark, tmp_path)
    assert rows(got) == rows(admission.task_state(events))


def test_calls_and_activity(spark, data, tmp_path):
    calls = views.call_log(spark, data)
    got = run(jobs.calls_per_minute(as_stream(calls, spark, tmp_path, "calls"), 10), "update", "rate", spark, tmp_path)
    assert rows(got) == rows(activity.calls_per_minute(calls, 10))
    acts = views.activity(spark, data)
    got = run(jobs.hourly_activity(as_stream(acts, spark, tmp_path, "acts")), "update", "hours", spark, tmp_path)
    assert rows(got) == rows(catalog.QUERIES["r6_hourly_activity"](spark, data))


def test_sliding_rate(spark, data, tmp_path):
    calls = views.call_log(spark, data)
    stream = jobs.sliding_rate(as_stream(calls, spark, tmp_path, "slide"), 1, "10 seconds")
    got = run(stream, "update", "slides", spark, tmp_path)
    assert rows(got) == rows(catalog.QUERIES["r4_sliding_rate"](spark, data))


def test_stateless_streams(spark, data, tmp_path):
    failures = views.tasks(spark, data).filter("status = 'failed'").selectExpr(
        "id as task_id", "case id % 3 when 0 then 'LLM' else 'OTHER' end as error_kind", "retry_count",
        "completed_at as failed_at", "error as technical",
    )
    got = run(jobs.requeue(as_stream(failures, spark, tmp_path, "fail")), "append", "requeued", spark, tmp_path)
    assert rows(got) == rows(tasks.requeue(failures))
    events = views.task_events(spark, data).select("event_id", "user_id", "task_id")
    conns = events.select("user_id").distinct().selectExpr("user_id", "user_id as connection_id")
    subs = events.filter("user_id % 2 = 0").select(events.user_id.alias("connection_id"), "task_id").limit(20)
    subs = spark.createDataFrame(subs.collect(), subs.schema)
    got = run(jobs.route(as_stream(events, spark, tmp_path, "route"), conns, subs), "append", "routed", spark, tmp_path)
    assert rows(got) == rows(admission.route(events, conns, subs))


def test_payload_stream_and_sink(spark, data, tmp_path):
    events = views.pr_events(spark, data)
    catalog.payloads(events).repartition(3).write.json(str(tmp_path / "payloads"))
    stream = webhooks.pull_requests(webhooks.read_payloads(spark, str(tmp_path / "payloads"), stream=True))
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.foreachBatch(results.append_parquet(out))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(out).select("repository_full_name", "pr_number", "head_sha", "ts")
    assert rows(got) == rows(events.select("repository_full_name", "pr_number", "head_sha", "ts"))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "id int, status string, created_at timestamp"
    import datetime as dt

    base = dt.datetime(2024, 1, 1, 12)
    for n, hours in enumerate((0, 5, 5.1, 0.1)):
        df = spark.createDataFrame([(n, "failed", base + dt.timedelta(hours=hours))], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = run(jobs.hourly_activity(stream), "append", "late", spark, tmp_path)
    assert [r.n for r in got.collect()] == [1]
