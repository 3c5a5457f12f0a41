"""Operators on hand-made rows, and properties over the given tables."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.operators import (
    activity, admission, contexts, contributors, declarations, evaluation, indexing, numbering, repomap, reports, rules,
    search, tasks,
)
from rulelens.operators.chunking import chunk_windows
from rulelens.plans import catalog, validate
from rulelens.sources import files as file_source
from rulelens.sources import results, rule_files, vector_table, views


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbering_equals_plain_window(spark, data):
    plain = views.validations(spark, data).select("task_id", "rule", "rule_idx")
    base = views.lines(spark, data)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    for bucket in ("struct(l_linenumber, l_partkey div 64)", "l_linenumber", "1", "nullif(l_linenumber, 1)"):
        split = numbering.number_within(base, ["task_id"], [F.col(c) for c in order], F.expr(bucket), "rule_idx")
        assert rows(split.select("task_id", "rule", "rule_idx")) == rows(plain)
    keyless = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (None, 3)], "k int, v int")
    got = numbering.number_within(keyless, ["k"], [F.col("v")], F.col("v"), "n")
    assert rows(got.select("k", "v", "n")) == rows(spark.createDataFrame([(None, 1, 0), (None, 2, 1), (None, 3, 2), (1, 5, 0)], "k int, v int, n bigint"))


def shuffles(df):
    """The exchanges of the plan before it runs."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "simple")
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_only_large_groups_are_split(spark):
    values = [(k, v) for k, n in ((None, 5), (1, 2), (2, 9), (3, 1)) for v in range(n)]
    df = spark.createDataFrame([(k, v, f"t{k}-{v}") for k, v in values], "k int, v int, t string").repartition(3)
    want = sorted([(k, v, f"t{k}-{v}", v) for k, v in values], key=repr)
    for above in (None, 0, 3, 100):
        got = numbering.number_within(df, ["k"], [F.col("v")], F.floor(F.col("v") / 2), "n", split_above=above)
        assert got.columns == ["k", "v", "t", "n"] and rows(got) == want
    assert len(shuffles(got)) == 1


@pytest.mark.parametrize("name", ["w10_report_lines", "s8_results", "a5_nested_counts"])
def test_rows_of_tasks_are_shuffled_once(spark, data, name, monkeypatch):
    """Numbering, nesting and counting by task share one shuffle."""
    want = rows(catalog.QUERIES[name](spark, data))
    found = shuffles(catalog.QUERIES[name](spark, data))
    assert len(found) == 1, found
    monkeypatch.setattr(views, "GROUP_ROWS", 4)
    monkeypatch.setattr(reports, "GROUP_ROWS", 3)
    assert rows(catalog.QUERIES[name](spark, data)) == want


def test_bucketed_rows_are_shuffled_once(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id as v", "md5(cast(id as string)) as t")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = numbering.number_within(df, ["k"], [F.col("v")], F.floor(F.col("v") / 100), "n")
        assert len(shuffles(got)) == 4  # the rows, and totals by group and bucket, by group, and again by both
    finally:
        spark.conf.set(key, before)


def test_report_parts_take_their_lines_once(spark):
    t = spark.createDataFrame([(1, 2, 0.5, 0.8), (2, 1, 0.0, 0.8), (2, 1, 0.0, 0.8)], "task_id int, eval_no int, score double, approval_threshold double")
    t = t.withColumn("approved", F.col("score") >= F.col("approval_threshold"))
    verdicts = ["fail", "pass", "partial", None, "pass", "partial", "fail"]
    e = spark.createDataFrame([(i, n, f"r{n}", v, "a. b") for i in (1, None) for n, v in enumerate(verdicts)], "task_id int, rule_idx int, rule string, final_verdict string, explanation string")
    lines = reports.report_lines(e).localCheckpoint()
    whole = {r.task_id: r.body for r in reports.report_bodies(t, lines).collect()}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for n in (1, 2, 3, 7):
            parts = reports.report_bodies(t, lines, n)
            got = sorted((r.task_id, r.part, r.body) for r in parts.collect())
            assert "\n".join(b for i, _, b in got if i == 1) == whole[1] and len(got) == -(-7 // n) + 2
            assert [(p, b) for i, p, b in got if i == 2] == [(0, whole[2])] * 2
        assert sum(", part#" in x for x in shuffles(parts)) == 2  # the lines, and the short rows of their tasks
        assert len(shuffles(parts)) == 5  # and the bounds of sections, by section and by task, and the tasks
    finally:
        spark.conf.set(key, before)


def test_layer_merge(spark):
    hits = spark.createDataFrame(
        [(1, "a", "", 0.9, "h1"), (1, "a", "", 0.5, "h2"), (1, "a", "pr", 0.4, "h3"), (1, "b", "", 0.8, "h4"), (1, "b", "", 0.7, "h5")],
        "query_id int, source string, branch string, similarity double, chunk_hash string",
    )
    last = {(r.source, r.similarity, r.branch) for r in search.merge_layers(hits, "last").collect()}
    best = {(r.source, r.similarity, r.branch) for r in search.merge_layers(hits, "best").collect()}
    assert last == {("a", 0.4, "pr"), ("b", 0.7, "")}
    assert best == {("a", 0.4, "pr"), ("b", 0.8, "")}


@pytest.mark.parametrize("block_values, query_block, query_step", [(8 * 40, 3, 2), (8_000_000, 2048, 256)])
def test_nearest_against_brute_force(spark, monkeypatch, block_values, query_block, query_step):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(search, "BLOCK_VALUES", block_values)
    monkeypatch.setattr(search, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(search, "QUERY_STEP", query_step)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[150:160] = base[10]
    chunks = [("hot" if i % 3 else f"c{i % 5}", "", f"h{i:03d}", base[i].tolist()) for i in range(300)]
    queries = [(q, "hot" if q % 2 else "c0", "", base[q].tolist() if q < 12 else rng.normal(size=8).tolist()) for q in range(20)]
    c = spark.createDataFrame(chunks, "collection_name string, branch string, chunk_hash string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id bigint, collection_name string, branch string, query_vec array<float>")
    got = {(r.query_id, r.hit_no): (r.chunk_hash, r.similarity) for r in search.nearest(c, q, 7).collect()}
    for qid, col, _, vec in queries:
        v = np.asarray(vec, dtype=np.float32).astype(float)
        sims = []
        for ccol, _, h, e in chunks:
            if ccol == col:
                e = np.asarray(e, dtype=float)
                sims.append((-round(float(v @ e / (np.linalg.norm(v) * np.linalg.norm(e))), 9), h))
        for n, (s, h) in enumerate(sorted(sims)[:7], start=1):
            assert got[(qid, n)][0] == h and abs(got[(qid, n)][1] + s) < 1e-8


@pytest.mark.parametrize("limit", [8_000_000, 1000])
def test_best_of_all_against_brute_force(monkeypatch, limit):
    """Near and exact ties, vectors without a direction, groups larger and smaller than k; no similarity is sorted that is not needed."""
    monkeypatch.setattr(search, "BLOCK_VALUES", limit)
    rng = np.random.default_rng(3)
    seen = []
    sorts = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a: seen.append(len(keys[0])) or sorts(keys, *a))
    for n, k in ((0, 3), (2, 3), (50, 3), (5000, 20), (700, 20)):
        base = rng.normal(size=(n, 16))
        base[n // 2 : n // 2 + n // 10] = base[: n // 10]
        base[n // 4 : n // 4 + n // 10] = base[: n // 10] + 1e-8 * rng.normal(size=(n // 10, 16))
        base[: n // 50] = 0
        asked = np.concatenate([base[: min(n, 300) : 3] + 1e-7, rng.normal(size=(30, 16)), np.zeros((1, 16))])
        names = [f"h{i}" for i in rng.permutation(n)]
        seen.clear()
        query, chunk, sims = search._best_of_all(search._unit(base), search._unit(asked), search.pa.array(names, search.pa.string()), k)
        assert limit == 1000 or sum(seen) <= 4 * (n > 0) * k * len(asked) + n
        whole = np.round(search._unit(base) @ search._unit(asked).T, 9)
        for q in range(len(asked)):
            want = sorted((-s, names[i], i) for i, s in enumerate(whole[:, q].tolist()) if s == s)[:k]
            got = [(-s, names[i], i) for s, i in zip(sims[query == q].tolist(), chunk[query == q].tolist())]
            assert [x[1:] for x in got] == [x[1:] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want], atol=1e-8)


def test_line_ranges_send_no_texts(spark, data):
    """Lines are counted once a file; the joins with queries get the numbers, not the texts."""
    plan = catalog.QUERIES["w7_line_ranges"](spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert "AS file_lines" in "".join(plan[at:]) and not any("file_text" in line for line in plan[:at])
    texts = [line for line in plan[at:] if " file_text" in line or "[file_text" in line]
    assert not any("source" in line and "AS file_lines" not in line and "text#" not in line.replace("file_text#", "") for line in texts), texts


def test_threshold_comes_after_limit(spark):
    c = spark.createDataFrame([("c", "", f"h{i}", [1.0, float(i)], "s", 0, 1, "py", "n") for i in range(6)],
        "collection_name string, branch string, chunk_hash string, embedding array<float>, source string, start_line int, end_line int, language string, node_type string")
    q = spark.createDataFrame([(1, "c", "", [1.0, 0.0])], "query_id bigint, collection_name string, branch string, query_vec array<float>")
    got = search.search(c, q, k=3, threshold=0.6).orderBy("hit_no").collect()
    assert [r.chunk_hash for r in got] == ["h0", "h1"]


def test_context_budget(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(["aaaa", "bbbbb", "ccc", "dd"], start=1)], "query_id int, file_no int, file_content string")
    got = contexts.fit_budget(df, F.lit(8)).orderBy("file_no").collect()
    assert [r.fit for r in got] == ["full", "partial", "skipped", "skipped"]
    assert got[1].shown == "bbbb\n... (file truncated due to token limit)" and got[2].shown == "ccc"
    text = contexts.files_section(contexts.fit_budget(df, F.lit(8))).first().files_section
    assert text == "aaaa\n\nbbbb\n... (file truncated due to token limit)\n\n--- Files skipped due to token limit ---\nccc\ndd"


def test_line_ranges_and_sections(spark):
    text = "\n".join(f"l{i}" for i in range(200))
    hits = [(1, "c", "f.py", 0.9 - n / 10, n + 1, s, e, "py", f"fn{n % 2}", f"h{n}", f"chunk{n}") for n, (s, e) in enumerate([(10, 12), (40, 41), (120, 125), (-1, -1)])]
    df = spark.createDataFrame(hits, "query_id int, collection_name string, source string, similarity double, hit_no int, start_line int, end_line int, language string, node_name string, chunk_hash string, content string")
    files = spark.createDataFrame([("f.py", text)], "source string, file_text string")
    grouped = contexts.with_sections(contexts.with_file_text(contexts.group_hits(df), files, ["source"]))
    assert [tuple(s) for s in grouped.first().sections] == [(0, 61), (99, 145)]
    m = contexts.file_matches(df, files, max_chars=700).first()
    lines = text.split("\n")
    body = "\n".join(lines[0:61]) + "\n\n... (content omitted) ...\n\n" + "\n".join(lines[99:145])
    assert m.truncated and m.file_content == "[Archivo: f.py | Funciones: fn0, fn1]\n" + body
    m = contexts.file_matches(df, files, max_chars=100).first()
    assert m.file_content.endswith(body[:100] + "\n... (truncated)")
    gone = contexts.file_matches(df, files.filter("source = 'none'")).first()
    assert not gone.found and gone.file_content.split("\n", 1)[1] == "chunk0\nchunk1\nchunk2\nchunk3"


def test_file_pieces_of_many_queries(spark):
    """Any overlap of spans, short, missing and long files, long lines, and spans behind the end, against plain slices."""
    rng = random.Random(3)
    texts = {f"f{n}": "\n".join("x" * rng.randrange(9) + str(i) for i in range(size)) for n, size in enumerate((3, 90, 400, 900))}
    texts |= {"wide": "\n".join("y" * 700 for _ in range(90)), "one": "z" * 3000}
    hits = []
    for q in range(25):
        for n, source in enumerate(rng.choices([*texts, "none"], k=8)):
            start = rng.choice([-1, rng.randrange(1, 1000), rng.randrange(1, 60)])
            end = start if start < 0 else start + rng.randrange(40)
            hits.append((q, "c", source, 0.5, n + 1, start, end, "py", None, f"{q}-{n}", "chunk\n" * rng.choice([1, 150])))
    df = spark.createDataFrame(hits, "query_id int, collection_name string, source string, similarity double, hit_no int, start_line int, end_line int, language string, node_name string, chunk_hash string, content string")
    files = spark.createDataFrame(list(texts.items()), "source string, file_text string")

    def plain(q, source, most):
        own = sorted((h for h in hits if h[0] == q and h[2] == source), key=lambda h: h[4])
        text = texts.get(source, "\n".join(h[10] for h in own))
        if len(text) <= most:
            return text
        lines = text.split("\n")
        kept = sorted({i for h in own for i in range(max(0, h[5] - 21), min(len(lines), h[6] + 20))})
        starts = [i for n, i in enumerate(kept) if not n or kept[n - 1] != i - 1]
        parts = ["\n".join(lines[i] for i in kept if a <= i < b) for a, b in zip(starts, [*starts[1:], len(lines)])]
        body = "\n\n... (content omitted) ...\n\n".join(parts) if kept else text
        return body if len(body) <= most else body[:most] + "\n... (truncated)"

    for most in (500, 1500):
        got = {(r.query_id, r.source): r for r in contexts.file_matches(df, files, max_chars=most).collect()}
        assert set(got) == {(h[0], h[2]) for h in hits}
        for (q, source), r in got.items():
            assert r.file_content.split("\n", 1)[1] == plain(q, source, most), (q, source, most)
            assert r.found == (source in texts)


def test_requests_by_their_fields(spark):
    t = [(i, i % 2, f"r{i % 3}", None if i % 5 == 0 else f"a{i % 2}", ("done", "failed")[i % 4 == 0]) for i in range(40)]
    asked = [(n, u, r, a, s) for n, (u, r, a, s) in enumerate(itertools.product((0, 1), ("", None, "r1"), ("", "a1"), (None, "failed")))]
    got = tasks.filter_for_requests(
        spark.createDataFrame(t, "id int, user_id int, repository_full_name string, pr_author string, status string"),
        spark.createDataFrame(asked, "request_id int, user_id int, repository string, author string, status string"),
    )
    want = {(n, x[0]) for n, u, *fields in asked for x in t if x[1] == u and all(not f or f == v for f, v in zip(fields, x[2:]))}
    assert sorted((r.request_id, r.id) for r in got.collect()) == sorted(want)


def test_prompt_layout(spark):
    r = spark.createDataFrame([(1, "r", "u", "Be good"), (2, "r", "u", "No files")], "query_id int, repo string, url string, rule_text string")
    maps = spark.createDataFrame([("r", "MAP")], "repo string, map_text string")
    m = spark.createDataFrame([(1, "a", 0.5, 1, "A"), (1, "b", 0.9, 2, "B")], "query_id int, source string, relevance_score double, first_hit int, file_content string")
    got = {x.query_id: x.prompt for x in contexts.prompts(r, maps, m).collect()}
    assert got[1] == "Repository: u\n\n## Repository Map\nMAP\n\n## Relevant code files\nB\n\nA\n\n## Rule to evaluate\nBe good"
    assert "## Relevant code files\n(No relevant files found)\n\n" in got[2]


def test_rolling_minute(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [t0 + dt.timedelta(microseconds=u) for u in (1_000_000, 60_999_999, 61_000_000)]
    df = spark.createDataFrame([("c", t) for t in at], "caller string, ts timestamp")
    got = activity.rolling_calls(df, 1).orderBy("ts").collect()
    assert [(r.last_minute, r.over_limit) for r in got] == [(1, False), (2, True), (2, True)]
    assert not any(r.over_limit for r in activity.rolling_calls(df, 0).collect())


def test_null_order_of_pages(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, progress int")
    desc = tasks.page(df, tasks.sort_key("progress", "DESC", tasks.TASK_SORT, "created_at"), 1, 3).collect()
    asc = tasks.page(df, tasks.sort_key("progress", "up", tasks.TASK_SORT, "created_at"), 1, 3).collect()
    assert [r.id for r in desc] == [2, 3, 1] and [r.id for r in asc] == [1, 3, 2]
    assert tasks.page(df, tasks.sort_key("progress", "asc", tasks.TASK_SORT, "x"), 5, 3).count() == 0


def test_total_past_the_last_page(spark):
    r = spark.createDataFrame([(i, 1, "o/r", i) for i in range(3)], "id int, user_id int, repository_full_name string, position int")
    page = tasks.page_per_group(r, ["user_id", "repository_full_name"], F.col("position").asc(), 5, 2)
    assert page.count() == 0
    first = tasks.page_per_group(r, ["user_id", "repository_full_name"], F.col("position").asc(), 1, 2)
    assert [x.total for x in rules.with_total(first, r).collect()] == [3, 3]


def test_rule_import(spark):
    import json

    bodies = [
        (1, 7, json.dumps({"rules": ["", " a ", "x" * 501, "b"]})),
        (2, 10, json.dumps({"rules": ["a"]})),
        (3, 0, json.dumps({"rules": []})),
        (4, 0, "no json"),
        (5, 0, json.dumps({"other": 1})),
        (6, 0, json.dumps({"rules": ["c", "d"]})),
    ]
    df = spark.createDataFrame(bodies, "request_id int, existing int, body string")
    got = {r.request_id: r for r in rules.import_rules(df).collect()}
    assert (got[1].state, got[1].added, got[1].skipped, got[1].texts) == ("ok", 2, 1, ["a", "x" * 500])
    assert (got[2].state, got[2].added) == ("full", 0)
    assert [got[i].state for i in (3, 4, 5)] == ["invalid"] * 3
    assert (got[6].state, got[6].added, got[6].skipped) == ("ok", 2, 0)


def test_rule_files_round_trip(spark, data, tmp_path):
    exported = rules.export_rules(views.rules(spark, data), 30)
    rule_files.write_exports(exported, str(tmp_path / "out"))
    text = rule_files.read_exports(spark, str(tmp_path / "out"))
    assert rows(text) == rows(exported.select("user_id", "repository_full_name", "part", "body"))
    back = text.select(F.explode(F.from_json("body", "rules array<string>")["rules"]).alias("t"))
    assert rows(back) == rows(views.rules(spark, data).select("rule_text"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('{"rules":\n ["x"]}')
    assert rule_files.read_rule_files(spark, str(tmp_path / "one")).collect()[0].body == '{"rules":\n ["x"]}'


def test_exports_of_similar_names_stay_apart(spark, tmp_path):
    lists = spark.createDataFrame([(1, "o/r", 0, "a"), (2, "o/r", 0, "b"), (1, "o_r", 0, "c"), (1, "o/r", 1, "d")], rule_files.EXPORT)
    rule_files.write_exports(lists, str(tmp_path / "out"))
    assert rows(rule_files.read_exports(spark, str(tmp_path / "out"))) == rows(lists)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("folder=")]) == 3


def test_long_rule_lists_come_in_parts(spark):
    r = spark.createDataFrame([(i, 1, "o/r", f"t{i}", i, True) for i in range(1500)],
        "id int, user_id int, repository_full_name string, rule_text string, position int, enabled boolean")
    got = rules.rule_lists(r).orderBy("part").collect()
    assert [len(g.rules) for g in got] == [1000, 500] and [t for g in got for t in g.rules] == [f"t{i}" for i in range(1500)]
    half = rules.rule_lists(r.withColumn("enabled", F.col("id") % 2 == 0)).collect()
    assert [(g.part, g.rules) for g in half] == [(0, [f"t{i}" for i in range(0, 1500, 2)])]
    assert [(g.part, g.rules) for g in rules.rule_lists(r.withColumn("enabled", F.lit(False))).collect()] == [(0, [])]
    assert [e.rule_idx for e in rules.enabled_rules(r).orderBy("id").collect()] == list(range(1500))


def admission_case(spark, cap, events):
    """One pull request of a repository with one rule and the given cap; events of the latest time first."""
    r = spark.createDataFrame([(1, 7, "o/r", "rule", 0, True, dt.datetime(2020, 1, 1))],
        "id int, user_id int, repository_full_name string, rule_text string, position int, enabled boolean, created_at timestamp")
    u = spark.createDataFrame([(7, "me")], "user_id int, login string")
    c = spark.createDataFrame([(7, "o/r", cap, 0.5, True, True, 5, None)],
        "user_id int, repository_full_name string, max_evaluations_per_pr int, approval_threshold double, enable_cross_check boolean,"
        " pr_evaluation_enabled boolean, max_chunks_per_rule int, llm_model string")
    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "opened", "o/r", 3) for i in reversed(range(events))],
        "event_id bigint, ts timestamp, action string, repository_full_name string, pr_number bigint")
    return e, (r, u, c, spark.createDataFrame([], "repository_full_name string, pr_number bigint, n bigint"))


def test_caps_above_twenty(spark):
    from rulelens.operators import admission, tasks

    e, args = admission_case(spark, 25, 30)
    got = admission.admit(e, *args).filter("admitted").collect()
    assert sorted((g.event_id, g.eval_no) for g in got) == [(i, i + 1) for i in range(25)]
    t = e.selectExpr("event_id as id", "repository_full_name", "pr_number", "ts as created_at")
    assert tasks.evaluation_numbers(t, F.lit(25)).count() == 25


def test_files_that_fail_to_open(spark, tmp_path):
    (tmp_path / "r" / "_x" / ".y").mkdir(parents=True)
    (tmp_path / "r" / "a.py").write_text("1")
    (tmp_path / "r" / "_x" / ".y" / "__init__.py").write_text("2")
    listed = file_source.list_files(spark, str(tmp_path))
    assert rows(listed.select("file_path")) == [("_x/.y/__init__.py",), ("a.py",)]
    more = listed.unionByName(spark.createDataFrame([("r", "gone.py", 1)], "repo string, file_path string, length bigint"))
    assert file_source.read_files(listed, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="gone.py"):
        file_source.read_files(more, str(tmp_path)).count()
    missing = spark.createDataFrame([("r",), ("no-such-repo",)], "repo string")
    with pytest.raises(Exception, match="no-such-repo"):
        file_source.list_files(spark, str(tmp_path), missing).count()


def test_update_keeps_vectors_and_writes_only_what_changed(spark, data, tmp_path):
    old, current = views.stored_files(spark, data), views.current_files(spark, data)
    plain = indexing.unique_chunks(indexing.to_chunks(old, chunk_windows, "m", "s"))
    marked = search.embed_texts(plain, "content", embed=lambda texts: np.ones((len(texts), 4))).cache()
    update = indexing.update_index(current, indexing.file_hashes(old), marked, chunk_windows, "m", "s", embed=lambda texts: np.full((len(texts), 4), 2.0))
    assert update.chunks.filter("embedding is null").count() == 0
    new = {tuple(r) for r in update.added.select("source", "chunk_hash").collect()}
    for r in update.chunks.select("source", "chunk_hash", "embedding").collect():
        assert r.embedding == [2.0 if (r.source, r.chunk_hash) in new else 1.0] * 4
    path = str(tmp_path / "index")
    vector_table.write_partitions(marked, path, rows_per_file=20)
    before = {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    vector_table.apply(spark, path, update.removed, update.added)
    columns = ["collection_name", "branch", "source", "chunk_hash", "embedding"]
    assert rows(vector_table.read(spark, path).select(*columns)) == rows(update.chunks.select(*columns))
    vector_table.apply(spark, path, update.removed.limit(0), update.added.limit(0))
    repo = marked.first().repo_name
    one = update.chunks.filter(F.col("repo_name") == repo).select("collection_name", "branch", "source").distinct()
    kept = {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    vector_table.apply(spark, path, one, update.added.limit(0))
    after = {str(p) for p in (tmp_path / "index").rglob("*.parquet")}
    assert before - kept and kept & after and kept - after
    assert vector_table.read(spark, path).filter(F.col("repo_name") == repo).count() == 0


def test_branch_layer_is_replaced(spark):
    def files(*named):
        return spark.createDataFrame([("r", p, t) for p, t in named], "repo string, file_path string, content string")

    base = indexing.unique_chunks(indexing.to_chunks(files(("a.py", "one"), ("b.py", "two")), chunk_windows, "m", "s"))
    hashes = indexing.file_hashes(files(("a.py", "one"), ("b.py", "two")))
    first = indexing.update_index(files(("a.py", "one"), ("b.py", "old")), hashes, base, chunk_windows, "m", "s", branch="pr")
    second = indexing.update_index(files(("a.py", "one"), ("b.py", "new")), first.hashes, first.chunks, chunk_windows, "m", "s", branch="pr")
    got = {(r.branch, r.source, r.content) for r in second.chunks.collect()}
    assert got == {("", "a.py", "one"), ("", "b.py", "two"), ("pr", "b.py", "new")} and second.chunks.count() == 3
    gone = indexing.remove_branch(second.chunks, files(("a.py", "")), "m", "s", "pr")
    assert rows(gone.select("branch", "source")) == [("pr", "b.py")]


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    def seconds(n):
        f = spark.createDataFrame([("r", "x.txt", "line of some words é😀\n" * (n // 22))], "repo string, file_path string, content string").cache()
        f.count()
        start = time.monotonic()
        count, chars = chunk_windows(f, 1000, 100).agg(F.count("*"), F.max("end_line")).first()
        assert count == -(-(22 * (n // 22) - 100) // 900) and chars == n // 22 + 1
        return time.monotonic() - start

    seconds(500_000)
    assert seconds(8_000_000) < 40 * max(seconds(500_000), 0.2)


def test_diff_partitions_and_update_is_stable(spark, data):
    stored, current = views.stored_files(spark, data), views.current_files(spark, data)
    before = indexing.unique_chunks(indexing.to_chunks(stored, chunk_windows, "m", "s"))
    update = indexing.update_index(current, indexing.file_hashes(stored), before, chunk_windows, "m", "s")
    full = indexing.unique_chunks(indexing.to_chunks(current, chunk_windows, "m", "s"))
    columns = ["collection_name", "source", "chunk_hash", "start_line"]
    assert rows(update.chunks.select(*columns)) == rows(full.select(*columns))
    again = indexing.update_index(current, update.hashes, update.chunks, chunk_windows, "m", "s")
    assert again.added.count() == 0
    assert {r.change for r in again.changes.select("change").distinct().collect()} == {"unchanged"}
    paths = set(map(tuple, update.changes.select("repo", "file_path").collect()))
    assert len(paths) == update.changes.count()


def test_lost_main_layer_is_rebuilt(spark, data):
    current = views.current_files(spark, data)
    empty = indexing.unique_chunks(indexing.to_chunks(current.limit(0), chunk_windows, "m", "s"))
    update = indexing.update_index(current, indexing.file_hashes(current), empty, chunk_windows, "m", "s", branch="pr")
    assert update.chunks.filter("branch <> ''").count() == 0
    assert update.chunks.select("source").distinct().count() == current.filter("length(content) > 0").count()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, version int")
    once = indexing.upsert(old, new, ["k"], "version")
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(indexing.upsert(once, new, ["k"], "version")) == rows(once)


def test_deletes(spark):
    c = spark.createDataFrame([("c1", "", "f", "1"), ("c1", "pr", "f", "2"), ("c2", "", "f", "3")], "collection_name string, branch string, source string, chunk_hash string")
    gone = spark.createDataFrame([("c1", "f")], "collection_name string, source string")
    assert {r.chunk_hash for r in indexing.delete_by_sources(c, gone).collect()} == {"2", "3"}
    assert {r.chunk_hash for r in indexing.delete_branch(c, gone, "pr").collect()} == {"1", "3"}
    assert {r.chunk_hash for r in indexing.delete_collections(c, gone).collect()} == {"3"}


def test_reconcile(spark):
    df = spark.createDataFrame(
        [("pass", "pass", None), ("pass", "fail", "partial"), ("pass", "fail", None), ("odd", "fail", None), ("odd", "odd2", None)],
        "primary_verdict string, secondary_verdict string, adjudicated_verdict string")
    got = [(r.final_verdict, r.agreement, r.discriminator_used) for r in evaluation.reconcile(df).collect()]
    assert got == [("pass", True, False), ("partial", False, True), ("fail", False, False), ("odd", False, False), ("odd", False, False)]


def test_scores_and_empty_task(spark):
    t = spark.createDataFrame([(1,), (2,)], "task_id int")
    e = spark.createDataFrame([(1, "pass"), (1, "partial"), (1, "fail"), (1, None)], "task_id int, verdict string")
    got = {r.task_id: (r.score, r.ui_score) for r in evaluation.scores(t, e).collect()}
    assert got == {1: (0.375, 0.375), 2: (0.0, None)}


def test_report_body(spark):
    t = spark.createDataFrame([(1, 2, 0.5, 0.8), (2, 1, 0.0, 0.8)], "task_id int, eval_no int, score double, approval_threshold double")
    t = t.withColumn("approved", F.col("score") >= F.col("approval_threshold"))
    e = spark.createDataFrame(
        [(1, 0, "P", "pass", "fine. x"), (1, 1, "F", "fail", "bad thing. more"), (1, 2, "H", "partial", ""), (1, 3, "U", None, "")],
        "task_id int, rule_idx int, rule string, final_verdict string, explanation string")
    body = {r.task_id: r.body for r in reports.report_bodies(t, reports.report_lines(e)).collect()}

    def entry(n, rule, text, tag):
        return [tag, f"<summary>{n}. {rule}</summary>", "", text, "", "</details>", ""]

    want = ["## Informe de evaluación #2", "", "**Resultado: NO APROBADO** — 50% de normas superadas (mínimo: 80%)", "", "---"]
    want += ["", "#### No cumplido", "", *entry(1, "F", "bad thing", "<details open>"), *entry(2, "U", "Sin observaciones.", "<details open>"), "---"]
    want += ["", "#### Pendiente de revisión", "", *entry(3, "H", "Sin observaciones.", "<details>"), "---"]
    want += ["", "#### Superado", "", *entry(4, "P", "Sin observaciones.", "<details>"), "---"]
    want += ["_Generado automáticamente_"]
    assert body[1] == "\n".join(want)
    assert body[2].endswith("---\n_Generado automáticamente_")
    parts = reports.report_bodies(t, reports.report_lines(e), part_lines=2).filter("task_id = 1").orderBy("part").collect()
    assert len(parts) == 2 and "\n".join(p.body for p in parts) == body[1]


def test_results_parse(spark):
    raw = [(1, None), (2, ""), (3, '{"validations":[{"rule":"r"}],"llm_model":"m"}'), (4, "{}")]
    got = {r.id: r.parsed for r in results.parse(spark.createDataFrame(raw, "id int, result string")).collect()}
    assert got[1] is None and got[2] is None and got[4].validations == []
    assert got[3].validations[0].related_files == [] and got[3].validations[0].evaluation is None
    assert (got[3].llm_model, got[3].embedding_model, got[3].processing_time_seconds) == ("m", "", 0.0)


def test_resume_ignores_changed_rules(spark):
    todo = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "task_id int, rule_idx int, rule string")
    saved = spark.createDataFrame([(1, 0, "a", None, None), (1, 1, "old", "pass", "x")], "task_id int, rule_idx int, rule string, verdict string, explanation string")
    got = {r.rule_idx: (r.restored, r.verdict, r.explanation) for r in evaluation.restore(todo, saved).collect()}
    assert got == {0: (True, "fail", ""), 1: (False, None, None), 2: (False, None, None)}
    assert [r.rule_idx for r in evaluation.remaining(todo, saved).orderBy("rule_idx").collect()] == [1, 2]


def test_declarations(spark):
    cases = {
        "a.py": ("class A(B):\n    x = 1\n\n    async def m(self, a: int):\n        def inner():\n            pass\n        return 1\n\n@dec\ndef f(x):\n    if x:\n        y()\n\nz = 1\n",
            [("class", "A", 1, 7), ("method", "m", 4, 7), ("function", "inner", 5, 6), ("function", "f", 10, 12)]),
        "a.ts": ("export class K {\n  run(a) {\n    if (a) {\n      b();\n    }\n  }\n}\nexport const g = async (x) => {\n  return x;\n};\nfunction h() {}\n",
            [("class", "K", 1, 7), ("method", "run", 2, 6), ("function", "g", 8, 10), ("function", "h", 11, 11)]),
        "a.rs": ("pub struct S {\n    a: u8,\n}\nimpl Show for S {\n    pub fn go(&self) {\n    }\n}\nenum E {\n}\n",
            [("struct", "S", 1, 3), ("impl", "S", 4, 7), ("method", "go", 5, 6), ("enum", "E", 8, 9)]),
        "a.cs": ("namespace N\n{\n    public class C\n    {\n        public int M(int a)\n        {\n            return a;\n        }\n    }\n}\n",
            [("class", "C", 3, 9), ("method", "M", 5, 8)]),
    }
    df = spark.createDataFrame([("r", p, t) for p, (t, _) in cases.items()], "repo string, file_path string, content string")
    got = {}
    for r in declarations.declarations(df).orderBy("file_path", "start_line").collect():
        got.setdefault(r.file_path, []).append((r.kind, r.name, r.start_line, r.end_line))
    assert got == {p: w for p, (_, w) in cases.items()}
    syms = {(r.file_path, r.name): (r.depth, r.signature) for r in declarations.symbols(df).collect()}
    assert syms[("a.py", "m")] == (1, "(self, a: int)") and ("a.py", "inner") not in syms and syms[("a.py", "A")] == (0, "")


def plain_tree(paths):
    tree = {}
    for p in paths:
        node = tree
        *dirs, name = p.split("/")
        for d in dirs:
            node = node.setdefault(d, {})
        node[name] = None

    def show(node, prefix):
        out = []
        names = sorted(node)
        for i, n in enumerate(names):
            last = i == len(names) - 1
            out.append(prefix + ("└── " if last else "├── ") + n + ("/" if node[n] is not None else ""))
            if node[n] is not None:
                out += show(node[n], prefix + ("    " if last else "│   "))
        return out

    return show(tree, "")


def test_repository_map(spark):
    paths = ["b/x.py", "a/z.py", "a/b/c.go", "README.md", "a-b/q.ts", "top.js", "node_modules/n.js", ".hid/a.py", ".env.example", "a/note.txt", "Dockerfile"]
    kept = [p for p in paths if p not in ("node_modules/n.js", ".hid/a.py", "a/note.txt", ".env.example")]
    files = spark.createDataFrame([("r", p, 10) for p in paths], "repo string, file_path string, length int")
    syms = spark.createDataFrame([("r", "b/x.py", 1, "class", "K", 0, ""), ("r", "b/x.py", 2, "method", "m", 1, "(self)"), ("r", "a/z.py", 3, "function", "f", 0, "(x)")],
        "repo string, file_path string, line int, kind string, name string, depth int, signature string")
    want = ["# Repository Map: r", "", "## Directory Structure", "```text", *plain_tree(kept), "```", "", "## Code Symbols", "",
            "### a/z.py", "- function **f**(x)", "", "### b/x.py", "- class **K**", "  - method **m**(self)", ""]
    lines = repomap.map_lines(files, syms)
    whole = repomap.map_parts(lines).first().map_text
    assert whole == "\n".join(want)
    assert repomap.map_heads(lines, 10_000).first().map_text == whole
    head = repomap.map_heads(lines, 60).first().map_text
    assert whole.startswith(head) and len(head) >= 60
    parts = repomap.map_parts(lines, 5).orderBy("part").collect()
    assert "\n".join(p.map_text for p in parts) == whole and len(parts) == -(-len(want) // 5)


def test_file_scan(spark, tmp_path):
    tree = {
        "repo1/src/a.py": b"print(1)\n", "repo1/node_modules/a.js": b"x", "repo1/x/node_modules/a.js": b"x", "repo1/data/b.json": b"{}",
        "repo1/Dockerfile": b"FROM x", "repo1/a.PY": b"x", "repo1/big.py": b"#" * 1_000_001, "repo1/edge.py": b"#" * 1_000_000,
        "repo1/bad.txt": b"ok \xff\xfe end", "repo2/sp ace+1%.go": b"package x", "repo2/package-lock.json": b"{}", "repo2/.hidden/k.rb": b"1",
        "repo2/pkg/__init__.py": b"", "repo2/_private.js": b"1",
    }
    for name, body in tree.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {(r.repo, r.file_path): r for r in file_source.scan_code(spark, str(tmp_path / "root")).collect()}
    assert set(got) == {("repo1", "src/a.py"), ("repo1", "Dockerfile"), ("repo1", "edge.py"), ("repo1", "bad.txt"), ("repo2", "sp ace+1%.go"), ("repo2", ".hidden/k.rb"), ("repo2", "pkg/__init__.py"), ("repo2", "_private.js")}
    assert got[("repo1", "src/a.py")].language == "python" and "\ufffd" in got[("repo1", "bad.txt")].content
    old = {(r.repo, r.file_path) for r in file_source.scan_code(spark, str(tmp_path / "root"), below_root_only=True).collect()}
    assert ("repo1", "node_modules/a.js") in old and ("repo2", "package-lock.json") in old and ("repo1", "x/node_modules/a.js") not in old
    tree_ = {(r.repo, r.file_path) for r in file_source.scan_tree(spark, str(tmp_path / "root")).collect()}
    some = spark.createDataFrame([("repo2",)], "repo string")
    assert {r.repo for r in file_source.scan_code(spark, "file://" + str(tmp_path / "root"), some).collect()} == {"repo2"}
    assert ("repo2", ".hidden/k.rb") not in tree_ and ("repo2", "pkg/__init__.py") in tree_ and ("repo1", "Dockerfile") in tree_


def test_vector_table(spark, data, tmp_path):
    chunks = views.chunk_vectors(spark, data)
    path = str(tmp_path / "v")
    vector_table.write_partitions(chunks, path)
    assert vector_table.read(spark, path).count() == chunks.count()
    assert vector_table.read(spark, path, ["c2"]).count() == chunks.filter("collection_name = 'c2'").count()
    one = chunks.filter("collection_name = 'c2' and branch = ''")
    assert rows(vector_table.read(spark, path, ["c2"], [""]).select("chunk_hash")) == rows(one.select("chunk_hash"))
    plan = vector_table.read(spark, path, ["c2"], [""])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_outcomes(spark):
    at = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(1, "running", 10, "p", None, None, "[1]"), (2, "running", 20, "p", None, None, "[2]")],
        "id int, status string, progress int, progress_message string, error string, completed_at timestamp, partial_result string")
    t = t.withColumn("result", F.lit(None).cast("string"))
    f = spark.createDataFrame([(1, "{}", None, at), (2, None, "boom", at)], "task_id int, result string, error string, at timestamp")
    got = {r.id: r for r in results.current_state(t, results.outcomes(f, F.col("at"))).collect()}
    assert (got[1].status, got[1].progress, got[1].partial_result, got[1].result) == ("completed", 100, None, "{}")
    assert (got[2].status, got[2].progress, got[2].error, got[2].partial_result) == ("failed", 20, "boom", "[2]")


def test_whole_check(spark, data):
    check = catalog.whole_check(spark, data)
    assert check.evaluated.count() == rules.enabled_rules(views.rules(spark, data)).count() > 100
    assert {r.verdict for r in check.evaluated.collect()} <= {"pass", "partial", "fail"}
    assert all(0 <= r.score <= 1 for r in check.scored.collect())
    bodies = validate.report(check).collect()
    assert all(b.body.startswith("## Informe de evaluación #1") for b in bodies) and len(bodies) == 2


def test_plans(spark, data):
    def plan(name):
        return catalog.QUERIES[name](spark, data)._jdf.queryExecution().toString()

    for name in ("t4_latest_tasks", "t7_rule_slots"):
        assert "WindowGroupLimit" in plan(name), name
    for name in ("j5_contributor_results", "j7_visible_tasks", "j8_config_in_force", "j9_snapshot_diff", "f1_task_filter",
                 "r1_admission", "r7_routing", "r8_installations", "a8_approval", "a14_activity_month", "w8_rolling_calls"):
        assert "CartesianProduct" not in plan(name) and "BroadcastNestedLoopJoin" not in plan(name), name
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan("u1_grants")


def test_cross_check_mode_resume_and_unavailable_answers(spark, data):
    prompts = spark.createDataFrame([(i, f"rule {i}", f"p{i}") for i in range(6)], "query_id bigint, rule_text string, prompt string")

    def says(*verdicts):
        return lambda texts: [None if verdicts[int(t[1:])] is None else '{"verdict": "%s"}' % verdicts[int(t[1:])] for t in texts]

    def third(texts):
        return [None if "rule 3" in t else '{"verdict": "partial", "explanation": "third"}' for t in texts]

    got = {
        r.query_id: (r.final_verdict, r.agreement, r.discriminator_used)
        for r in validate.evaluate_pairs(
            prompts, says("pass", "pass", "fail", "pass", "fail", "pass"), says("pass", "fail", "fail", "partial", "pass", "pass"), third
        ).collect()
    }
    assert got == {
        0: ("pass", True, False), 1: ("partial", False, True), 2: ("fail", True, False), 3: ("partial", False, False),
        4: ("partial", False, True), 5: ("pass", True, False),
    }
    answers = evaluation.parse_answers(evaluation.ask(prompts.withColumn("task_id", F.col("query_id") % 2), says("pass", None, "pass", "fail", "fail", None), ["query_id", "task_id"]), "x")
    assert {r.query_id for r in answers.filter("verdict is null").collect()} == {1, 5}
    assert [(r.task_id, r.missing) for r in evaluation.unfinished(answers).collect()] == [(1, 2)]


def test_configuration_of_the_repository(spark, data):
    files = views.current_files(spark, data)
    chunks = validate.index_files(files, "m", "s")
    asked = rules.enabled_rules(views.rules(spark, data)).selectExpr(
        "id as query_id", "repo_no as task_id", "rule_idx", "concat('src', repo_no) as repo", "'u' as url", "rule_text")
    repos = sorted({r.repo for r in asked.select("repo").collect()})
    configs = spark.createDataFrame([(repos[0], 2, 0.0)], "repo string, max_chunks_per_rule int, approval_threshold double")
    check = validate.check_rules(files, chunks, asked, catalog.offline_evaluator, "m", "s", k=4, threshold=0.0, approval=1.0, configs=configs)
    most = {r.repo: r.n for r in check.hits.join(asked.select("query_id", "repo"), "query_id").groupBy("repo", "query_id").count().groupBy("repo").agg(F.max("count").alias("n")).collect()}
    assert most[repos[0]] == 2 and all(most[r] <= 4 for r in repos) and most[repos[1]] > 2
    thresholds = {r.task_id: r.approval_threshold for r in check.scored.collect()}
    assert sorted(thresholds.values()) == [0.0] + [1.0] * (len(repos) - 1)
    numbers = spark.createDataFrame([(t, 7) for t in list(thresholds)[:1]], "task_id bigint, eval_no int")
    bodies = {r.task_id: r.body for r in validate.report(check, numbers).collect()}
    assert sorted("#7" in b.split("\n")[0] for b in bodies.values()) == [False] * (len(bodies) - 1) + [True]


def test_resumed_check_asks_only_the_rest(spark, data):
    from rulelens.operators import rules as r_

    files = views.current_files(spark, data)
    chunks = validate.index_files(files, "m", "s")
    asked = r_.within_slots(views.rules(spark, data)).selectExpr(
        "id as query_id", "repo_no as task_id", "slot - 1 as rule_idx", "concat('src', repo_no) as repo", "'u' as url", "rule_text")
    saved = asked.filter("rule_idx < 4").selectExpr("task_id", "rule_idx", "rule_text as rule", "'pass' as verdict", "'kept' as explanation")
    check = validate.check_rules(files, chunks, asked, catalog.offline_evaluator, "m", "s", threshold=0.0, saved=saved)
    assert check.prompts.count() == asked.filter("rule_idx >= 4").count()
    done = check.evaluated.collect()
    assert len(done) == asked.count() and {d.explanation for d in done if d.rule_idx < 4} == {"kept"}


def test_branch_per_query(spark):
    c = spark.createDataFrame([("c", b, f"h{b}{i}", [1.0, float(i)], f"s{i}", 0, 1, "py", "n") for b in ("", "p1", "p2") for i in range(2)],
        "collection_name string, branch string, chunk_hash string, embedding array<float>, source string, start_line int, end_line int, language string, node_type string")
    q = spark.createDataFrame([(1, "c", "p1", [1.0, 0.0]), (2, "c", "p2", [1.0, 0.0]), (3, "c", None, [1.0, 0.0])], "query_id bigint, collection_name string, pr_branch string, query_vec array<float>")
    got = {(r.query_id, r.source): r.branch for r in search.search(c, q, k=5, threshold=0.0).collect()}
    assert got == {(1, "s0"): "p1", (1, "s1"): "p1", (2, "s0"): "p2", (2, "s1"): "p2", (3, "s0"): "", (3, "s1"): ""}


def test_task_detail_holds_the_whole_rule_list(spark, data, monkeypatch):
    one = views.tasks(spark, data).filter("user_id is not null").limit(1).localCheckpoint()
    own = one.select("user_id", "repository_full_name").first()
    n = 2 * rules.RULE_PART + 500
    listed = spark.range(n).select(
        F.col("id"), F.lit(own["user_id"]).alias("user_id"), F.lit(own["repository_full_name"]).alias("repository_full_name"),
        F.format_string("rule %s", "id").alias("rule_text"), (n - F.col("id")).alias("position"), F.lit(None).cast("boolean").alias("enabled"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("created_at"),
    )
    monkeypatch.setattr(catalog.views, "tasks", lambda *_: one)
    monkeypatch.setattr(catalog.views, "rules", lambda *_: listed)
    (got,) = catalog.QUERIES["f8_task_detail"](spark, data).collect()
    assert got["rules"] == "|".join(f"rule {k}" for k in reversed(range(n)))
