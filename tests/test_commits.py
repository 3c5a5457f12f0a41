"""Index commits that break off, the answer ledger, and models per repository."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from rulelens.functions import vectors
from rulelens.functions.text import content_hash
from rulelens.operators import chunking, indexing, search
from rulelens.plans import answers, index_commit
from rulelens.session import stored
from rulelens.sources import answer_ledger, hash_log, vector_table

FILES = "repo string, file_path string, content string"
EMBED = vectors.hash_embedder(8)


def files_of(spark, **texts):
    return spark.createDataFrame([("r" + name[0], f"{name}.py", t) for name, t in texts.items()], FILES)


@pytest.fixture()
def store(spark, tmp_path):
    """(folder of the chunk table, folder of the hash log, function that commits)."""
    table, log = str(tmp_path / "chunks"), str(tmp_path / "hashes")
    nothing = indexing.unique_chunks(indexing.to_chunks(files_of(spark, a="x").limit(0), chunking.chunk_windows, "m", "s"))
    index_commit.create(search.embed_texts(nothing, "content", embed=EMBED), table)

    def commit(files, branch=None):
        return index_commit.commit(spark, files, table, log, "m", "s", lambda f: chunking.chunk_windows(f, 20, 5), branch, EMBED)

    return table, log, commit


def held(spark, table, branch=""):
    got = {}
    for r in vector_table.read(spark, table).filter(F.col("branch") == branch).collect():
        assert r["embedding"]
        got.setdefault((r["repo_name"], r["source"]), set()).add(r["content"])
    return got


def promise(spark, table, log, texts):
    """Every hash names a text whose chunks are in the table, all of them and no others."""
    known = {t: spark.createDataFrame([(t,)], "t string").select(content_hash(F.col("t"))).first()[0] for t in texts}
    by_hash = {h: t for t, h in known.items()}
    chunks = held(spark, table)
    named = {}
    for r in hash_log.read(spark, log).collect():
        text = by_hash[r["content_hash"]]
        one = chunking.chunk_windows(spark.createDataFrame([("r", "f", text)], FILES), 20, 5)
        assert chunks.get((r["repo"], r["file_path"]), set()) == {c["content"] for c in one.collect()}
        named[r["repo"], r["file_path"]] = text
    return named


TEXT = "line one\nline two\nline three\n"


def test_commits(spark, store):
    table, log, commit = store
    first = files_of(spark, a1="alpha\n" * 9, a2=TEXT, b1="beta\n" * 9, b2="")
    commit(first)
    assert promise(spark, table, log, ["alpha\n" * 9, TEXT, "beta\n" * 9, ""]).keys() == {("ra", "a1.py"), ("ra", "a2.py"), ("rb", "b1.py"), ("rb", "b2.py")}
    # only repository a is named: a1 changes, a2 goes, a3 comes, b stays
    second = files_of(spark, a1="other\n" * 9, a3=TEXT * 2)
    update = commit(second)
    assert sorted((r["file_path"], r["change"]) for r in update.changes.collect()) == [("a1.py", "changed"), ("a2.py", "deleted"), ("a3.py", "new")]
    named = promise(spark, table, log, ["other\n" * 9, TEXT * 2, "beta\n" * 9, ""])
    assert named.keys() == {("ra", "a1.py"), ("ra", "a3.py"), ("rb", "b1.py"), ("rb", "b2.py")}
    assert {s for _, s in held(spark, table)} == {"a1.py", "a3.py", "b1.py"}
    assert commit(second).added.count() == 0


@pytest.mark.parametrize("broken", ["apply", "confirm"])
def test_a_broken_commit_names_nothing_that_is_not_held(spark, store, monkeypatch, broken):
    table, log, commit = store
    old, new = "old text\n" * 8, "new text\n" * 8
    commit(files_of(spark, a1=old, a2=TEXT))

    def fail(*_, **__):
        raise OSError("lost")

    if broken == "apply":
        monkeypatch.setattr(vector_table, "apply", fail)
    else:
        kept, calls = hash_log.append, []
        monkeypatch.setattr(hash_log, "append", lambda *a: fail() if len(calls) else calls.append(1) or kept(*a))
    with pytest.raises(OSError):
        commit(files_of(spark, a1=new, a2=TEXT, a3=old))
    assert set(promise(spark, table, log, [old, new, TEXT])) == {("ra", "a2.py")}
    monkeypatch.undo()
    # the file went back to its old text meanwhile: it must not count as unchanged
    commit(files_of(spark, a1=old, a2=TEXT))
    assert promise(spark, table, log, [old, new, TEXT]) == {("ra", "a1.py"): old, ("ra", "a2.py"): TEXT}
    assert held(spark, table).keys() == {("ra", "a1.py"), ("ra", "a2.py")}  # nothing is left of the broken commit


def test_lost_buckets_are_not_named(spark, store, monkeypatch):
    """Chunks that did not reach the table leave their files without a hash."""
    table, log, commit = store
    whole = vector_table.apply
    monkeypatch.setattr(vector_table, "apply", lambda s, p, removed, added: whole(s, p, removed, added.filter("source <> 'a2.py'")))
    commit(files_of(spark, a1="alpha\n" * 9, a2=TEXT))
    assert set(promise(spark, table, log, ["alpha\n" * 9, TEXT])) == {("ra", "a1.py")}
    monkeypatch.undo()
    commit(files_of(spark, a1="alpha\n" * 9, a2=TEXT))
    assert set(promise(spark, table, log, ["alpha\n" * 9, TEXT])) == {("ra", "a1.py"), ("ra", "a2.py")}


def test_branch_layers(spark, store):
    table, log, commit = store
    old = files_of(spark, a1="alpha\n" * 9, a2=TEXT)
    commit(old)
    changed = files_of(spark, a1="branch\n" * 9, a2=TEXT, b1="beta\n" * 9)
    commit(changed, "pr-1")
    assert held(spark, table, "pr-1").keys() == {("ra", "a1.py")}
    # the main layer and its hashes stay; the repository without one was indexed as main
    assert promise(spark, table, log, ["alpha\n" * 9, TEXT, "beta\n" * 9]).keys() == {("ra", "a1.py"), ("ra", "a2.py"), ("rb", "b1.py")}
    index_commit.end_branch(spark, changed, table, "m", "s", "pr-1")
    assert held(spark, table, "pr-1") == {} and len(held(spark, table)) == 3


def prompts_of(spark, n):
    return spark.createDataFrame([(i, f"prompt {i % (n // 2)}") for i in range(n)], "query_id bigint, prompt string")


def counting(path, verdict="pass", missing=()):
    """An evaluator that notes what it was asked in a file of ``path``."""

    def evaluate(texts):
        import os
        import uuid

        with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [None if t in missing else '{"verdict": "%s", "explanation": "%s"}' % (verdict, t) for t in texts]

    return evaluate


def asked(path):
    return sorted(line for f in path.iterdir() for line in f.read_text().split("\n") if line)


def test_ledger_asks_nothing_twice(spark, tmp_path):
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    first = answer_ledger.ask_once(prompts_of(spark, 20), "m", counting(str(notes), missing=("prompt 3",)), ledger, ["query_id"], batch=3)
    assert {r["query_id"]: r["raw"] is None for r in first.collect()} == {i: i % 10 == 3 for i in range(20)}
    assert asked(notes) == sorted(f"prompt {i}" for i in range(10))  # equal prompts once
    again = answer_ledger.ask_once(prompts_of(spark, 24), "m", counting(str(notes)), ledger, ["query_id"])
    assert again.filter("raw is null").count() == 0
    assert asked(notes) == sorted([f"prompt {i}" for i in range(12)] + ["prompt 3"])
    other = answer_ledger.ask_once(prompts_of(spark, 4), "n", counting(str(notes), "fail"), ledger, ["query_id"])
    assert {r["raw"][13:17] for r in other.collect()} == {"fail"}


def test_a_broken_run_keeps_its_batches(spark, tmp_path):
    notes, ledger = tmp_path / "notes", str(tmp_path / "ledger")
    notes.mkdir()
    good = counting(str(notes))

    def breaks(texts):
        import os

        if len(os.listdir(notes)) >= 4:
            raise OSError("service gone")
        return good(texts)

    with pytest.raises(Exception, match="service gone"):
        answer_ledger.ask_once(prompts_of(spark, 40), "m", breaks, ledger, ["query_id"], batch=2)
    kept = answer_ledger.read(spark, ledger, "m").count()
    before = asked(notes)
    answer_ledger.ask_once(prompts_of(spark, 40), "m", good, ledger, ["query_id"], batch=2)
    later = list(asked(notes))
    for prompt in before:
        later.remove(prompt)
    assert kept > 0 and answer_ledger.read(spark, ledger, "m").count() == 20
    assert len(later) == 20 - kept  # nothing that was kept is asked again


def test_models_of_repositories(spark, tmp_path):
    def says(name):
        return lambda texts: ['{"verdict": "%s", "explanation": "%s"}' % ("fail" if name == "b" and t.endswith("2") else "pass", name) for t in texts]

    models = answers.Models({n: says(n) for n in "abcd"}, "a", "b", "c")
    prompts = spark.createDataFrame([(i, f"r{i % 4}", f"p{i}", f"rule {i}") for i in range(12)], "query_id bigint, repo string, prompt string, rule string")
    configs = spark.createDataFrame(
        [("r1", "d", None, None, False), ("r2", "d", None, None, True), ("r3", None, "d", "a", True)],
        "repo string, llm_model string, llm_primary_model string, llm_secondary_model string, enable_cross_check boolean",
    )
    done = {r["query_id"]: r for r in answers.evaluate(answers.in_force(prompts, models, configs), models, str(tmp_path / "l")).collect()}
    assert {i: r["llm_provider"] for i, r in done.items()} == {i: ("a", "d", "c" if i == 2 else "a", "d")[i % 4] for i in range(12)}
    assert {i for i, r in done.items() if r["cross_check"]} == {2, 6, 10, 3, 7, 11}
    c = done[2]["cross_check"]
    assert (c["primary_verdict"], c["primary_model"], c["secondary_verdict"], c["secondary_model"], c["agreement"], c["discriminator_model"], c["discriminator_reasoning"]) == (
        "pass", "a", "fail", "b", False, "c", "c")
    assert done[3]["cross_check"]["secondary_model"] == "a" and done[3]["cross_check"]["agreement"]
    none = {n: says(n) for n in "ab"}
    with pytest.raises(ValueError, match="no evaluator for model d"):
        answers.evaluate(answers.in_force(prompts, answers.Models(none, "a"), configs), answers.Models(none, "a"), str(tmp_path / "l2"))


def test_missing_second_and_third_answers(spark, tmp_path):
    def says(value, missing=()):
        return lambda texts: [None if t in missing else '{"verdict": "%s"}' % value for t in texts]

    models = answers.Models({"a": says("pass", ("p1",)), "b": says("partial", ("p2",)), "c": lambda texts: [None] * len(texts)}, "a", "b", "c")
    prompts = spark.createDataFrame([(i, f"p{i}", "r", True, "a", "b") for i in range(4)], "query_id bigint, prompt string, rule string, cross_check boolean, model string, second_model string")
    done = {r["query_id"]: (r["verdict"], r["error_code"], r["llm_provider"]) for r in answers.evaluate(prompts, models, str(tmp_path / "l")).collect()}
    assert done == {0: ("partial", None, "b"), 1: (None, "LLM_UNAVAILABLE", "a"), 2: (None, "LLM_UNAVAILABLE", "b"), 3: ("partial", None, "b")}


def chunk_rows(spark, n, collections=3):
    return spark.range(n).selectExpr(
        f"case when id % 3 = 0 then 'hot' else concat('c', id % {collections}) end as collection_name", "case when id % 7 = 0 then 'pr' else '' end as branch",
        "concat('f', id div 4) as source", "md5(cast(id as string)) as chunk_hash", "id",
    )


def bucket_sizes(path):
    import pyarrow.parquet as pq

    sizes = {}
    for f in path.rglob("data/*/*.parquet"):
        sizes[f.parent.name] = sizes.get(f.parent.name, 0) + pq.ParquetFile(f).metadata.num_rows
    return sizes


def test_buckets_split_as_they_grow(spark, tmp_path):
    path = str(tmp_path / "t")
    vector_table.write_partitions(chunk_rows(spark, 300), path, 40)
    want = {r["id"] for r in chunk_rows(spark, 300).collect()}
    assert {r["id"] for r in vector_table.read(spark, path).collect()} == want
    first = bucket_sizes(tmp_path / "t")
    assert len(first) > 5 and max(first.values()) <= 40  # a collection with a third of all rows is split by files
    nothing = chunk_rows(spark, 0).select("collection_name", "branch", "source")
    vector_table.apply(spark, path, nothing, chunk_rows(spark, 1500).filter("id >= 300"), 40)
    assert sorted(r["id"] for r in vector_table.read(spark, path).collect()) == list(range(1500))
    assert max(bucket_sizes(tmp_path / "t").values()) <= 40
    one = chunk_rows(spark, 1500).filter("id = 700").select("collection_name", "branch", "source")
    before = bucket_sizes(tmp_path / "t")
    vector_table.apply(spark, path, one, chunk_rows(spark, 0), 40)
    after = bucket_sizes(tmp_path / "t")
    assert len(before.keys() - after.keys()) == 1 and 700 not in {r["id"] for r in vector_table.read(spark, path).collect()}
    hot = chunk_rows(spark, 1500).filter("collection_name = 'hot' and branch = ''")
    assert {r["id"] for r in vector_table.read(spark, path, ["hot"], [""]).collect()} == {r["id"] for r in hot.collect()} - {700}


def test_a_broken_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    vector_table.write_partitions(chunk_rows(spark, 100), path, 20)
    monkeypatch.setattr(vector_table, "_children", lambda *a: (_ for _ in ()).throw(OSError("lost")) if a[1].endswith("directory") else [])
    with pytest.raises(OSError):
        vector_table._commit(spark, path, chunk_rows(spark, 50), [], {""}, 20)
    monkeypatch.undo()
    assert vector_table.read(spark, path).count() == 100
    vector_table.clean(spark, path)
    assert sum(bucket_sizes(tmp_path / "t").values()) == 100
    everything = chunk_rows(spark, 100).select("collection_name", "branch", "source").distinct()
    vector_table.apply(spark, path, everything, chunk_rows(spark, 0), 20)
    assert vector_table.read(spark, path).count() == 0 and bucket_sizes(tmp_path / "t") == {}
    vector_table.apply(spark, path, everything.limit(0), chunk_rows(spark, 30), 20)
    assert vector_table.read(spark, path).count() == 30


def test_a_change_shuffles_every_row_once(spark, tmp_path, monkeypatch):
    """Rows that stay, go, are replaced and come, with null and repeated keys, in several portions of buckets; the directory counts the rows."""
    path = str(tmp_path / "chunks")
    monkeypatch.setattr(vector_table, "ROWS_PER_WRITE", 60)
    base = chunk_rows(spark, 300).selectExpr("*", "0 as version")
    first = base.unionByName(base.filter("id < 9")).unionByName(base.filter("id = 11").withColumn("chunk_hash", F.lit(None).cast("string")))
    vector_table.write_partitions(first, path, 40)
    removed = base.filter("id % 10 = 3").select("collection_name", "branch", "source").distinct()
    added = base.filter("id % 7 = 1 or id = 3").withColumn("version", F.lit(1))
    names = {f"{r.collection_name}/{r.branch}/{r.source}" for r in removed.collect()}
    replaced = {(r.collection_name, r.branch, r.chunk_hash) for r in added.collect()}
    want = [r for r in first.collect() if f"{r.collection_name}/{r.branch}/{r.source}" not in names and (r.collection_name, r.branch, r.chunk_hash) not in replaced]
    made = []
    monkeypatch.setattr(vector_table, "stored", lambda df, name, *a: made.append(name) or stored(df, name, *a))
    plans = []
    spread = DataFrame.sortWithinPartitions
    monkeypatch.setattr(DataFrame, "sortWithinPartitions", lambda self, *c: plans.append(self) or spread(self, *c))
    vector_table.apply(spark, path, removed, added, 40)
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    got = vector_table.read(spark, path).select(*first.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, [*want, *added.collect()]), key=repr)
    assert "rewritten" not in made  # the rows are not written twice
    found = vector_table._directory(spark, path)[0]
    assert sum(r["n"] for r in found) == got.count() and len(vector_table._portions(found)) > 3
