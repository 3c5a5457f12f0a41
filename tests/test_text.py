"""Text and verdict expressions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from rulelens.functions import text as x
from rulelens.functions import verdicts as v
from rulelens.operators import chunking
from rulelens.operators.search import embed_texts
from rulelens.functions.vectors import cosine, hash_embedder


def one(spark, schema, values, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_verdict_parsing(spark):
    raws = [
        '```json\n{"verdict": "PASS", "explanation": "ok", "suggestions": ["a"]}\n```',
        '{"verdict": "great"}',
        "[]",
        '{"verdict": null}',
        '{"verdict": 5}',
        "{}",
        "no json " + "x" * 600,
        "  {\"verdict\": \"Partial\", \"explanation\": \"e\"} ",
    ]
    p = v.parse_response(F.col("raw"))
    got = one(spark, "raw string", [(r,) for r in raws], p.verdict, p.explanation, F.size(p.suggestions), p.error_code)
    assert got == [
        ("pass", "ok", 1, None),
        ("fail", "", 0, None),
        ("fail", v.EVALUATION_ERROR, 0, "EVALUATION_ERROR"),
        ("fail", v.EVALUATION_ERROR, 0, "EVALUATION_ERROR"),
        ("fail", v.EVALUATION_ERROR, 0, "EVALUATION_ERROR"),
        ("fail", "", 0, None),
        ("fail", v.PARSE_ERROR + ("no json " + "x" * 600)[:500], 0, "PARSE_ERROR"),
        ("partial", "e", 0, None),
    ]


def test_error_parsing(spark):
    raws = ['{"code":"LLM_UNAVAILABLE","message":"m","technical":"t"}', '{"code":"X","message":"m"}', '{"a":1}', "boom", None, ""]
    p = v.parse_error(F.col("raw"))
    got = one(spark, "raw string", [(r,) for r in raws], p.code, p.message, p.technical, p.title)
    assert got == [
        ("LLM_UNAVAILABLE", "m", "t", "Servicio de IA no disponible"),
        ("X", "m", None, "Error en la evaluación"),
        (None, '{"a":1}', None, "Error en la evaluación"),
        (None, "boom", None, "Error en la evaluación"),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_severity_fallback(spark):
    pairs = [("pass", "fail"), ("partial", "pass"), ("odd", "fail"), ("odd", "odd2"), ("fail", "odd")]
    got = one(spark, "p string, s string", pairs, v.more_severe(F.col("p"), F.col("s")))
    assert [g[0] for g in got] == ["fail", "partial", "odd", "odd", "odd"]


def test_truncate_keeps_line_past_half(spark):
    rows = [("abcd\nefgh", 2), ("ab\ncdefghij", 2), ("short", 5), ("abcdefghijk", 2), ("", 0)]
    got = [g[0] for g in one(spark, "t string, n int", rows, x.truncate_to_tokens(F.col("t"), F.col("n")))]
    m = x.TRUNCATED_TOKENS
    assert got == ["abcd\nefgh"[:8] + m if "abcd\nefgh"[:8].rfind("\n") <= 4 else "abcd" + m, "ab\ncdefg" + m, "short", "abcdefgh" + m, ""]


def test_truncate_against_plain_python(spark):
    texts = ["a\nb\nc" * 7, "x" * 50, "line one\nline two is longer\nend", "é\nñ" * 9, "\n" * 30]
    rows = [(t, n) for t in texts for n in (1, 2, 5, 9)]

    def plain(t, n):
        limit = n * 4
        if len(t) <= limit:
            return t
        head = t[:limit]
        at = head.rfind("\n")
        return (head[:at] if at > limit * 0.5 else head) + x.TRUNCATED_TOKENS

    got = one(spark, "t string, n int", rows, x.truncate_to_tokens(F.col("t"), F.col("n")))
    assert [g[0] for g in got] == [plain(*r) for r in rows]


def test_line_spans(spark):
    rows = [("a\nb\nc", "b\nc"), ("a\nb\nb", "b"), ("a", "z")]
    start = x.chunk_start(F.col("t"), F.col("c"))
    got = one(spark, "t string, c string", rows, start, x.stored_line(start))
    assert got == [(2, 2), (2, 2), (0, -1)]


def test_durations_and_percent(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, t0 + dt.timedelta(milliseconds=m)) for m in (0, 999, 1000, 1250, 59_949, 60_000, 125_999)] + [(t0, None)]
    got = one(spark, "a timestamp, b timestamp", rows, x.duration_text(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["0ms", "999ms", "1.0s", "1.3s", "59.9s", "1m 0s", "2m 5s", "—"]
    got = one(spark, "f double", [(0.5,), (0.125,), (1.0,), (None,)], x.percent_text(F.col("f")), v.percent(F.col("f")))
    assert got == [("50%", 50), ("13%", 12), ("100%", 100), ("—", None)]


def test_headers_labels_and_clips(spark):
    rows = [("a/b/c.py", []), ("c.py", ["f"]), ("x/y.go", ["f", "g"])]
    got = one(spark, "p string, s array<string>", rows, x.file_header(F.col("p"), F.col("s")))
    assert [g[0] for g in got] == ["[Archivo: c.py]", "[Archivo: c.py | Funcion: f]", "[Archivo: y.go | Funciones: f, g]"]
    got = one(spark, "s string", [("running",), ("odd",), (None,)], x.label_of("task", F.col("s")))
    assert [g[0] for g in got] == ["Ejecutando", "odd", "—"]
    got = one(spark, "s string", [("x" * 120,), ("x" * 121,), (None,)], x.preview(F.col("s")))
    assert [g[0] for g in got] == ["x" * 120, "x" * 120 + "…", ""]
    got = one(spark, "s string", [(" one. two",), ("none",), ("",), (None,)], x.first_sentence(F.col("s")))
    assert [g[0] for g in got] == ["one", "none", "", ""]


def plain_windows(text, size, overlap):
    step, out, i = size - overlap, [], 0
    while text and (i == 0 or i * step + overlap < len(text)):
        out.append((i, text[i * step : i * step + size], text[: i * step].count("\n") + 1))
        i += 1
    return out


def test_windows_against_brute_force(spark):
    texts = ["", "a", "x" * 1000, "x" * 1001, "é\n" * 3000, "line\n" * 4321, "ab\ncd" * 1733]
    files = spark.createDataFrame([("r", f"f{i}.py", t) for i, t in enumerate(texts)], "repo string, file_path string, content string")
    for size, overlap in ((1000, 100), (50, 25), (7, 0)):
        got = sorted(
            (r.file_path, r.chunk_no, r.content, r.start_line, r.end_line)
            for r in chunking.chunk_windows(files, size, overlap).collect()
        )
        want = sorted(
            (f"f{i}.py", n, c, line, line + c.count("\n")) for i, t in enumerate(texts) for n, c, line in plain_windows(t, size, overlap)
        )
        assert got == want


def test_size_limit_keeps_small_chunks(spark):
    rows = [("r", "a.py", "l\n" * 2000, 11, 99, "node"), ("r", "b.py", "small\n", 5, 6, "node")]
    df = spark.createDataFrame(rows, "repo string, file_path string, content string, start_line int, end_line int, node_type string")
    got = sorted((r.file_path, r.start_line, r.end_line, len(r.content)) for r in chunking.limit_size(df).collect())
    assert got[-1] == ("b.py", 5, 6, 6)
    first, second = got[:2], got[2:-1]
    assert first[0] == ("a.py", 11, 11 + 1024, 2048)
    assert all(n <= 2048 for _, _, _, n in got) and len(first + second) == 3


def plain_separator_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The recursive splitting rule on strings, without offsets."""
    import re

    sep, rest = separators[-1], ()
    for i, candidate in enumerate(separators):
        if candidate == "" or candidate in text:
            sep, rest = candidate, separators[i + 1 :]
            break
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    if sep:
        tokens = re.split(f"({re.escape(sep)})", text)
        parts = [p for p in [tokens[0], *("".join(tokens[i : i + 2]) for i in range(1, len(tokens), 2))] if p]
    out, good = [], []

    def merge(pieces):
        done, current = [], []
        for p in pieces:
            if current and sum(map(len, current)) + len(p) > size:
                done.append("".join(current).strip())
                while current and (sum(map(len, current)) > overlap or sum(map(len, current)) + len(p) > size):
                    current = current[1:]
            current.append(p)
        return [d for d in [*done, "".join(current).strip()] if d]

    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        out += merge(good)
        good = []
        out += plain_separator_split(p, size, overlap, rest) if rest else [p]
    return out + merge(good)


def test_separator_chunks(spark):
    rng = __import__("random").Random(3)
    texts = ["\n\n".join("word%d " % i * 40 for i in range(30)) + "\n" + "z" * 2500, "", "  \n ", "a" * 1000, "short"]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "bc", " ", " ", "\n", "\n\n", "é", "long" * 9]) for _ in range(rng.randint(1, 400))))
    for text in texts:
        for size, overlap in ((1000, 100), (40, 12), (25, 0)):
            pieces = chunking.split_at_separators(text, size, overlap)
            assert [c for _, c in pieces] == plain_separator_split(text, size, overlap)
            assert all(len(c) <= size and text[o : o + len(c)] == c for o, c in pieces)
            covered = set()
            for o, c in pieces:
                covered.update(range(o, o + len(c)))
            assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())
    files = spark.createDataFrame([("r", f"f{i}.md", t) for i, t in enumerate(texts)], "repo string, file_path string, content string")
    want = {
        (f"f{i}.md", n, c, t[:o].count("\n") + 1, t[: o + len(c)].count("\n") + 1)
        for i, t in enumerate(texts) for n, (o, c) in enumerate(chunking.split_at_separators(t, 1000, 100))
    }
    assert {(r.file_path, r.chunk_no, r.content, r.start_line, r.end_line) for r in chunking.chunk_separators(files).collect()} == want


def test_embedding_is_unit_and_cosine(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta ALPHA"), (3, "")], "id long, t string")
    got = embed_texts(df, "t", embed=hash_embedder(16))
    rows = {r.id: r.embedding for r in got.collect()}
    assert rows[1] == rows[2] and sum(rows[3]) == 0.0 and abs(sum(x * x for x in rows[1]) - 1) < 1e-6
    sims = got.select("id", cosine(F.col("embedding"), F.col("embedding")).alias("s")).collect()
    assert {r.id: r.s for r in sims} == {1: 1.0, 2: 1.0, 3: None}
