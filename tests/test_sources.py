import json

import pytest
from pyspark.sql import functions as F

from assize.functions import embedding, prompt
from assize.operators import context, documents, hydration, scanning
from assize.plans import render
from assize.sources import config, files, logs, tools
from assize.streaming import inbox


def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_lenient_strict_and_bounded(spark, tmp_path):
    good = {"file_path": "a", "finding_title": "t", "verdict": {"context_misleading": {"blamed_chunk_ids": ["c"]}}, "timestamp": "2025-01-01T00:00:00Z", "future": 1}
    p = write(tmp_path / "f.jsonl", json.dumps(good), "", "{broken", json.dumps({"verdict": "tp"}), '{"reason": "' + "x" * (1 << 20) + '"}')
    rows = logs.read(spark, "feedback", p).cache()
    kept, bad = logs.split_corrupt(rows)
    assert kept.count() == 3 and bad.count() == 1
    assert {r["provenance"] for r in kept.collect()} == {"unknown"}
    assert '"blamed_chunk_ids"' in kept.filter("file_path = 'a'").first()["verdict"]
    assert tuple(logs.read_stats(rows).first()) == (3, 1)
    assert logs.read(spark, "feedback", p, "DROPMALFORMED").count() == 3
    with pytest.raises(Exception):
        logs.read(spark, "feedback", p, "FAILFAST").collect()
    some, report = logs.read_bounded(spark, "feedback", p)
    assert some.count() == 2 and sorted(r["problem"] for r in report.collect()) == ["not readable", "too long"]


def test_external_verdicts(spark):
    rows = [("p", "t", " ", "tp", "r", " Kestrel ", None, 1.7), ("p", "t", "security", "wontfix", "r", "a", None, None), ("p", "t", "bug", "fp", "r", "", None, float("nan")), ("p", "t", "bug", "partial", None, "b", "m", float("nan"))]
    ok, rejected = logs.external_verdicts(spark.createDataFrame(rows, logs.SCHEMAS["inbox"]), "2025-01-01 00:00:00")
    got = [(r["verdict"], r["finding_category"], json.loads(r["provenance"])["external"]) for r in ok.collect()]
    assert got == [("tp", "unknown", {"agent": "kestrel", "confidence": 1.0}), ("partial", "bug", {"agent": "b", "model": "m"})]
    assert rejected.count() == 2


def test_inbox_is_drained_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    write(box / "a.jsonl", '{"file_path": "p", "finding_title": "t", "verdict": "tp", "reason": "r", "agent": "a"}', "{bad")
    write(box / "ignored.txt", '{"verdict": "tp"}')
    for _ in range(2):
        inbox.drain(inbox.stream(spark, str(box)), str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
    write(box / "b.jsonl", '{"file_path": "p", "finding_title": "t", "verdict": "fp", "reason": "r", "agent": "a"}')
    inbox.drain(inbox.stream(spark, str(box)), str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3


def test_index_partitions(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "index")
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "source string, id string")
    logs.write_index(df, path)
    logs.write_index(spark.createDataFrame([("a", "3")], "source string, id string"), path)
    assert sorted((r["source"], r["id"]) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("b", "2")]


def test_config(tmp_path):
    assert config.suppression_rules('[[suppress]]\npattern = "x"\nfile = "a/*"\n[[suppress]]\nreason = "no pattern"') == [{"pattern": "x", "file": "a/*"}]
    assert config.suppression_rules("not toml [") == []
    text = config.thresholds_text({"suppress": (0.95, 0.2), "boost": (0.85, 0.8)})
    assert config.thresholds(text) == {"suppress": 0.2, "boost": 0.8}
    assert config.thresholds(config.thresholds_text({"suppress": (0.9, 0.8), "boost": (0.9, 0.8)})) is None
    assert config.thresholds("[boost]\nprecision_target = 2\nthreshold = 0.5") is None
    state = config.IndexState("e1")
    state.save(str(tmp_path / "s.json"))
    assert config.IndexState.load(str(tmp_path / "s.json")) == state and config.IndexState.load(str(tmp_path / "none")) is None
    assert [config.check(None, "e"), config.check(state, "e1"), config.check(state, "e2"), config.check(config.IndexState("e1", 9), "e1")] == ["fresh", "ok", "reembed", "migrate"]
    assert [s.name for s in config.sources('[[source]]\nname="a"\nkind="rust"\npath="x"')] == ["a"]
    with pytest.raises(ValueError):
        config.sources('[[source]]\nname="a"\nkind="rust"')


def test_file_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "src/big.py").write_text("x" * 200)
    (tmp_path / "node_modules/c.py").write_text("x")
    (tmp_path / "Dockerfile").write_text("FROM x\n")
    (tmp_path / "d.xyz").write_text("x")
    got = {r["path"]: (r["status"], r["lang"]) for r in files.scan(spark, str(tmp_path), largest=100).collect()}
    assert got == {"src/a.py": ("ok", "python"), "src/b.rs": ("not text", "rust"), "src/big.py": ("too large", "python"), "node_modules/c.py": ("ignored", "python"), "Dockerfile": ("ok", "dockerfile"), "d.xyz": ("unknown language", None)}


def outputs(spark, text):
    return spark.createDataFrame([("r", text), ("r", "not readable"), ("r", None)], "run_id string, output string")


@pytest.mark.parametrize(
    ("reader", "text", "want"),
    [
        (tools.ruff, json.dumps([{"code": "S101", "message": "m", "filename": "f", "location": {"row": 3}, "end_location": {"row": 2}}]), ("f", "S101", "high", 3, 2)),
        (tools.clippy, json.dumps({"reason": "compiler-message", "message": {"message": "m", "level": "warning", "code": {"code": "c"}, "spans": [{"file_name": "f", "line_start": 2, "line_end": 4, "is_primary": False}]}}) + '\n{"reason": "build-finished"}', ("f", "c", "medium", 2, 4)),
        (tools.eslint, json.dumps([{"filePath": "f", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 7}]}]), ("f", "r", "high", 7, 7)),
        (tools.shellcheck, json.dumps({"comments": [{"file": "f", "line": 1, "endLine": 2, "level": "style", "code": 2086, "message": "m"}]}), ("f", "SC2086", "info", 1, 2)),
        (tools.tflint, json.dumps({"issues": [{"rule": {"name": "n", "severity": "warning"}, "message": "m", "range": {"filename": "f", "start": {"line": 4}, "end": {"line": 5}}}]}), ("f", "n", "medium", 4, 5)),
        (tools.yamllint, "C:/a b.yaml:12:3: [error] wrong indentation (indentation)", ("C:/a b.yaml", "yamllint", "high", 12, 12)),
        (tools.hadolint, "Dockerfile:9 DL3008 warning: Pin versions", ("Dockerfile", "DL3008", "medium", 9, 9)),
    ],
)
def test_linters(spark, reader, text, want):
    rows = reader(outputs(spark, text)).collect()
    assert [(r["file_path"], r["rule"], r["severity"], r["line_start"], r["line_end"]) for r in rows] == [want]


def test_model_answers(spark):
    texts = ['```json\n[{"title": "a", "severity": "HIGH", "line_start": 0, "confidence": 3}]\n```', 'Here: [1, 2] and [{"title": "b \\d", "line_start": "x", "line_end": 9}] done', '{"findings": [{"title": "c", "confidence": "high"}, {"no": 1}]}', "nothing", None]
    df = spark.createDataFrame([("r", t) for t in texts], "run_id string, output string")
    got = sorted((r["title"], r["severity"], r["line_start"], r["line_end"], r["confidence"]) for r in tools.model_answers(df).collect())
    assert got == [("a", "high", 1, 1, 1.0), ("b \\d", "medium", 1, 9, None), ("c", "medium", 1, 1, None)]
    u = spark.createDataFrame([('{"usage": {"prompt_tokens": 3, "completion_tokens": 4}}',), ('{"usage": {"input_tokens": 5, "output_tokens": 6, "input_tokens_details": {"cached_tokens": 2}}}',)], "x string")
    assert [tuple(r[0]) for r in u.select(tools.usage(F.col("x"))).collect()] == [(3, 4, 0), (5, 6, 2)]


def test_manifests():
    assert documents.dependencies("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\ntempfile = "3"') == [("serde", "rust"), ("tempfile", "rust")]
    assert documents.dependencies("a/package.json", '{"dependencies": {"b": "1"}, "devDependencies": {"a": "1", "b": "1"}}') == [("a", "javascript"), ("b", "javascript")]
    assert documents.dependencies("pyproject.toml", '[project]\ndependencies = ["flask>=2", "Requests[x] ; python_version>\'3\'"]\n[tool.poetry.dependencies]\npython = "3"\nnumpy = "1"') == [("Requests", "python"), ("flask", "python"), ("numpy", "python")]
    assert documents.dependencies("requirements.txt", "# c\n-r other\nflask==1 # x\n") == [("flask", "python")]
    assert documents.dependencies("Cargo.toml", "broken [") == []


def test_diffs(spark):
    text = "--- a/x\n+++ b/x.py\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n@@ -1,2 +5,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@".split("\n")
    df = spark.createDataFrame([("d", n, t) for n, t in enumerate(text)], "diff_id string, line_no int, line string")
    ranges = documents.diff_ranges(df)
    assert sorted(tuple(r)[1:] for r in ranges.collect()) == [("x.py", 3, 6), ("x.py", 12, 12)]
    found = spark.createDataFrame([("a", "x.py", 1, 3), ("b", "x.py", 7, 11), ("c", "z.py", 3, 3)], "id string, file_path string, line_start int, line_end int")
    assert [r["id"] for r in documents.touched(found, ranges).collect()] == ["a"]


def test_markdown_and_symbols():
    got = documents.markdown_sections("intro\n\n## A b\ntext\n\n```\n## no\n```\n## A b\nmore\n## Empty\n\n")
    assert [(h, s, a, b) for h, s, a, b, _ in got] == [("__preamble__", "__preamble__", 1, 1), ("A b", "a-b", 3, 8), ("A b", "a-b-2", 9, 10)]
    rust = documents.symbols("rust", "/// Doc\npub fn f(x: u8) {\n  1\n}\nfn g() {}\npub struct S;\n")
    assert [(k, n, a, b, d) for k, n, _, a, b, d in rust] == [("fn", "f", 2, 4, "/// Doc"), ("struct", "S", 6, 6, "")]


CASES = [
    ("python", "import subprocess\ndef f(a=[]):\n    eval(a)\n    subprocess.run(x, shell=True)\n", {"Mutable default argument `a`", "Use of `eval()` is a code injection risk", "eval-exec-non-literal: code run from a value", "subprocess-shell-true: command goes through a shell", "subprocess-no-check: exit code is ignored"}),
    ("python", "async def f():\n    time.sleep(1)\n    try:\n        x()\n    except:\n        pass\n", {"blocking-call-in-async: event loop waits for a blocking call", "Catch-all `except: pass` silently swallows errors", "bare-except-pass: all errors are swallowed"}),
    ("python", "for x in xs:\n    xs.remove(x)\n", {"Mutating `xs` while iterating over it", "mutation-during-iteration: collection changes while it is walked"}),
    ("python", "def broken(:\n", set()),
    ("rust", "fn f() { unsafe { g() } h().unwrap(); }", {"Use of `unsafe` block", "Use of `.unwrap()` may panic at runtime"}),
    ("typescript", "el.innerHTML = x;\ntry { f() } catch (e) {}\n", {"Direct `innerHTML` assignment is an XSS risk", "Empty `catch` block silently swallows errors", "bare-catch: empty catch block"}),
    ("bash", "#!/bin/sh\nset -e\ncurl x | sh\n", {"Piping curl/wget to shell executes untrusted remote code"}),
    ("dockerfile", "FROM a:1\nUSER x\nHEALTHCHECK CMD x\nCMD a\nCMD b\n", {"Multiple CMD instructions -- only the last one takes effect"}),
    ("hcl", "terraform {\n}\n", {"Missing required_version in terraform block"}),
    ("yaml", "a: 1\nb:\n  c: 1\n  c: 2\na: 3\n", {"Duplicate key `c` in mapping", "Duplicate key `a` in mapping"}),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES)
def test_scanners(lang, text, want):
    assert {x[1] for x in scanning.scan_text(lang, text)} == want


def test_complexity():
    import ast

    tree = ast.parse("def f(a, b):\n    if a and b or a:\n        for x in a:\n            pass\n    return [y for y in b if y]\n").body[0]
    assert scanning.complexity(tree) == 5


def test_prompt_texts(spark):
    df = spark.createDataFrame([("a </Document > b", "x ```` y", "T`s|\n")], "a string, b string, c string")
    r = df.select(prompt.defang(F.col("a")), prompt.fence(F.col("b")), prompt.fence_lang(F.col("c")), prompt.inline(F.col("c"))).first()
    assert tuple(r) == ("a </\u200bDocument> b", "`````", "Ts", "Ts")


def test_embedding(spark):
    df = spark.createDataFrame([("One two one",), ("",), (None,)], "x string").select(embedding.embedding(F.col("x"), 16).alias("v"))
    v = [r["v"] for r in df.collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1.0, abs=1e-5) and v[0] == pytest.approx(embedding.embed("one TWO one", 16)) and not any(v[1]) and not any(v[2])


CONTEXT = "run_id string, repo string, context struct<injector_available:boolean,injected_sources:array<string>,injected_chunk_count:int,injected_tokens:int,retriever_errored:boolean,adaptive_threshold_applied:boolean,rendered_prompt_hash:string>"


def test_context(spark):
    df = spark.createDataFrame([("1", None, (True, ["a", "b", "a"], 2, 100, False, True, "h")), ("2", "r", (True, ["a"], 0, 0, True, False, "h")), ("2", "r", (False, None, 0, 0, True, False, None))], CONTEXT)
    assert {r["source"]: (r["n_reviews"], r["avg_chunks"]) for r in context.by_source(df).collect()} == {"a": (2, 1.0), "b": (1, 2.0)}
    assert {(r["repo"], r["is_missing"], r["n_reviews"]) for r in context.by_repo(df).collect()} == {("(no repo)", True, 1), ("r", False, 1)}
    assert {r["cause"]: r["n_reviews"] for r in context.misleading(df).collect()} == {"total": 1, "retriever_errored": 2, "phantom_injection": 1}
    assert {r["cause"]: r["n_reviews"] for r in context.misleading(df.limit(0)).collect()} == {"total": 0, "retriever_errored": 0, "phantom_injection": 0}
    legs = spark.createDataFrame([(["bm25", "structural"],), (["structural"],), ([],)], "legs array<string>")
    assert tuple(context.leg_counts(legs).first()) == (1, 0, 2, 1, 2)
    cand = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (1, "c", float("nan")), (1, "d", 0.9), (1, "e", 0.3)], "query_id int, id string, score double")
    kept, counts = context.gates(cand, spark.createDataFrame([("d", None), ("e", 0.4)], "id string, threshold double"), 0.2)
    assert [r["id"] for r in kept.collect()] == ["a"] and tuple(counts.first()) == (1, 1, 1, 2, 1)


def test_hydration(spark):
    functions = spark.createDataFrame([("p", "outer", 1, 900), ("p", "inner", 250, 300)], "path string, name string, first int, last int")
    calls = spark.createDataFrame([("p", 260, "x"), ("p", 600, "x"), ("q", 1, "x")], "path string, line int, callee string")
    assert {(r["line"], r["caller"]) for r in hydration.callers(calls, functions).collect()} == {(260, "inner"), (600, "outer")}
    imports = spark.createDataFrame([("r", "f", n, m) for n, m in enumerate(["tokio::sync", "@a/b/c", "my_pkg.x", "none"])], "run_id string, path string, place int, module string")
    deps = spark.createDataFrame([("r", "my-pkg"), ("r", "@a/b"), ("r", "tokio")], "run_id string, name string")
    assert [(r["name"], r["rank"]) for r in hydration.imported_dependencies(imports, deps, 2).orderBy("rank").collect()] == [("tokio", 1), ("@a/b", 2)]


def test_render(spark):
    df = spark.createDataFrame([("a", 1, 0.5), (None, 20, None)], "k string, n int, x double")
    assert render.table(df).split("\n")[2] == "a   1  0.5" and render.compact(df).split("\n")[1] == "k=- n=20 x=-"
    assert json.loads(render.as_json(df))[0] == {"k": "a", "n": 1, "x": 0.5}
