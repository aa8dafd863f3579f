from pyspark.sql import functions as F

from assize.functions import text
from assize.operators import documents, domains, retrieval
from assize.sources import files, logs


def test_retrieve_tags_legs_and_filters_first(spark):
    chunks = spark.createDataFrame(
        [
            ("a", ["lock", "pool"], [1.0, 0.0], "pool::lock", "rust", "one", "symbol", "x.rs"),
            ("b", ["other"], [0.9, 0.1], None, "rust", "one", "doc", None),
            ("c", ["lock"], [1.0, 0.0], "pool::lock", "go", "two", "symbol", "y.rs"),
            ("d", ["lock"], None, "n", "rust", "one", "symbol", "gone.rs"),
        ],
        "id string, terms array<string>, vec array<double>, qualified_name string, lang string, source string, chunk_kind string, source_path string",
    ).withColumn("indexed_at", F.lit("2026-01-01").cast("timestamp"))
    queries = spark.createDataFrame([("q", ["lock"], [1.0, 0.0], ["pool::lock"], "rust")], "query_id string, terms array<string>, vec array<double>, names array<string>, lang string")
    got = {r["id"]: r for r in retrieval.retrieve(queries, chunks, 1_767_225_600_000_000, 10, sources=("one",), exclude_paths=("gone.rs",)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["legs"] == ["bm25", "structural", "vector"] and got["b"]["legs"] == ["vector"] and got["a"]["rank"] == 1
    assert [r["id"] for r in retrieval.retrieve(queries, chunks, 1_767_225_600_000_000, 10, least=2.0).orderBy("rank").collect()][0] == "a"
    assert [r["id"] for r in retrieval.by_ids(chunks, spark.createDataFrame([("a",), ("a",), ("z",)], "id string")).collect()] == ["a"]
    assert [retrieval.mode(a, b) for a, b in ((True, True), (True, False), (False, True), (False, False))] == ["hybrid", "bm25", "embedding", "jaccard"]
    asked = spark.createDataFrame([("q", ["Pool lock", "", "lock pool"])], "query_id string, phrases array<string>")
    assert [(r["id"], r["n_phrases"]) for r in retrieval.phrase_matches(asked, chunks).collect()] == [("a", 1)]


def test_symbols_in_text(spark):
    cases = [("x.unlock()", "lock", False), ("a lock b", "lock", True), ("lock_it", "lock", False), ("a foo()b", "foo()", True), ("afoo()", "foo()", False), ("x", "a\\Eb", False), ("a\\Eb", "a\\Eb", True)]
    df = spark.createDataFrame(cases, "t string, n string, want boolean")
    assert df.filter(text.contains_symbol(F.col("t"), F.col("n")) != F.col("want")).isEmpty()
    names = spark.createDataFrame([("`self` and ` pool.get() ` and `abc` and `unlock()`",)], "t string").select(text.backtick_identifiers(F.col("t"))).first()[0]
    assert names == ["pool.get", "unlock"]


def test_domains(spark):
    rows = [("a", "Cargo.toml", ""), ("a", "package.json", '{"dependencies": {"next": "1", "react": "1"}}'), ("b", "package.json", "broken"), ("b", "tsconfig.json", None), ("b", "main.tf", ""), ("c", "www/x", ""), ("c", "secrets.yaml", ""), ("c", "dev.yaml", "x: 1\nesphome:\n"), ("d", "src/Cargo.toml", "")]
    got = {r["project"]: (r["languages"], r["frameworks"]) for r in domains.detect(spark.createDataFrame(rows, "project string, path string, text string")).collect()}
    assert got == {"a": (["javascript", "rust"], ["nextjs"]), "b": (["hcl", "typescript"], ["terraform"]), "c": ([], ["esphome", "home-assistant"]), "d": ([], [])}
    df = spark.createDataFrame([("next", "go", ["Spark: use x::Spark", "@scope/pkg", "a.b.session", "os"]), ("no", "rust", [])], "name string, lang string, imports array<string>")
    said = df.select(domains.code_aware_query(domains.documentation_query(F.col("name"), F.col("lang")), F.col("imports"))).collect()
    assert [r[0] for r in said] == ["server components data fetching security Spark scope session", "common pitfalls async safety error handling"]


def test_manifests_of_a_project():
    found = documents.project_dependencies({"Cargo.toml": '[dependencies]\nserde-json = "1"\n[target.\'cfg(unix)\'.dependencies]\nnix = "1"', "package.json": '{"optionalDependencies": {"x": "1"}}', "tsconfig.json": "{}", "pyproject.toml": "broken [", "requirements.txt": "flask"})
    assert found == [("nix", "rust"), ("serde_json", "rust"), ("x", "typescript"), ("flask", "python")]


def test_subtypes_and_misleading_reports(spark):
    paths = ["docs/my-README.md", "HISTORY.md", "docs/adr/1.md", "decision-3.md", "x.md", "src/adrs.d/y.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(files.subtype(F.col("path"))).collect()] == ["readme", "changelog", "adr", "adr", "doc", "doc"]
    reports = spark.createDataFrame([("f", "t", "c", ["x"], "r"), ("f", "t", "c", None, "r")], "file_path string, finding_title string, finding_category string, blamed_chunk_ids array<string>, reason string")
    assert [r["verdict"] for r in logs.misleading_verdicts(reports, "2026-01-01").collect()] == ['{"context_misleading":{"blamed_chunk_ids":["x"]}}', '{"context_misleading":{"blamed_chunk_ids":[]}}']
