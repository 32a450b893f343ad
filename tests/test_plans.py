import __spark_entry__
from folioflow.plans import catalog


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "duplicate_translation" in catalog.queries()


def test_nothing_outside_imports_the_training_operators():
    import ast
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "folioflow"
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("folioflow.llm") for n in names), p


def test_newest_keeps_columns_with_clashing_names(spark):
    from folioflow.tables import newest

    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 3, 7)], "k string, at int, _rn int")
    assert [tuple(r) for r in newest(df, "k", "at").collect()] == [("a", 2, 6)]
    assert newest(df.limit(0), "k", "at").count() == 0


def _compared(spark, folder, name):
    """The query's rows, which must be those of its SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}/*.parquet')")
    rows = {tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()}
    assert rows == set(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    return rows


def test_numbers_of_all_scripts(spark, tmp_path):
    rows = [(1, "3နာရီ နှင့် ၄"), (2, "“12,5” – 7é x8"), (3, "a 1.2 b"), (4, "no digit"), (5, "第3章")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _compared(spark, tmp_path, "number_tokens") == {(1, 1, "3"), (2, 2, "12,5;7"), (3, 1, "1.2"), (5, 1, "3")}


def test_empty_warnings_of_all_scripts(spark, tmp_path):
    rows = [("a", "É", None, "translated"), ("b", "“x”", " \u3000", "reviewed"), ("c", "x", None, "translated"), ("d", "É", None, "pending"), ("e", "x", "é", "translated")]
    at = "TIMESTAMP '2026-01-01 00:00:00'"
    b = spark.createDataFrame(rows, "block_id string, source_text string, translated_text string, unit_status string").selectExpr("*", "'d' AS document_id", "'p' AS project_id", f"{at} AS updated_at", f"{at} AS ingested_at")
    b.write.parquet(str(tmp_path / "export_block.parquet"))
    spark.createDataFrame([("d", "en", "my")], "document_id string, source_language string, target_language string").write.parquet(str(tmp_path / "export_document.parquet"))
    assert _compared(spark, tmp_path, "empty_warning_counts") == {("missing_text", 2), ("unexpected_empty", 1)}


def test_sample_prefix_of_the_whole_bound(spark, tmp_path):
    at = "TIMESTAMP '2026-01-01 00:00:00'"
    b = spark.range(4).selectExpr("concat('b', id) AS block_id", "'d' AS document_id", "'p' AS project_id", "CAST(id AS INT) AS order_index", "repeat('é', IF(id = 0, 2500, 24000)) AS source_text", f"{at} AS updated_at", f"{at} AS ingested_at")
    b.write.parquet(str(tmp_path / "export_block.parquet"))
    assert _compared(spark, tmp_path, "sample_prefix") == {("b0", 0), ("b1", 2500), ("b2", 26500)}
