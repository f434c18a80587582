import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p6_found", "w1_gap_clusters"} <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_core_does_not_need_the_subpackage():
    from pathlib import Path

    package = Path(entry.__file__).parent / "genoplane"
    for f in package.rglob("*.py"):
        if "llm" not in f.parts:
            assert "genoplane.llm" not in f.read_text(encoding="utf-8"), f
