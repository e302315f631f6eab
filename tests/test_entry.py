import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in (root / "orbis").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "orbis.llm" not in path.read_text()
