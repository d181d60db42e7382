"""The library knows nothing of web servers, databases, or the tests' fixtures."""

import pathlib
import re

FORBIDDEN = re.compile(r"^\s*(?:from|import)\s+(flask|fastapi|sqlalchemy|celery|requests|sklearn|duckdb|fixtures|tests)\b", re.M)


def test_library_imports():
    root = pathlib.Path(__file__).resolve().parent.parent / "clinisieve"
    found = [str(p) for p in root.rglob("*.py") if FORBIDDEN.search(p.read_text(encoding="utf-8"))]
    assert found == []


def test_no_local_checkpoints_and_no_row_at_a_time_udfs():
    root = pathlib.Path(__file__).resolve().parent.parent / "clinisieve"
    for path in root.rglob("*.py"):
        source = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in source and "F.udf(" not in source and ".rdd" not in source, path
