import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract():
    import __spark_entry__ as e

    queries = e.queries()
    assert set(e.oracle_sql()) <= set(queries) and "p5_found" in queries and "p6_found" in queries


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "qirtas").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_lineage_is_never_cut_locally():
    assert not any("localCheckpoint(" in p.read_text() for p in (ROOT / "qirtas").rglob("*.py"))
