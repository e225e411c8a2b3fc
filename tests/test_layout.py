import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "stratalog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"stratalog\.llm|corpus_pipeline", p.read_text()), p


def test_entry_without_llm_and_pipeline():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("stratalog.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert "scan_prefix" in q and not any(n.startswith("op") for n in q) and set(s) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_query_has_sql():
    from stratalog.plans.catalog import QUERIES, SQL

    assert QUERIES.keys() == SQL.keys()
