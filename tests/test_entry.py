import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_the_rest_works_without_the_text_operators(tmp_path):
    """As if the subpackage and the pipeline were not installed."""
    (tmp_path / "meterql").mkdir()
    for p in (ROOT / "meterql").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "meterql" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path[:] = [p for p in sys.path if p not in ('', {str(ROOT)!r})]; sys.path.insert(0, {str(tmp_path)!r})\nimport __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()); import meterql.engine, meterql.service.app, meterql.cli"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "meterql").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "meterql.llm" not in p.read_text(), p
