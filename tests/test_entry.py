import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_queries_and_oracles_agree():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_entry_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lodestar.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("lodestar.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    spec = importlib.util.spec_from_file_location("entry_alone", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    names = module.queries()
    assert "rbac_allow" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_the_rest_without_the_optional_folders(tmp_path):
    """In a copy without both folders and the pipeline, the entry has the engine's queries and every other test is found."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", "spark-warehouse"))
    assert not (copy / "lodestar" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rbac_allow' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout
    quick = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_conditions.py"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert quick.returncode == 0, quick.stdout
