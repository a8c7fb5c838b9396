"""The driver's contract, and that it holds without the folders for language-model data."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "agg_over_container" in entry.queries()


def test_import_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "quillrow"):
        source = ROOT / name
        target = tmp_path / name
        if source.is_dir():
            for f in source.rglob("*.py"):
                to = target / f.relative_to(source)
                if "llm" not in to.relative_to(target).parts:
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_bytes(f.read_bytes())
        else:
            target.write_bytes(source.read_bytes())
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
