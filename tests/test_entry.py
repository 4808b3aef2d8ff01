import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_optional_part(tmp_path):
    """A copy without the subpackage, its tests and the pipeline still imports and lists its queries."""
    for p in ROOT.rglob("*.py"):
        q = p.relative_to(ROOT)
        if "llm" not in q.parts and q.name != "corpus_pipeline.py":
            (tmp_path / q).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / q).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
