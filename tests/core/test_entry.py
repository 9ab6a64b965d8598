import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and all(map(callable, q.values())) and len(q) >= 50


def test_entry(spark):
    assert e.entry(spark).count() == 200


def test_works_without_the_optional_parts(tmp_path):
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False", "True"], said.stderr


def test_library_does_not_import_the_optional_part():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            text = p.read_text()
            assert "corpusloom.llm" not in text and "from .llm " not in text and "from ..llm " not in text and "from .llm." not in text
