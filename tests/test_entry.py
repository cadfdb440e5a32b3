"""The entry with and without its optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_every_oracle_belongs_to_a_query():
    missing = run("import __spark_entry__ as e; print(*(set(e.oracle_sql()) - set(e.queries())))")
    assert missing == []


def test_entry_works_without_the_optional_subpackage():
    """As if the folders had been deleted: the finder hides them, everything else still imports."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("shelflink.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), *[q for q in e.queries() if q.startswith("op") or q == "pipeline"])
"""
    (count, *extra) = run(code)
    assert int(count) >= 44 and extra == []
