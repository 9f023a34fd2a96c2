from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys, warnings
class Without:
    def find_spec(self, name, path=None, target=None):
        if name.partition(".")[0] == {name!r}:
            raise ImportError("not installed: " + name)
sys.meta_path.insert(0, Without())
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
assert "file_metrics" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries()), sorted(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
assert any("without the corpus operators" in str(w.message) for w in said)
"""


def test_entry_needs_no_library_of_the_corpus_operators():
    for name in ("zstandard", "sentencepiece", "ahocorasick"):
        done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True)
        assert not done.returncode, done.stderr


def test_every_query_of_the_library_has_sql():
    from glyphmill import queries

    assert set(queries.queries()) == set(queries.oracle_sql()) and len(queries.queries()) > 60
