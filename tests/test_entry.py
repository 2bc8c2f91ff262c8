"""What the driver calls; and that the rest works without the text operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = __file__.rsplit("/tests/", 1)[0]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1000


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['millrace', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name='millrace.llm' if name.startswith('millrace') else name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 40
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_imports_when_a_dependency_of_the_text_operators_is_missing():
    code = """
import sys
sys.modules['xxhash'] = None
import __spark_entry__ as e
assert not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 40
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_works_with_the_text_folders_deleted(tmp_path):
    """A copy without the two folders and the pipeline imports, and its other modules do too."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = """
import importlib, pkgutil, millrace
assert millrace.__file__.startswith(%r)
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and len(e.queries()) > 40
for m in pkgutil.walk_packages(millrace.__path__, 'millrace.'):
    if not m.name.endswith('__main__'):
        importlib.import_module(m.name)
""" % str(copy)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)})
