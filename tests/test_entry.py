"""The driver's entry: it imports without a session, with and without the corpus operators and their third-party modules."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["", "corpus_pipeline", "cliploom.llm", "ahocorasick", "regex", "tiktoken"])
def test_import(missing):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules.update({{{missing!r}: None}} if {missing!r} else {{}}); import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, timeout=120)
    n, known = done.stdout.split()
    assert int(n) >= 60 and known == "True", done.stderr


def test_other_missing_modules_are_errors():
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['pandas'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode != 0
