"""The entry points stand without the optional training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["veclens.llm", "corpus_pipeline", "zstandard"])
def test_entry_without_the_optional_part(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e;"
        "q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q);"
        "assert not [n for n in q if n == 'pipeline' or n.startswith('op')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
