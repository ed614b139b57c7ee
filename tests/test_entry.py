"""The entry module with and without the optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(sum(n[:2] == 'op' for n in e.queries()), len(e.queries()))"


def counted(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True,
                          text=True, timeout=120, check=True)
    return [int(x) for x in done.stdout.split()]


def test_without_a_library_of_the_optional_part():
    ops, every = counted(ROOT, "import sys; sys.modules['public_tokenizers'] = None; ")
    assert ops == 0 and every > 90


def test_without_the_optional_part(tmp_path):
    for name in ("sparkreel", "workload"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name,
                        ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    ops, every = counted(tmp_path)
    assert ops == 0 and every > 90
