"""The driver's contract, with and without the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run(
        [
            sys.executable,
            "-c",
            "import __spark_entry__ as e; print(sorted(e.queries())[:1], 'pipeline' in e.queries(), len(e.oracle_sql()) > 40)",
        ],
        cwd=tmp_path / "r",
        capture_output=True,
        text=True,
        check=True,
    )
    assert said.stdout.strip() == "['ask_flagship'] False True"


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and len({r["qid"] for r in rows}) == len(rows)
