"""The entry works with and without the optional operators, and from any folder."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_optional_operators(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "factmark", tmp_path / "factmark",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); "
         "print(len(q) > 100, set(e.oracle_sql()) <= set(q), 'pipeline' in q)"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.stdout.split() == ["True", "True", "False"], told.stderr[-500:]


def test_workers_import_the_package_from_the_shipped_archive(spark):
    from factmark.session import ship_package
    ship_package(spark)
    ship_package(spark)  # once is enough

    def found(batches):
        import factmark.operators.sweep as module
        for batch in batches:
            yield batch.assign(n=len(module.MODES))

    assert spark.range(2).selectExpr("id AS n").mapInPandas(found, "n long").first().n == 3
