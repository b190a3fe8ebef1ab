"""The driver contract, with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as contract

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LISTED = """
import json, sys
sys.path.insert(0, {folder!r})
import __spark_entry__ as contract
print(json.dumps([contract.__file__, sorted(contract.queries()), sorted(contract.oracle_sql())]))
"""


def listed(folder):
    code = LISTED.format(folder=str(folder))
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=folder, check=True)
    import json

    where, queries, sql = json.loads(made.stdout.splitlines()[-1])
    assert where.startswith(str(folder))
    return set(queries), set(sql)


def test_without_the_training_data_operators(tmp_path):
    for variant, left in (("both", ()), ("pipeline", ("corpus_pipeline.py",))):
        folder = tmp_path / variant
        shutil.copytree(
            f"{HERE}/citewerk", folder / "citewerk", ignore=shutil.ignore_patterns("llm", "__pycache__")
        )
        for name in ("__spark_entry__.py", *left):
            if os.path.exists(f"{HERE}/{name}"):
                shutil.copy(f"{HERE}/{name}", folder / name)
        queries, sql = listed(folder)
        assert "hybrid_search" in queries and "hybrid_search" in sql
        assert not [n for n in queries | sql if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
