import os

import pytest

import __spark_entry__
from kinweave.plans import catalog

#: One or two of each kind; bench.py and the driver run all of them.
CHECKED = ["clean_name", "fingerprint", "block_keys", "block_drop", "overgenerate", "key_recall", "hard_negatives", "jaro_winkler_sim", "bm25", "sweep_country", "choose_thresholds", "forced_positives", "strat_split", "canonical_map", "bad_prefix", "link_records"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, same, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_it_works_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = str(catalog.__file__).rsplit("/kinweave/", 1)[0]
    shutil.copytree(f"{root}/kinweave", tmp_path / "kinweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(catalog.QUERIES), out.stderr
