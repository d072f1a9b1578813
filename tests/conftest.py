import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kinweave.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "tolist") or isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(pdf):
    """Rows with columns in name order, sorted, floats rounded."""
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr([plain(x) for x in r]) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(spark, duck, query, sql):
        mine, theirs = query(spark, DATA).toPandas(), duck.sql(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows_of(mine) == rows_of(theirs)

    return check
