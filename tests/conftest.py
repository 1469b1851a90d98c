import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from noticeflow.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of strings."""
    def run(make, items, kind="string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
        rows = df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"].asDict(True) if hasattr(r["y"], "asDict") else r["y"] for r in rows]
    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
