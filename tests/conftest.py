from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("policyscan-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{shared}/")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


def executed_plan(df) -> str:
    """The plan that ran, without the initial one."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).toString()


def optimized_plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
