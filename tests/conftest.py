import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankmill.session import build_session

    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """`rows(data, ddl)` makes a DataFrame spread over several partitions."""
    return lambda data, ddl: spark.createDataFrame(data, ddl).repartition(3)


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
