import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartwheel.session import build_session  # noqa: E402

SCHEMA = "t_dat date, customer_id string, article_id string, price double, sales_channel_id int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "6g",
                                                    "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Build transactions from (day, customer, article[, price[, channel]]) tuples."""
    def build(rows):
        full = [(dt.date.fromisoformat(r[0]), r[1], r[2], *(r[3:4] or (1.0,)), *(r[4:5] or (1,))) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def rows():
    """A frame as a sorted list of plain tuples."""
    def collect(frame, *columns):
        picked = frame.select(*columns) if columns else frame
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect
