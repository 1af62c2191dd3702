import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from grainmill.session import build_session  # noqa: E402

LIMITS = ("grainmill.maxGroupRows", "grainmill.exactPercentileRows", "grainmill.broadcastRows")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Force the plans meant for hot groups, long columns and large sides."""
    for name, value in zip(LIMITS, (50, 60, 5)):
        spark.conf.set(name, str(value))
    yield
    for name in LIMITS:
        spark.conf.unset(name)
