from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from marketpulse import build_session
from marketpulse.schemas import LISTING, SALE

T0 = dt.datetime(2025, 9, 1, 10, 0)
CARD = "moor-31"
KEY = f"{CARD}|HOLOFOIL|NM"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sales(spark):
    """Build sales of one ticker from (price, minutes after T0[, quantity])."""

    def build(*rows, card=CARD):
        data = []
        for i, row in enumerate(rows):
            price, minutes, quantity = (*row, 1)[:3]
            at = T0 + dt.timedelta(minutes=minutes)
            data.append(
                (f"sim:{i:04d}", "sim", card, "HOLOFOIL", "NM", Decimal(str(price)), quantity, at)
            )
        return spark.createDataFrame(data, SALE).withColumn("market_key", _key())

    return build


@pytest.fixture
def listings(spark):
    def build(*rows, card=CARD):
        data = [
            (
                f"sim:l{i:04d}", "sim", card, "HOLOFOIL", "NM", Decimal(str(price)), 1, "s-1",
                T0 + dt.timedelta(minutes=minutes),
            )
            for i, (price, minutes) in enumerate(rows)
        ]
        return spark.createDataFrame(data, LISTING).withColumn("market_key", _key())

    return build


def _key():
    from marketpulse.functions.keys import market_key

    return market_key()
