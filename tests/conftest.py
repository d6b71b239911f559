import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

EVENT_FIELDS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build a small events frame: (time, type, user, session, price, product, category, brand), later parts optional."""

    def build(rows):
        full = []
        for number, row in enumerate(rows):
            time, kind, user, session, price, product, code, brand = (
                tuple(row) + (10.0, 1, "electronics.phone", "acme")[len(row) - 4:] if len(row) < 8 else tuple(row)
            )
            if isinstance(time, str):
                time = datetime.fromisoformat(time)
            full.append((number, time, kind, product, code, brand, float(price), user, session))
        return spark.createDataFrame(full, EVENT_FIELDS)

    return build
