import os

import pytest

from oracle import SF
from tidewell.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_whole_queries_cover_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    valued, every = events.where("value is not null").count(), events.count()
    for name, rows in (("projection_arithmetic_whole", valued), ("window_frames_whole", every), ("unnest_whole", 2 * every), ("scalar_functions_whole", every)):
        assert QUERIES[name](spark, SF).count() == rows, name
