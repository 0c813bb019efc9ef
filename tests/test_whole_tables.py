"""The queries of the image operators work on whole tables, not on fixed subsets of their ids."""

import pyarrow.parquet as pq
import pytest

from gridloom.plans import oracles, queries
from tests.compare import DATA, check

Q, SQL = queries.queries(), oracles.oracle_sql()


def test_detections_of_many_users(spark):
    check(spark, "r16_detections_collect", Q["r16_detections_collect"], SQL["r16_detections_collect"], DATA.replace("sf0.001", "sf0.01"))  # the smaller table has few users


@pytest.mark.parametrize("name", ["r24_image_kernels", "r24b_image_tiles"])
def test_every_part_has_a_raster(spark, name):
    parts = set(pq.read_table(f"{DATA}/part.parquet", columns=["p_partkey"]).column(0).to_pylist())
    assert len(parts) > 50 and {r.image_id for r in Q[name](spark, DATA).select("image_id").distinct().collect()} == parts
