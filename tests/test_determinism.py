"""Order-sensitive operators give the same result whatever the partitioning."""
import pytest

import __spark_entry__ as E

from conftest import SF001

NAMES = ["W5_three_way_split", "W6_shuffle_into_batches", "J6_zip_by_position", "X11_encode_fixed_length",
         "A16_wilcoxon_signed_rank", "A25_best_epoch", "T1_debug_subset", "S4_read_jsonl_shards"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_over_partitionings(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = E.queries()[name](spark, SF001)
            results.append(sorted(map(repr, df.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
