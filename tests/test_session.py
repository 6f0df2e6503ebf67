import pytest

from footfall.session import shared_folder, size_settings
from footfall import session

TB = 2**40


@pytest.mark.parametrize("size, partitions", [(1, 200), (TB, 4096), (10 * TB, 40_960), (100 * TB, 409_600)])
def test_sizes_follow_the_data(size, partitions):
    assert size_settings(size) == {"spark.sql.shuffle.partitions": str(partitions)}


def test_shared_folder_is_below_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "store"), shared_folder(spark, "store")
    assert first.startswith(root + "/store-") and first != second


def test_shuffles_of_a_written_table_go_with_it(spark):
    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {part for part in found.mkString(" ").split() if part.startswith("shuffle_")}

    before = blocks()
    settings = spark.conf.getAll
    frame = session.written(spark.range(1000).repartition(3, "id"), "test")
    assert blocks() <= before and spark.conf.getAll == settings
    assert frame.count() == 1000
