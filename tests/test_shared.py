"""The folder of intermediate tables."""

import os

from boundwright.sources import shared


def test_tables_are_written_read_and_released(spark):
    first = len(shared.WRITTEN)
    frames = [shared.written(spark.range(n), "numbers") for n in (3, 4, 5)]
    folders = [x.removeprefix("file://") for x in shared.WRITTEN[first:]]
    assert [f.count() for f in frames] == [3, 4, 5] and all(map(os.path.isdir, folders))
    assert shared.released(spark, first, 1) == first + 1
    assert list(map(os.path.isdir, folders)) == [False, False, True] and frames[2].count() == 5
    shared.released(spark, first)
    assert not os.path.isdir(folders[2]) and len(shared.WRITTEN) == first


def test_paths_keep_their_file_system(spark):
    assert shared.qualified(spark, "/a/b") == "file:///a/b" and shared.qualified(spark, "file:/a") == shared.qualified(spark, "file:///a") == "file:///a"


def test_views_of_the_session_are_left_alone(spark, sf_dir):
    from boundwright.sources.projections import view

    spark.range(7).createOrReplaceTempView("orders")
    assert view(spark, sf_dir, "alarms").count() > 7 and spark.table("orders").count() == 7
    spark.catalog.dropTempView("orders")
