import os

from marginalia import scratch


def test_tables_go_with_the_session_or_when_told(spark):
    frame = scratch.written_once(spark.range(3))
    folder = scratch._root(spark)
    assert frame.count() == 3 and os.listdir(folder)
    files, path = scratch._files(spark, folder)
    # Registered with the driver's end; taken back only by being there.
    assert files.cancelDeleteOnExit(path)
    files.deleteOnExit(path)
    scratch.clear(spark)
    assert not os.path.exists(folder)
    assert scratch.written_once(spark.range(2)).count() == 2 and scratch._root(spark) != folder
