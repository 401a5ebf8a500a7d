from __future__ import annotations

import __spark_entry__ as entry


def test_windows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n, at in ((1, "one"), (40, "many")):
        (tmp_path / at).mkdir()
        events.repartition(n).write.parquet(f"{tmp_path}/{at}/events.parquet")
    one, many = (sorted(map(tuple, entry.queries()["stream_windows"](spark, f"{tmp_path}/{at}").collect())) for at in ("one", "many"))
    assert one and many == one
