import glob
import os

import pytest

from tidemark.sources import records


def test_published_tables_are_whole_or_refused(spark, tmp_path):
    d = spark.createDataFrame([(i, f"x{i}", None) for i in range(50)], "id long, name string, note string").repartition(4)
    path = f"{tmp_path}/out"
    told = records.publish(d, path, {"source": "abc"})
    assert told["records"] == "50" and os.listdir(tmp_path) == ["out"]
    back = records.read_published(spark, path, {"source": "abc"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    # the digest depends on the records alone, not on their order or files
    again = records.publish(d.coalesce(1).orderBy("name"), f"{tmp_path}/again")
    assert again["digest"] == told["digest"]
    with pytest.raises(FileExistsError):
        records.publish(d, path)
    with pytest.raises(records.TornPublish, match="upstream.source"):
        records.read_published(spark, path, {"source": "other"})
    os.remove(glob.glob(f"{path}/part-*.parquet")[0])
    with pytest.raises(records.TornPublish, match="digest, records"):
        records.read_published(spark, path)


def test_no_sidecar_and_no_rows(spark, tmp_path):
    d = spark.range(3)
    d.write.parquet(f"{tmp_path}/plain")
    with pytest.raises(records.TornPublish, match="no sidecar"):
        records.read_published(spark, f"{tmp_path}/plain")
    records.publish(d.where("id > 9"), f"{tmp_path}/none")
    assert records.read_published(spark, f"{tmp_path}/none").count() == 0
    d.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/none/extra")
    os.rename(glob.glob(f"{tmp_path}/none/extra/part-*.parquet")[0], f"{tmp_path}/none/part-9.parquet")
    with pytest.raises(records.TornPublish):
        records.read_published(spark, f"{tmp_path}/none")
