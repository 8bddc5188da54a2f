import pytest
from pyspark.sql import functions as F

from shelfmark import session as S


def test_lineage_is_cut_into_the_named_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "checkpoint_folder", lambda _: str(tmp_path / "shared"))
    kept = S.cut_lineage(spark.range(5))
    assert kept.count() == 5


def test_cluster_must_name_a_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default):
            return self.folder

    class Session:
        def __init__(self, folder):
            self.conf, self.sparkContext = Conf(folder), Context()

    assert S.checkpoint_folder(Session("hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.checkpoint_folder(Session(None))


def test_rows_are_kept_in_the_named_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "checkpoint_folder", lambda _: str(tmp_path / "shared"))
    kept = S.materialised(spark.range(5).withColumn("x", F.rand()), "rows")
    assert kept.collect() == kept.collect() and len(list((tmp_path / "shared").iterdir())) == 1
