import os

from feltgrid.operators import stage


class FakeConf:
    def __init__(self, values):
        self.values = values

    def get(self, key, *default):
        return self.values.get(key, *default)


class FakeSession:
    def __init__(self, **values):
        self.conf = FakeConf({k.replace("_", "."): v for k, v in values.items()})
        self.sparkContext = type("Context", (), {"applicationId": "app-1"})()


def test_folder_comes_from_the_session():
    both = FakeSession(spark_checkpoint_dir="hdfs://shared/c/", spark_sql_warehouse_dir="hdfs://shared/w")
    assert stage.stage_folder(both) == "hdfs://shared/c/feltgrid/app-1"
    assert stage.new_path(both).startswith("hdfs://shared/c/feltgrid/app-1/")
    assert stage.stage_folder(FakeSession(spark_sql_warehouse_dir="hdfs://shared/w")) == "hdfs://shared/w/feltgrid/app-1"


def test_stage_and_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "stage_folder", lambda _: str(tmp_path / "feltgrid"))
    df = stage.stage(spark.range(10))
    assert df.count() == 10 and os.path.exists(tmp_path / "feltgrid")
    assert stage.clear_stage(spark)
    assert not os.path.exists(tmp_path / "feltgrid")
