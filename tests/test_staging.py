import pytest

from tableprobe import staging


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    def __init__(self, **settings):
        self.conf = Conf({k.replace("_", "."): v for k, v in settings.items()})


def test_folder_of_the_session_is_used():
    assert staging.checkpoint_root(Session(spark_checkpoint_dir="/shared/x")) == "/shared/x"


def test_local_folder_only_in_local_mode():
    first = staging.checkpoint_root(Session(spark_master="local[2]"))
    assert first == staging.checkpoint_root(Session(spark_master="local[2]"))
    with pytest.raises(RuntimeError):
        staging.checkpoint_root(Session(spark_master="yarn"))


def test_tables_are_written_once(spark):
    stage = staging.Stage(spark)
    first = stage.table("t", lambda: spark.range(5))
    assert stage.table("t", lambda: spark.range(9)).count() == 5 and "t" in stage
    assert first.inputFiles()[0].endswith(".parquet")
    assert stage.small("s", lambda: spark.range(3)).count() == 3


def test_threads_share_one_build(spark):
    from concurrent.futures import ThreadPoolExecutor

    stage, built = staging.Stage(spark), []

    def build():
        built.append(1)
        return spark.range(3)

    with ThreadPoolExecutor(4) as pool:
        tables = [f.result() for f in [pool.submit(stage.table, "t", build) for _ in range(4)]]
    assert len(built) == 1 and all(t.count() == 3 for t in tables)
