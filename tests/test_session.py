import os

import pytest

from locusforge import session


def test_scratch_paths_are_fresh(spark):
    a, b = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert a != b and spark.conf.get("spark.checkpoint.dir") in a


def test_scratch_is_released(spark):
    path = session.scratch_path(spark, "released")
    spark.range(3).write.parquet(path)
    kept, session._scratch[:] = list(session._scratch), [path]
    assert session.release_scratch(spark) == 1
    session._scratch[:] = [p for p in kept if p != path]
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
