import os
import threading

import pytest

from braidgraph.llm import storage


def test_scopes_of_two_threads_keep_apart(spark):
    """A scope that ends in one thread leaves the tables of another alone."""
    inside, done, kept = threading.Event(), threading.Event(), {}

    def other():
        with storage.scratch(spark) as keep:
            kept["table"] = storage.written(spark.range(3), "scope-other")
            inside.set()
            done.wait(60)
            assert kept["table"].count() == 3
            keep(kept["table"])

    worker = threading.Thread(target=other)
    worker.start()
    assert inside.wait(60)
    with storage.scratch(spark):
        mine = storage.written(spark.range(2), "scope-mine")
    assert not os.path.exists(mine.braid_path)
    done.set()
    worker.join()
    assert kept["table"].count() == 3


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
