import pytest

from vigilframe import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": configured}


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(Session(master))
        assert session.checkpoint_dir(Session(master, "/shared")) == "/shared"


def test_threads_of_the_driver_may_use_a_scratch_folder():
    assert "vigilframe-checkpoint-" in session.checkpoint_dir(Session("local[4]"))
