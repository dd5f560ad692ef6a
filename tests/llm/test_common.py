import pytest

from tidelog.llm import common


class Session:
    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    assert common.shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    assert common.shared_dir(Session(spark_master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(spark_master=master))
