import pytest

from tessera import session as ss


def test_storage_settings():
    assert ss.storage_conf() == {}
    conf = ss.storage_conf("http://store:9000", "k", "s", "eu", allow_http=True, path_style=True)
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert ss.storage_conf("x", path_style=False)["spark.hadoop.fs.s3a.path.style.access"] == "false"
    assert all(isinstance(v, str) for v in conf.values())


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            return self.value or default

    class Fake:
        def __init__(self, master, value=None):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    with pytest.raises(RuntimeError, match="checkpoint"):
        ss.work_root(Fake("spark://host:7077"))
    assert ss.work_root(Fake("spark://host:7077", "s3a://bucket/work/")) == "s3a://bucket/work"
    assert ss.work_path(Fake("local[2]", "/shared"), "x").startswith("/shared/x-")
