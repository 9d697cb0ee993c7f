import pytest

from veyra import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, where=None, master="local[2]"):
        self.master = master
        self.conf = Conf({"spark.checkpoint.dir": where} if where else {})
        self.sparkContext = self

    def getConf(self):
        return Conf()


def test_shared_folder_is_the_cluster_s_own_where_it_names_one():
    assert session.shared_dir(Fake("file:///shared/x/")) == "file:///shared/x"


def test_a_folder_of_this_machine_only_where_none_is_named():
    a, b = session.shared_dir(Fake()), session.shared_dir(Fake())
    assert a == b and "veyra-stage-" in a


def test_no_folder_of_one_machine_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(Fake(master="spark://x:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(Fake(master="local-cluster[3,2,1024]"))


def test_staged_tables_keep_schema_rows_and_lineage_short(spark):
    df = spark.range(10).selectExpr("id", "id % 3 as k", "cast(null as string) as s")
    out = session.stage(df)
    assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert "Range" not in out._jdf.queryExecution().toString()
