import pytest

from quillspark import session


class _Spark:
    """A session of another master, as far as ``shared_dir`` looks at it."""

    def __init__(self, **conf):
        self.values, self.conf = conf, self

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)

    def set(self, key, value):
        self.values[key.replace(".", "_")] = value


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]", None])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        session.shared_dir(_Spark(spark_master=master))
    assert session.shared_dir(_Spark(spark_master=master, spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"


def test_one_machine_has_its_own(spark):
    s = _Spark(spark_master="local[4]")
    assert session.shared_dir(s) == session.shared_dir(s)
    df = spark.range(10)
    assert sorted(r[0] for r in session.materialize(df).collect()) == list(range(10)) == sorted(r[0] for r in session.spread(df).collect())


def test_own_files_can_be_discarded(spark):
    import glob

    df = session.materialize(spark.range(3))
    mine = session.own_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    assert df.count() == 3 and glob.glob(mine + "/table-*")
    path = session.own_path(spark, "kept")
    spark.range(2).write.parquet(path)
    session.discard(spark)
    assert not glob.glob(mine + "/*")


def test_broadcasts_are_checked(spark):
    from pyspark.sql import functions as F

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    df = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 100))
    assert hinted(session.broadcast_if_small(df)) and not hinted(session.broadcast_if_small(df, rows=9))
    assert hinted(session.broadcast_if_small(df, size=F.length("t"))) and not hinted(session.broadcast_if_small(df, size=F.length("t").cast("long") * session.BROADCAST_BYTES))
    assert hinted(session.broadcast_if_small(df.limit(0), size=F.length("t")))
