import pytest

from docloom.llm import _shared


def test_sizes():
    assert [_shared.size_of(x) for x in ("8388608", "64m", "64MB", " 1gb", "7b", "-1")] == [8388608, 64 << 20, 64 << 20, 1 << 30, 7, -1]
    with pytest.raises(ValueError):
        _shared.size_of("many")


def test_batches_are_small_whatever_the_setting(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for value, expected in (("64m", str(8 << 20)), ("1m", "1m"), (str(1 << 30), str(8 << 20))):
        spark.conf.set(name, value)
        _shared.small_batches(spark)
        assert spark.conf.get(name) == expected


class _Elsewhere:
    """A session on a cluster without a shared folder."""

    master = "spark://host:7077"

    def get(self, name, default=None):
        return default

    def getConf(self):  # noqa: N802
        return self

    conf = sparkContext = property(lambda self: self)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(_Elsewhere())


def test_written_tables_lie_in_the_shared_folder(spark):
    made = _shared.written(spark.range(3), "three")
    assert _shared.shared_dir(spark).rstrip("/").removeprefix("file://") in made._docloom_path and made.count() == 3
    _shared.drop_written(made)
    assert len(spark.sparkContext._jsc.sc().getConf().getAppId()) > 0
