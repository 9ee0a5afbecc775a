import threading

import pytest

from quadloom.plans import scratch


class Elsewhere:
    """A session whose master is not this machine and that names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:  # noqa: N801
        applicationId = "app"  # noqa: N815
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match=r"spark.checkpoint.dir"):
        scratch.scratch_root(Elsewhere)


def test_scope_frees_its_own_tables(spark):
    kept = scratch.materialize(spark.range(3), "kept")
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        inner = scratch.materialize(spark.range(5), "inner")
        with scratch.scope(spark):
            deep = scratch.materialize(spark.range(7), "deep")
            assert deep.count() == 7
        assert inner.count() == 5
        with pytest.raises(Exception, match=r"(?i)exist|file"):
            deep.count()
        raise ZeroDivisionError
    with pytest.raises(Exception, match=r"(?i)exist|file"):
        inner.count()
    assert kept.count() == 3


def test_writes_of_several_threads_leave_the_setting(spark):
    spark.conf.unset(scratch.CLEAN)
    before = spark.conf.get(scratch.CLEAN, None)
    failed = []

    def write(n):
        try:
            assert scratch.materialize(spark.range(n).repartition(2), "t").count() == n
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and spark.conf.get(scratch.CLEAN, None) == before and not scratch._WRITING
