"""Tables in the shared folder."""

import os

import pytest

from symtab import scratch


def test_discarded_tables_are_gone(spark):
    table = scratch.cut(spark.range(5), "some")
    folder = table.scratch_folder.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(folder)
    scratch.discard(table)
    assert not os.path.exists(folder)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch.scratch_path(Session(), "x")
