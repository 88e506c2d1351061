import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["config", "query_id", "n_gold"] and rows.count() > 0


def test_nothing_else_imports_the_training_text_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "lexmill")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "lexmill.llm" not in f.read(), name


def test_core_queries_survive_a_missing_library():
    """Without a library of the training-text package its queries are left out, and no others."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('p1_') for n in q), set(e.oracle_sql()) <= set(q))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["False", "True"]


def test_staged_tables_need_shared_storage_off_local_masters():
    from types import SimpleNamespace

    from lexmill.plans.stage import shared_folder

    unset = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_staged_tables_are_dropped_with_their_scope(spark):
    from lexmill.plans.stage import stage, staged_scope

    with staged_scope(spark):
        table = stage(spark.range(5), "scoped")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    from lexmill.plans.stage import release

    first = stage(spark.range(5), "first")
    second = stage(first.selectExpr("id + 1 AS id"), "second")
    path = first.inputFiles()[0].removeprefix("file://")
    release(first, stage(spark.range(0), "none"))
    assert not os.path.exists(path) and second.count() == 5
