import pytest
from pyspark.sql import functions as F
from test_operators import PLAN, SOURCE

from tessera import service
from tessera.operators.embedding import embedded, vectors


# a lambda goes to the workers by value
sizes = lambda texts: [[len(t), t.count("e")] for t in texts]


@pytest.fixture
def tools(spark, tmp_path):
    rows = [("src/pipeline/queue.rs", SOURCE, 5), ("scripts/run.sh", "#!/bin/bash\necho 1\n", 5), ("docs/development/plans/VE-014-x.md", PLAN, 5)]
    tables = {"now": spark.createDataFrame(rows, "path string, content string, mtime_us long")}
    return tables, service.Tools(spark, str(tmp_path / "index"), lambda: tables["now"], sizes)


def test_search_answers(tools):
    tables, t = tools
    first = t.search("the LIMIT", 3)
    assert first["index"]["reindexed"] and first["index"]["files_changed_since_index"] == 0 and "hint" not in first
    assert len(first["results"]) == 3 and first["results"][0]["symbol"] == first["results"][0]["function"] == "LIMIT"
    assert set(first["results"][0]) == set(service.FIELDS)
    again = t.search("Shutdown", 1, path_prefix="nowhere/")
    assert again["results"] == [] and not again["index"]["reindexed"] and again["hint"] == service.NO_HITS
    assert t.search("Shutdown", 0)["results"] == []
    tables["now"] = tables["now"].withColumn("mtime_us", F.when(F.col("path").endswith(".sh"), 50).otherwise(5).cast("long"))
    later = t.search("Shutdown", 1, kind="nothing")
    assert later["index"]["reindexed"] and later["index"]["files_changed_since_index"] == 1 and later["hint"] == service.NO_HITS_AFTER_REFRESH
    assert t.reindex()["index"]["chunk_count"] == later["index"]["chunk_count"] > 5


def test_task_context_answers(tools):
    _, t = tools
    got = t.task_context("see ve-014", 6)
    assert got["touchpoints"]["symbols"] == ["Shutdown", "send_all", "send"] and "src/pipeline/queue.rs" in got["touchpoints"]["files"]
    reasons = [r["match_reasons"] for r in got["results"]]
    assert reasons[0] == ["task_doc"] and ["task_symbol:Shutdown"] in reasons and len(reasons) <= 6
    keys = [(r["path"], r["symbol"]) for r in got["results"]]
    assert len(set(keys)) == len(keys) and all("code" in r for r in got["results"])
    other = t.task_context("VE-999", 2)
    assert other["touchpoints"] == {"files": [], "symbols": []}
    with pytest.raises(ValueError, match="no task id"):
        t.task_context("014")


def test_vectors_keep_order_and_nulls(spark):
    assert vectors(sizes, []) == [] and vectors(sizes, ["e", "", "bee"], 2) == [[1.0, 1.0], [0.0, 0.0], [3.0, 2.0]]
    with pytest.raises(ValueError, match="1 vectors for 2"):
        vectors(lambda texts: [[0.0]], ["a", "b"])
    rows = spark.createDataFrame([(0, "ee"), (1, None), (2, "")], "k int, t string").coalesce(1)
    got = rows.withColumn("v", embedded(F.col("t"), sizes, 1)).orderBy("k").collect()
    assert [r.v for r in got] == [[2.0, 2.0], None, [0.0, 0.0]]
