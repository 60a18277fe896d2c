"""Versions of tables: order, refusal, and what a failing step leaves."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators.versions import Step, Store, VersionError

STEPS = [
    Step(1, "add tool", lambda t: {"messages": t["messages"].withColumn("tool", F.lit(None).cast("string"))}),
    Step(2, "split roles", lambda t: {"roles": t["messages"].select("role").distinct(), "notes": None}),
    Step(3, "number", lambda t: {"messages": t["messages"].withColumn("id", F.col("id").cast("long"))}),
]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create({"messages": spark.createDataFrame([("1", "user"), ("2", None)], "id string, role string"), "notes": spark.createDataFrame([], "x int")})
    return s


def test_steps_in_order(spark, store):
    assert (store.version(), store.tables()["notes"].columns) == (0, ["x"])
    assert store.apply(STEPS[:1]) == [1] and store.apply([STEPS[2], STEPS[0], STEPS[1]]) == [2, 3] and store.apply(STEPS) == []
    now = store.tables()
    assert set(now) == {"messages", "roles"} and dict(now["messages"].dtypes) == {"id": "bigint", "role": "string", "tool": "string"}
    assert sorted(r.id for r in now["messages"].collect()) == [1, 2] and now["roles"].count() == 2
    # What a step doesn't name keeps its files, and older versions stay as they were.
    assert store.entry(2)["tables"]["messages"] == store.entry(1)["tables"]["messages"]
    assert set(store.tables(0)) == {"messages", "notes"} and store.tables(0)["messages"].columns == ["id", "role"]
    assert [(r.number, r.name, r.n_tables) for r in store.history().orderBy("number").collect()] == [(0, "start", 2), (1, "add tool", 2), (2, "split roles", 2), (3, "number", 2)]
    assert store.unnamed() == [] and Store(spark, store.folder).version() == 3


def test_failing_step(spark, store):
    """A step that fails while its second table is written leaves the version before; once mended it is applied."""
    broken = Step(2, "broken", lambda t: {"roles": t["messages"].select("role"), "messages": t["messages"].withColumn("id", F.raise_error(F.lit("no")))})
    with pytest.raises(Exception, match="no"):
        store.apply([STEPS[0], broken])
    assert store.version() == 1 and store.tables()["messages"].count() == 2 and "roles" not in store.tables()
    assert len(store.unnamed()) == 1 and store.unnamed()[0].startswith("000002-")
    assert store.apply(STEPS) == [2, 3]


def test_refusals(spark, store, tmp_path):
    with pytest.raises(VersionError, match="numbered"):
        store.apply([STEPS[0], STEPS[2]])
    with pytest.raises(VersionError, match="numbered"):
        store.apply([STEPS[0], STEPS[0]])
    store.apply(STEPS[:2])
    with pytest.raises(VersionError, match="version 2"):
        store.apply(STEPS[:1])
    with pytest.raises(VersionError, match="applied as"):
        store.apply([STEPS[0], Step(2, "other", STEPS[1].change)])
    with pytest.raises(VersionError, match="already"):
        store.create({})
    with pytest.raises(VersionError, match="no store"):
        Store(spark, f"{tmp_path}/none").apply(STEPS)


def test_two_jobs(spark, store):
    """Of two jobs at one step the later is told, and the tables are those of the first."""

    def late(t):
        store.apply(STEPS[:1])
        return {"messages": t["messages"].withColumn("late", F.lit(1))}

    with pytest.raises(VersionError, match="another job"):
        Store(spark, store.folder).apply([Step(1, "add tool", late)])
    assert store.tables()["messages"].columns == ["id", "role", "tool"]
