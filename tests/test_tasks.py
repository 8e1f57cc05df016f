"""Tables behind the daily tasks are written once and read from there."""

from types import SimpleNamespace

from trailmesh.catalog import rewards as queries


def test_progress_derives_cells_and_tasks_once(spark, monkeypatch):
    calls, given = [], {}

    def counted(name, df):
        def make(*args):
            calls.append(name)
            return df
        return make

    row = spark.range(1).selectExpr("id", "id AS owner_id", "id AS session_id", "id AS cell_x", "id AS cell_y", "'close_loop' AS kind",
                                    "'a' AS district_id", "current_timestamp() AS started_at")
    for name in ("walked", "tasks", "states", "events"):
        monkeypatch.setattr(queries, name, counted(name, row))

    def progress(tasks, zones, cells, sessions, states, streets, events, medals, evidence):
        given.update(tasks=tasks, cells=cells)
        return tasks

    monkeypatch.setattr(queries.rewards, "task_progress", progress)
    data = SimpleNamespace(spark=spark, zones=row, sessions=row, streets=row, medals=row)
    out = queries.progress(data)
    assert sorted(calls) == ["events", "states", "tasks", "walked"]
    assert all(df.inputFiles() for df in (out, given["tasks"], given["cells"]))  # written tables, not plans to run again
