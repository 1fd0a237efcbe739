"""Streaming jobs against batch results, late rows, repeats and restarts."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tollway.catalog import load
from tollway.streaming import budgets
from tollway.streaming.epochs import EpochTables
from tollway.streaming.retention import RetentionStream

START = datetime(2024, 1, 1)


def call(key, i, minute, cost, quote=0):
    return (key, f"c{i}", START + timedelta(minutes=minute), Decimal(quote), Decimal(cost))


TICK = (None, None, START + timedelta(days=900), None, None)


class Runs:
    """A stream that is stopped after each batch and goes on from its checkpoint."""

    def __init__(self, spark, folder, limit=10, delay="5 minutes", keep="1 hour"):
        self.spark, self.folder, self.limit, self.delay, self.keep = spark, folder, Decimal(limit), delay, keep

    def take(self, *rows):
        self.spark.createDataFrame(list(rows), budgets.CALL_FIELDS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(budgets.CALL_FIELDS).parquet(f"{self.folder}/in")
        settled = budgets.settle_stream(stream, self.limit, self.delay, self.keep)
        budgets.start(settled, f"{self.folder}/out", f"{self.folder}/progress").awaitTermination()

    def rows(self):
        found = budgets.settled_calls(self.spark, f"{self.folder}/out").collect()
        assert len(found) == len({(r["ledger_key"], r["call_id"]) for r in found})
        return {r["call_id"]: r for r in found}


def test_order_late_repeat_and_restart(spark, tmp_path):
    runs = Runs(spark, tmp_path)
    runs.take(call("a", 1, 2, 4), call("a", 2, 0, 3), call("b", 3, 1, 20))
    # Restart with newer rows: c1 comes again, the clock moves to minute 30.
    runs.take(call("a", 1, 2, 4), call("a", 4, 3, 5), call("a", 5, 30, 1))
    assert set(runs.rows()) == {"c1", "c2", "c3", "c4"}
    # Too late now: minute 10 lies before 30 - 5; c2 has been settled and comes again.
    runs.take(call("a", 6, 10, 1), call("a", 2, 0, 3), call("a", 7, 31, 1))
    runs.take(TICK)
    rows = runs.rows()
    assert len(rows) == 7
    assert [rows[c]["remaining_after"] for c in ("c2", "c1", "c4", "c5", "c7")] == [7, 3, 0, 0, 0]
    assert [rows[c]["over"] for c in ("c2", "c1", "c4", "c5", "c7")] == [False, False, True, True, True]
    assert rows["c3"]["over"] and rows["c3"]["remaining_after"] == 0
    assert rows["c6"]["late"] and rows["c6"]["charged"] == 0 and rows["c6"]["remaining_after"] is None


def test_refused_calls_leave_the_balance(spark, tmp_path):
    runs = Runs(spark, tmp_path, delay="1 minutes")
    runs.take(call("a", 1, 0, 8, 8), call("a", 2, 1, 5, 5), call("a", 3, 2, 2, 2), call("a", 4, 3, 1, 1), call(None, 5, 3, 4, 4), TICK)
    rows = runs.rows()
    assert [rows[f"c{i}"]["accepted"] for i in (1, 2, 3, 4, 5)] == [True, False, True, False, True]
    assert [rows[f"c{i}"]["remaining_after"] for i in (1, 2, 3, 4, 5)] == [2, 2, 0, 0, 6]


def test_repeats_and_late_ones_among_many_batches(spark, tmp_path):
    runs = Runs(spark, tmp_path, limit=100)
    runs.take(call("a", 1, 0, 1), call("a", 2, 60, 1), call("a", 2, 61, 1))
    runs.take(call("a", 3, 10, 5), call("a", 4, 58, 2), call("a", 1, 0, 1))
    runs.take(call("a", 5, 57, 7), call("a", 4, 58, 2), call("a", 3, 10, 5), call("a", 6, 62, 3))
    runs.take(TICK)
    spark_rows = budgets.settled_calls(spark, f"{tmp_path}/out").collect()
    charged = {r["call_id"]: r["remaining_after"] for r in spark_rows if not r["late"]}
    assert charged == {"c1": 99, "c5": 92, "c4": 90, "c2": 89, "c6": 86}
    # a late call is not remembered: its repeat is reported once more, and never charged
    assert [r["call_id"] for r in spark_rows if r["late"]] == ["c3", "c3"]


def test_names_are_forgotten_after_a_while(spark, tmp_path):
    runs = Runs(spark, tmp_path, keep="10 minutes")
    runs.take(call("a", 1, 0, 1), call("a", 2, 30, 1))
    runs.take(call("a", 3, 60, 1))
    runs.take(call("a", 1, 0, 1), call("a", 4, 61, 1))
    found = budgets.settled_calls(spark, f"{tmp_path}/out").collect()
    assert sorted((r["call_id"], r["late"]) for r in found) == [("c1", False), ("c1", True), ("c2", False)]


def test_ledgers_of_a_bucket_keep_their_own_balances_and_names(spark, tmp_path):
    def take(*rows):
        spark.createDataFrame(list(rows), budgets.CALL_FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(budgets.CALL_FIELDS).parquet(f"{tmp_path}/in")
        settled = budgets.settle_stream(stream, Decimal(10), "5 minutes", buckets=1)
        budgets.start(settled, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()

    keys = ["a", "b", None]
    take(*[call(k, 1, 0, 2 + i, 2 + i) for i, k in enumerate(keys)], call("a", 2, 30, 9, 9), call("b", 2, 30, 7, 7))
    take(call("a", 1, 0, 2, 2), call("c", 1, 0, 1, 1), TICK)
    found = budgets.settled_calls(spark, f"{tmp_path}/out").collect()
    got = {(r["ledger_key"], r["call_id"]): (r["late"], r["accepted"], r["remaining_after"]) for r in found}
    assert len(found) == len(got) == 6
    assert [got[k, "c1"] for k in keys] == [(False, True, 8), (False, True, 7), (False, True, 6)]
    assert got["a", "c2"] == (False, False, 8) and got["b", "c2"] == (False, True, 0) and got["c", "c1"] == (True, False, None)


def test_retention_carries_over(spark, tmp_path):
    schema = "tier string, ord bigint, realized decimal(28,12), quality decimal(20,12), oracle_quality decimal(20,12)"
    job = RetentionStream(EpochTables(str(tmp_path / "state")))
    rows = [("fast", i, Decimal(1), Decimal("0.5"), Decimal(1)) for i in range(6)]
    for epoch in range(3):
        job.process(spark.createDataFrame(rows[2 * epoch : 2 * epoch + 2], schema), epoch)
    got = job.steps(spark).orderBy("ord").collect()
    assert [r["running_cost"] for r in got] == [1, 2, 3, 4, 5, 6] and all(r["retention"] == 0.5 for r in got)


def test_retention_stops_at_steps_out_of_order(spark, tmp_path):
    schema = "tier string, ord bigint, realized decimal(28,12), quality decimal(20,12), oracle_quality decimal(20,12)"
    job = RetentionStream(EpochTables(str(tmp_path / "state")))
    row = lambda tier, i: (tier, i, Decimal(1), Decimal("0.5"), Decimal(1))
    job.process(spark.createDataFrame([row("fast", 5), row("slow", 1)], schema), 0)
    job.process(spark.createDataFrame([row("slow", 2)], schema), 1)
    with pytest.raises(ValueError, match="out of order"):
        job.process(spark.createDataFrame([row("fast", 4), row("slow", 3)], schema), 2)


@pytest.mark.parametrize("name", ["stream_retention", "stream_route_prompts"])
def test_streams_read_a_table_of_part_files(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    query = load().QUERIES[name]
    rows = lambda folder: sorted(map(repr, query(spark, str(folder)).collect()))
    parts = rows(tmp_path)
    assert parts and parts == rows(sf_dir)
