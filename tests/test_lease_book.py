"""Leases folded into a table: the rule of the keyed stream, with no Python call for a lease."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolemill.streaming import jobs as S
from tests.test_streams import at


class Book:
    def __init__(self, spark, root, keep):
        self.spark, self.root, self.keep = spark, str(root), keep

    def add(self, rows):
        kind = "lease_id string, state string, at timestamp"
        self.spark.createDataFrame(rows, kind.replace("timestamp", "string")).coalesce(1).write.mode("append").json(f"{self.root}/in")
        S.fold_leases(S.read_folder(self.spark, f"{self.root}/in", kind, "json"), f"{self.root}/book", f"{self.root}/check", 240, "1 hour", self.keep)
        out = S.read_changes(self.spark, f"{self.root}/book/changes", StructType.fromDDL(S.OUTCOME))
        return {r.lease_id: r.state for r in S.latest(out, "lease_id", "ended_at").collect()}


def test_same_outcomes_as_the_keyed_stream(spark, tmp_path):
    work = Book(spark, tmp_path, 20)
    assert work.add([("a", "leased", at(0)), ("b", "leased", at(1)), ("c", "leased", at(6)), ("e", "saved", at(5.5))]) == {"a": "expired", "b": "expired", "e": "saved"}
    second = work.add([("c", "saved", at(8)), ("a", "saved", at(9)), ("d", "leased", at(9)), ("d", "leased", at(8.5))])
    assert second == {"a": "expired", "b": "expired", "c": "saved", "e": "saved"}
    assert work.add([("z", "leased", at(14)), (None, "leased", at(14)), ("late", "leased", at(1))])["d"] == "expired"
    work.add([("y", "leased", at(12, "2024-01-02"))])
    work.add([("x", "leased", at(12.5, "2024-01-02"))])
    left = {r.lease_id for turn in (0, 1) for r in spark.read.parquet(f"{tmp_path}/book/leases-{turn}").filter("due + INTERVAL 20 HOUR > '2024-01-02T11:00:00Z'").collect()}
    assert left == {"x", "y", "z"}  # all others have left their 20 hours behind


def test_random_arrivals_within_the_watermark(spark, tmp_path):
    rng = random.Random(4)
    events = []
    for i in range(300):
        start = rng.random() * 18
        if rng.random() < 0.9:
            events.append((f"l{i}", "leased", round(start, 2)))
        if rng.random() < 0.6:
            events.append((f"l{i}", rng.choice(["saved", "failed"]), round(start + rng.random() * 5, 2)))
    order = sorted(events, key=lambda e: e[2] + rng.random() * 0.9)  # none is later than the hour
    work = Book(spark, tmp_path, 72)
    text = lambda e: (e[0], e[1], at(e[2]))
    for part in range(4):
        got = work.add([text(e) for e in order[part * len(order) // 4 : (part + 1) * len(order) // 4]])
    want, minute = {}, lambda hours: int(hours) * 60 + round(hours % 1 * 60)
    last = max(minute(e[2]) for e in events)
    for name in {e[0] for e in events}:
        begun = min((minute(h) for n, s, h in events if n == name and s == "leased"), default=None)
        end = min(((minute(h), s) for n, s, h in events if n == name and s != "leased"), default=None)
        if end and (begun is None or end[0] <= begun + 240):
            want[name] = end[1]
        elif begun + 240 <= last - 60:
            want[name] = "expired"
    assert got == want
