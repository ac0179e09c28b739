"""Generations of a table, staged ingestion over them, late rows, and quotas whose answers depend on those before."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.sources.generations import Generations
from brindle.streaming import events, stages

SCHEMA = "doc_id long, block int, text string"


def blocks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def all_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_replacement_leaves_other_documents(spark, tmp_path):
    table = Generations(spark, str(tmp_path), SCHEMA, "doc_id", 4)
    assert table.manifest() is None and table.read().count() == 0
    table.replace(blocks(spark, [(i, 1, "a") for i in range(20)] + [(None, 1, "null")]))
    table.replace(blocks(spark, [(3, 1, "b"), (3, 2, "c")]), maker="x")
    want = [(i, 1, "a") for i in range(20) if i != 3] + [(3, 1, "b"), (3, 2, "c"), (None, 1, "null")]
    assert all_of(table.read()) == sorted(want, key=repr) and table.manifest().note == {"maker": "x"} and table.manifest().number == 2
    table.replace(blocks(spark, []), blocks(spark, [(3, 0, ""), (None, 0, ""), (99, 0, "")]))
    assert all_of(table.read()) == sorted((x for x in want if x[0] not in (3, None)), key=repr)


def test_a_reader_sees_one_generation_whole(spark, tmp_path):
    table = Generations(spark, str(tmp_path), SCHEMA, "doc_id", 2)
    first = table.replace(blocks(spark, [(1, 1, "old"), (2, 1, "old")]))
    pinned = table.read(first)
    table.replace(blocks(spark, [(1, 1, "new"), (2, 1, "new")]))
    assert {r.text for r in pinned.collect()} == {"old"} and {r.text for r in table.read().collect()} == {"new"}
    table.replace(blocks(spark, [(1, 1, "newest")]))
    table.vacuum(keep=1)
    assert all_of(table.read()) == [(1, 1, "newest"), (2, 1, "new")]
    with pytest.raises(Exception):
        pinned.collect()


def test_a_failed_replacement_changes_nothing(spark, tmp_path):
    table = Generations(spark, str(tmp_path), SCHEMA, "doc_id", 2)
    table.replace(blocks(spark, [(1, 1, "old")]))
    bad = blocks(spark, [(1, 1, "new")]).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        table.replace(bad)
    assert all_of(table.read()) == [(1, 1, "old")] and len(list((tmp_path / "data").iterdir())) == 1


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    one, two = (Generations(spark, str(tmp_path), SCHEMA, "doc_id", 2) for _ in range(2))
    one.replace(blocks(spark, [(1, 1, "a")]))
    before = two.manifest()
    one.replace(blocks(spark, [(1, 1, "b")]))
    monkeypatch.setattr(two, "manifest", lambda number=None: before)
    with pytest.raises(FileExistsError):
        two.replace(blocks(spark, [(1, 1, "c")]))
    assert all_of(one.read()) == [(1, 1, "b")] and len(list((tmp_path / "data").iterdir())) == 2


def test_late_rows_are_stored(spark, tmp_path):
    """Three files, the third ten days older and with a row of the first; then a row without a key and one without a time, twice."""
    rows = spark.sql("select id event_id, id % 3 user_id, 'a' event_type, cast(id as double) value, timestamp_ntz'2024-02-01' + make_dt_interval(0, 0, id, 0) ts from range(30)")
    old = rows.where("event_id >= 20").withColumn("ts", F.expr("ts - interval 10 days"))
    odd = rows.limit(1).withColumn("event_id", F.lit(None).cast("long")).unionByName(rows.limit(1).withColumns({"event_id": F.lit(99).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")}))
    for part in (rows.where("event_id < 10"), rows.where("event_id between 8 and 19"), old.unionByName(rows.where("event_id = 3")), odd, odd):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = str(tmp_path / "out")
    events.ingest(events.read_events(spark, str(tmp_path), 1), out, str(tmp_path / "state")).awaitTermination()
    got = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(x for x in got if x is not None) == [*range(30), 99] and got.count(None) == 2


REPORTS = "doc_id long, generation long, stage string, ok boolean, ts timestamp"


def reported(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, generation long, stage string, ok boolean, at long").select("doc_id", "generation", "stage", "ok", F.timestamp_seconds(F.col("at")).alias("ts"))


def states(df):
    return {r.doc_id: (r.generation, r.passed, r.status) for r in stages.status(df).collect()}


def test_states_by_reports(spark):
    rows = [(1, 0, s, True, 5) for s in stages.STAGES] + [(2, 0, "upload", True, 5), (2, 0, "parse", False, 6), (3, 0, "parse", True, 5), (4, 0, "upload", True, 5)]
    rows += [(4, 1, "upload", True, 9), (4, 1, "parse", False, 9), (4, 1, "parse", True, 10), (5, 0, "else", True, 1), (None, 0, "upload", True, 1), (6, None, "upload", True, 1), (7, 2, "upload", None, 1)]
    state = stages.folded(reported(spark, rows))
    assert states(state) == {1: (0, 5, "READY"), 2: (0, 1, "FAILED"), 3: (0, 0, "NEW"), 4: (1, 2, "CHUNKING"), 7: (2, 0, "FAILED")}
    assert {r.doc_id for r in stages.waiting(state, "chunk").collect()} == {4} and {r.doc_id for r in stages.waiting(state, "parse").collect()} == set()


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 0, 0, 2, 1, 3)])
def test_batches_in_any_order_give_one_table(spark, tmp_path, order):
    """Late, repeated and replayed batches: the table is that of all reports; what is late is listed, too."""
    draw = random.Random(5)
    parts = [[(draw.randrange(12), draw.randrange(2), draw.choice(stages.STAGES), draw.random() < 0.8, 1_000_000 * (k + 1)) for _ in range(40)] for k in range(4)]
    for k in order:
        reported(spark, parts[k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    want = states(stages.folded(reported(spark, [r for p in parts for r in p])))
    for _ in range(2):  # the second time with a checkpoint that is lost: all batches come again
        stages.staged(stream, out, str(tmp_path / f"state{_}"), late=500_000.0).awaitTermination()
        table = stages.table(spark, f"{out}/state")
        assert states(table.read()) == want and table.manifest().note["batch"] == len(order) - 1
    if order[0] == 3:
        assert spark.read.parquet(f"{out}/late").count() == 40 * 4


def by_hand(rows, quotas):
    held, out = {}, []
    for key, at, n in rows:
        own = held.setdefault(key, [[] for _ in quotas])
        state, wait = "granted", 0
        if at is None or n is None or n < 1:
            state = "exhausted"
        else:
            for q, h in zip(quotas, own):
                h[:] = [x for x in h if x > at - q.seconds * 10**6]
                if len(h) + n > q.most:
                    state, wait = ("exhausted", 0) if q.final or not h else ("wait", max(1, -((at - h[0] - q.seconds * 10**6) // 10**6)))
                    break
            else:
                for h in own:
                    h += [at] * n
        out.append((state, wait))
    return out


@pytest.mark.parametrize("quotas", [(events.Quota(60, 3), events.Quota(600, 8, final=True)), (events.Quota(5, 1),)])
def test_only_grants_count(spark, quotas):
    draw, rows, at = random.Random(6), [], 0
    for i in range(3000):
        at += draw.choice([0, 100_000, 1_000_000, 40_000_000])
        rows.append((draw.choice([None, 1, 1, 1, 2]), at, draw.choice([1, 1, 2, 4, 0, None])))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, key long, at long, n long").select("id", "key", F.timestamp_micros("at").alias("ts"), "n").repartition(5)
    got = {r.id: (r.state, r.wait_seconds) for r in events.admissions(df, "key", "ts", "id", quotas, count="n").collect()}
    assert [got[i] for i in range(len(rows))] == by_hand(rows, quotas)
    assert {s for s, _ in got.values()} >= {"granted", "wait"}
