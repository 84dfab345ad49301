"""Streams over several micro-batches against the batch operators."""

import random
from datetime import datetime, timedelta

from linespan.operators import filters as X
from linespan.streaming import budget as B
from linespan.streaming import stamps as T
from linespan.streaming import usage as U

NOW = datetime(2026, 1, 2)
LINE = "file_id long, n long, text string, ts timestamp"


def _lines(file_id, n):
    start = datetime(2024, 1, 1)
    at = lambda i: start + timedelta(minutes=i)
    return [(file_id, i, f"{at(i):%Y-%m-%d %H:%M:%S} x" if i % 4 == 1 else "  more", at(i)) for i in range(n)]


def _streamed(spark, tmp_path, batches, delay):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return U.run_once(T.tell_stamps(stream, delay, now=NOW)).collect()


def test_unordered_lines_are_told_as_in_a_batch(spark, tmp_path):
    """Lines within the delay come in any order, over many micro-batches; each is told once, with the batch's stamp."""
    r = random.Random(2)
    rows = _lines(1, 200) + _lines(2, 150)
    late_by = {id(x): (x[3] - datetime(2024, 1, 1)).total_seconds() / 60 + r.uniform(0, 25) for x in rows}
    rows.sort(key=lambda x: late_by[id(x)])
    batches = [rows[k : k + 50] for k in range(0, len(rows), 50)]
    end = [(9, 0, "end", datetime(2024, 1, 3))]  # moves the watermark beyond all lines
    got = _streamed(spark, tmp_path, [*batches, end], "30 minutes")
    want = X.carry_stamp(spark.createDataFrame(rows, LINE).select("file_id", "n", "text"), now=NOW).collect()
    assert not any(x["late"] for x in got)
    assert sorted((x["file_id"], x["n"], x["own"], x["stamp"]) for x in got if x["file_id"] != 9) == sorted(((x["file_id"], x["n"], x["own"], x["stamp"]) for x in want), key=lambda t: t[:2])


def test_a_line_behind_told_ones_is_marked(spark, tmp_path):
    """Line 3 is written days after the others were told; one that comes behind the watermark is Spark's to drop."""
    day = lambda k: (9, k, "end", datetime(2024, 1, 3 + k))
    rows = _lines(1, 40)
    early, behind = [x for x in rows if x[1] not in (3, 4)], (1, 3, "2024-01-04 12:00:00 x", datetime(2024, 1, 4, 12))
    got = {(x["file_id"], x["n"]): x for x in _streamed(spark, tmp_path, [early, [day(0)], [day(1), rows[4], behind], [day(2)], [day(3)]], "10 minutes")}
    assert got[1, 3]["late"] and got[1, 3]["stamp"] == got[1, 3]["own"] and not got[1, 39]["late"]
    assert len([k for k in got if k[0] == 1]) == 39 and (1, 4) not in got


def test_reservations_in_any_order_of_arrival(spark, tmp_path):
    """Against a plain walk in the order of time: grants, settlements, unreadable costs, days, open reservations."""
    r, hour = random.Random(6), timedelta(hours=1)
    start, rows = datetime(2024, 1, 1), []
    for user in (1, 2):
        for job in range(60):
            at = start + r.random() * 60 * hour
            rows.append((user, len(rows), job, False, r.choice([10, 40, 90, None, -1]), at))
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                rows.append((user, len(rows), job, True, r.choice([5, 30, None, -3]), at + r.random() * 20 * hour))
    want, day_of = [], lambda t: (t - start).days
    for user in (1, 2):
        spent, day, held = 0, 0, {}
        for _, seq, job, settles, cents, at in sorted((x for x in rows if x[0] == user), key=lambda x: (x[5], x[1])):
            if day_of(at) != day:
                day, spent = day_of(at), 0
            granted = None
            if not settles:
                granted = cents is not None and cents >= 0 and job not in held and spent + sum(c for c, _ in held.values()) + cents <= 200
                if granted:
                    held[job] = (cents, day)
            elif job in held:
                amount, when = held.pop(job)
                if when == day:
                    spent += cents if cents is not None and cents >= 0 else amount
            want.append((user, seq, granted, spent, sum(c for c, _ in held.values())))
    r.shuffle(rows)
    schema = "user_id long, seq long, job long, settles boolean, cents long, ts timestamp"
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 0, 0, False, 1, datetime(2024, 1, 30))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = U.run_once(B.reservations(stream, 200, "5 days")).where("user_id < 9").collect()
    assert sorted((x["user_id"], x["seq"], x["granted"], x["spent"], x["reserved"]) for x in got) == sorted(want) and {x[2] for x in want} == {True, False, None}


def test_ledger_keeps_a_row_of_state_a_shard(spark, tmp_path):
    """Six hundred users over two days and three micro-batches against a plain walk; state has a row a shard's day, not a user's."""
    r, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=k), r.choice([None, *range(600)]), "x", r.choice([0.1, 0.25, 0.4, None]), "") for k in range(2_400)]
    for k in range(0, len(rows), 800):
        spark.createDataFrame(rows[k : k + 800], U.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(U.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = U.ledger(stream, 60, shards=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    spent, want = {}, set()
    for event, ts, user, _, value, _ in rows:
        key = user, f"{ts:%Y-%m-%d}"
        ok = value is not None and spent.get(key, 0) + round(value * 100) <= 60
        spent[key] = spent.get(key, 0) + (round(value * 100) if ok else 0)
        want.add((user, event, key[1], ok, spent[key]))
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 2 * (4 + 1)
