import random

import pytest

from cuelake.streaming.ingest import Ingest


def batches(n=14):
    rng = random.Random(3)
    fresh = iter(range(10_000))
    seen: list[int] = []
    for _ in range(n):
        new = [next(fresh) for _ in range(rng.randrange(0, 9))]
        again = rng.sample(seen, min(len(seen), 4))
        seen += new
        yield new + again + again[:1]


def frame(spark, ids, text="x"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], "event_id long, text string")


def test_each_record_once_and_batches_may_run_twice(spark, tmp_path):
    store = Ingest(str(tmp_path / "s"), fan_in=3)
    wanted = set()
    for k, ids in enumerate(batches()):
        store.add(frame(spark, ids), k)
        store.add(frame(spark, ids, "again"), k)
        wanted |= set(ids)
    got = [tuple(r) for r in store.rows(spark).collect()]
    assert sorted(got) == sorted((i, f"x{i}") for i in wanted)
    levels = [level for level, _ in store.last_commit()["runs"]]
    assert max(levels) >= 2 and all(levels.count(n) < 3 for n in set(levels))


def test_a_batch_lost_before_its_commit_is_taken_in_once(spark, tmp_path, monkeypatch):
    store = Ingest(str(tmp_path / "s"), fan_in=2)
    store.add(frame(spark, [1, 2]), 0)
    commit = Ingest._commit
    monkeypatch.setattr(Ingest, "_commit", lambda self, c: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.add(frame(spark, [2, 3]), 1)
    assert sorted(r.event_id for r in store.rows(spark).collect()) == [1, 2]
    monkeypatch.setattr(Ingest, "_commit", commit)
    store.add(frame(spark, [2, 3]), 1)
    assert sorted(r.event_id for r in store.rows(spark).collect()) == [1, 2, 3]
