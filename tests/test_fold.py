"""The set-based fold against a plain row-by-row replay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, skew

START = datetime(2024, 1, 1)
SCHEMA = ("pk string, seq bigint, op string, datasync_flag string, last_modified timestamp_ntz, v int, "
          "ok boolean, is_retry boolean, born bigint")
SPEC = fold.FoldSpec(keys=("pk",), order=("seq",), values=("v", "last_modified"), first=("born",), valid="ok")


def make_feed(seed, n=400, keys=9):
    rng = random.Random(seed)
    feed = []
    for seq in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        lm = None if rng.random() < 0.08 else START + timedelta(hours=rng.randrange(60))
        feed.append((key, seq, rng.choice("IIUUUUUDX"), rng.choice([None, "CLOUD", " cloud ", ""]), lm,
                     rng.randrange(1000), rng.random() > 0.06, False, seq))
    return feed


def replay(feed, state=None):
    """What a loop over the events would do; state: key -> dict (or a tombstone)."""
    state = {k: dict(v) for k, v in (state or {}).items()}
    said = {}
    for key, seq, op, flag, lm, v, ok, retry, born in sorted(feed, key=lambda r: r[1]):
        cloud = (flag or "").strip().upper() == "CLOUD"
        now = state.get(key)
        alive = now is not None and not now["dead"]
        if cloud and op == "I":
            said[seq] = "GUARD"
        elif retry and now is not None and seq <= now["base"]:
            said[seq] = "STALE"
        elif cloud and op == "U" and lm is not None and alive and now["lm"] is not None and lm < now["lm"]:
            said[seq] = "LWW"
        elif not ok:
            said[seq] = "INVALID"
        else:
            said[seq] = "APPLY"
            base = now["base"] if now else -1
            last = max(seq, now["last"]) if now else seq
            if op == "D":
                state[key] = dict(dead=True, lm=None, v=None, born=None, last=last, base=base)
            else:
                state[key] = dict(dead=False, lm=lm, v=v, born=now["born"] if alive else born, last=last, base=base)
    for row in state.values():
        row["base"] = row["last"]
    return said, state


def live_rows(state):
    return {k: (r["v"], r["lm"], r["born"], r["last"]) for k, r in state.items() if not r["dead"]}


def spark_rows(state):
    return {r.pk: (r.v, r.last_modified, r.born, r.last_seq.seq) for r in fold.live(state).collect()}


def frame(spark, feed):
    return spark.createDataFrame(feed, SCHEMA)


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 15])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_replay(spark, seed, task_rows):
    feed = make_feed(seed)
    folded = fold.fold(frame(spark, feed), SPEC, task_rows=task_rows)
    said, state = replay(feed)
    assert {r.seq: r.decision for r in fold.decisions(folded).collect()} == said
    assert spark_rows(fold.final_state(folded, SPEC)) == live_rows(state)


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 10])
def test_batches_equal_one_fold(spark, task_rows):
    feed = make_feed(5, 300)
    state, known = None, None
    for i in range(3):
        part = feed[i * 100:(i + 1) * 100]
        folded = fold.fold(frame(spark, part), SPEC, state, task_rows=task_rows)
        state = spark.createDataFrame(fold.final_state(folded, SPEC).toArrow())
        _, known = replay(part, known)
    assert spark_rows(state) == live_rows(known) == live_rows(replay(feed)[1])


@pytest.mark.parametrize("task_rows", [skew.TASK_ROWS, 10])
def test_old_slice_as_retry_changes_nothing(spark, task_rows):
    feed = make_feed(8, 300)
    spec = fold.FoldSpec(**{**SPEC.__dict__, "retried": "is_retry"})
    state = spark.createDataFrame(fold.final_state(fold.fold(frame(spark, feed), SPEC), SPEC).toArrow())
    again = [(*r[:7], True, r[8]) for r in feed[50:150]]
    folded = fold.fold(frame(spark, again), spec, state, task_rows=task_rows)
    assert spark_rows(fold.final_state(folded, spec)) == spark_rows(state)
    said, _ = replay(again, replay(feed)[1])
    assert {r.seq: r.decision for r in fold.decisions(folded).collect()} == said


def test_order_between_keys_is_free(spark):
    feed = make_feed(11, 200)
    shuffled = feed[:]
    random.Random(3).shuffle(shuffled)
    one = fold.final_state(fold.fold(frame(spark, feed), SPEC), SPEC)
    two = fold.final_state(fold.fold(frame(spark, shuffled).repartition(7), SPEC), SPEC)
    assert spark_rows(one) == spark_rows(two)


def test_one_shuffle_and_one_sort(spark):
    spec = fold.FoldSpec(**{**SPEC.__dict__, "first": ()})
    plan = fold.final_state(fold.fold(frame(spark, make_feed(1, 50)), spec), spec)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_null_key_is_refused(spark):
    feed = [(None, 1, "I", None, START, 1, True, False, 1), ("a", 2, "I", None, START, 2, True, False, 2)]
    folded = fold.fold(frame(spark, feed), SPEC)
    assert {r.seq: r.decision for r in fold.decisions(folded).collect()} == {1: "INVALID", 2: "APPLY"}
    assert set(spark_rows(fold.final_state(folded, SPEC))) == {"a"}


def test_target_without_modification_time_always_applies(spark):
    spec = fold.FoldSpec(keys=("pk",), order=("seq",), values=("v",), last_modified=None)
    feed = [("a", 1, "I", None, START, 1, True, False, 1), ("a", 2, "U", "CLOUD", START - timedelta(days=9), 2, True, False, 2)]
    folded = fold.fold(frame(spark, feed), spec)
    assert [r.decision for r in fold.decisions(folded).orderBy("seq").collect()] == ["APPLY", "APPLY"]
    assert F.col("v") is not None


def test_hot_key_of_one_commit_time(spark):
    """All events of the key come from one file and share its time: it is cut all the same."""
    feed = make_feed(21, n=300, keys=2)
    rows = [(k, START, s, *rest) for k, s, *rest in feed]
    frame = spark.createDataFrame(rows, SCHEMA.replace("seq bigint", "at timestamp_ntz, seq bigint"))
    spec = fold.FoldSpec(**{**SPEC.__dict__, "order": ("at", "seq")})
    profile = skew.profile_keys(frame, ["pk"], 30)
    assert profile.pieces() >= 4
    heavy = profile.heavy(frame)
    pieces = skew.range_pieces(heavy, ["at", "seq"], profile.pieces()).groupBy("_chunk").count().collect()
    assert len(pieces) >= 4 and max(r["count"] for r in pieces) < 0.6 * heavy.count()
    folded = fold.fold(frame, spec, profile=profile)
    said, state = replay(feed)
    assert {r.seq: r.decision for r in fold.decisions(folded).collect()} == said
    got = {r.pk: (r.v, r.last_modified, r.born, r.last_seq.seq) for r in fold.live(fold.final_state(folded, spec)).collect()}
    assert got == live_rows(state)
