"""The judging stage: concurrency, order, retries, restarts."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from glossmill.functions import answers as A
from glossmill.operators import backends, judging, quality

GOOD = json.dumps(dict.fromkeys(("english", "coherent", "faithful", "consistent"), True))


def test_calls_keep_order_and_overlap():
    lock, flying, most = threading.Lock(), [0], [0]

    def client(k):
        with lock:
            flying[0] += 1
            most[0] = max(most[0], flying[0])
        time.sleep(0.02 * (3 - k % 3))
        with lock:
            flying[0] -= 1
        if k == 5:
            raise ValueError("five")
        return k * 10

    got = list(backends.ordered_calls(client, range(12), workers=4, retries=2, wait=lambda s: None))
    assert got == [(None, "ValueError: five") if k == 5 else (k * 10, None) for k in range(12)]
    assert 1 < most[0] <= 4


def stub(folder, bad=()):
    """A judge that writes down what it was asked, and fails on some prompts."""

    def make():
        import os
        import uuid

        def client(prompt):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            if any(b in prompt for b in bad):
                raise RuntimeError("down")
            return GOOD if "p1" not in prompt else '{"english": false, "more": 1}' if "p10" not in prompt else "not json"

        return client

    return make


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_a_restart_asks_for_the_missing_alone(spark, tmp_path):
    for d in ("one", "two", "three", "four"):
        (tmp_path / d).mkdir()
    rows = [(k, k % 2, f"<p{k}>", "too_short" if k % 5 == 4 else None) for k in range(40)]
    checked = spark.createDataFrame(rows, "record int, slot int, prompt string, reason string").repartition(3)
    due = sorted(f"<p{k}>" for k in range(40) if k % 5 != 4)
    store, seen = str(tmp_path / "store"), []
    run = lambda df, d, **how: {r["record"]: (r["stage"], r["keep"], r["reason"]) for r in judging.judged_slots(df, ["record", "slot"], stub(str(tmp_path / d), **how), store, chunk=7, retries=1, progress=lambda r: seen.append(r.count())).collect()}
    first = run(checked, "one", bad=("3>", "<p2"))
    assert asked(tmp_path / "one") == due and seen == sorted(seen) and len(seen) == 5
    failed = [p for p in due if "3>" in p or "<p2" in p]
    assert {f"<p{k}>" for k, v in first.items() if v[2] == "not_judged"} == set(failed) and not any(first[int(p[2:-1])][1] for p in failed)
    second = run(checked, "two")
    assert asked(tmp_path / "two") == failed
    want = {k: ("rule", False, "too_short") if r else ("judge", False, "unparseable_verdict") if k == 10 else ("judge", not (k == 1 or 10 <= k < 20), "judged") for k, _, _, r in rows}
    assert second == want
    assert run(checked, "three") == want and asked(tmp_path / "three") == []
    # A prompt that has changed is asked again; a slot that the rules now reject keeps no verdict.
    changed = checked.withColumns({"prompt": F.when(F.col("record") == 7, "<p7 anew>").otherwise(F.col("prompt")), "reason": F.when(F.col("record") == 8, "empty").otherwise(F.col("reason"))})
    got = run(changed, "four")
    assert asked(tmp_path / "four") == ["<p7 anew>"] and got[8] == ("rule", False, "empty") and got[7] == ("judge", True, "judged")


def test_a_crash_keeps_finished_chunks(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    rows = spark.createDataFrame([(k, f"<q{k}>") for k in range(30)], "k int, prompt string")
    store, calls = str(tmp_path / "store"), []

    def stop(replies):
        calls.append(replies.count())
        if len(calls) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        judging.judge(rows, ["k"], stub(str(tmp_path / "asked")), store, chunk=10, progress=stop)
    before = len(asked(tmp_path / "asked"))
    assert before == calls[-1] < 30
    assert judging.judge(rows, ["k"], stub(str(tmp_path / "asked")), store, chunk=10).count() == 30
    assert asked(tmp_path / "asked") == sorted(f"<q{k}>" for k in range(30))


def test_limit_and_nothing_due(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    rows = spark.createDataFrame([(k, f"<q{k}>") for k in range(30)], "k int, prompt string")
    got = judging.judge(rows, ["k"], stub(str(tmp_path / "asked")), str(tmp_path / "store"), limit=12)
    assert got.count() == 12 == len(asked(tmp_path / "asked"))
    assert judging.judge(rows.limit(0), ["k"], stub(str(tmp_path / "asked")), str(tmp_path / "none")).count() == 0


def test_verdicts_by_truthiness(spark):
    cases = {
        GOOD: True, '{"english": 1, "coherent": "yes", "faithful": [0], "consistent": {"a": 0}, "why": "further keys"}': True, '{"english": true}': False, f" {GOOD}\n": True, f"{GOOD} done": None, "[]": None, "": None,
        '{"english": 0, "coherent": "", "faithful": [], "consistent": null}': False, '{"english": 0.0, "coherent": 1, "faithful": 1, "consistent": 1}': False,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "raw string").withColumn("scores", A.judge_scores(F.col("raw")))
    got = {r["raw"]: None if r["scores"] is None else r["keep"] for r in df.withColumn("keep", quality.keep_by_axes(F.col("scores"))).collect()}
    assert got == {**cases, None: None}
    required = df.filter(F.col("raw") == '{"english": true}').select(quality.keep_by_axes(F.col("scores"), ("english",))).first()[0]
    assert required is True
