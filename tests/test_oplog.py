"""Batches of edits on snapshots against one replay of the whole log."""

from __future__ import annotations

import copy
import random

from brute_replay import replay as brute
from test_edits import FIELDS, as_state, base_state, base_tables, random_ops, same

from kinloom.operators import edits
from kinloom.streaming import oplog


def frame(spark, ops):
    return spark.createDataFrame([tuple(op[f] for f in FIELDS) for op in ops], edits.OP_SCHEMA)


def test_batches_read_their_own_edits_only(spark, tmp_path):
    """Each batch replays what it brings, whatever came before; late edits make their tree start again, repeated ones are left out."""
    ops = {t: random_ops(t, random.Random(i), 30, 3) for i, t in enumerate(("T0", "T1"))}
    base, root, states = base_tables(spark, list(ops)), str(tmp_path / "edits"), {}
    publish = lambda tables, touched, batch: states.update(as_state(tables))
    run = lambda part, n: oplog.apply_batch(frame(spark, part), n, base, root, publish)
    late = ops["T0"][7:9]
    work = run([op for op in ops["T0"][:12] if op not in late] + ops["T1"][:20], 0)
    assert (work.replayed, work.from_log, work.from_base, work.continued) == (30, 0, 2, 0)
    work = run(ops["T0"][12:16] + ops["T1"][20:24], 1)
    assert (work.replayed, work.from_log, work.from_base, work.continued) == (8, 0, 0, 2)
    for _ in range(2):  # T1 goes on, with three edits again; T0 has a gap closed; and the batch runs again
        work = run(late + ops["T0"][16:] + ops["T1"][18:21] + ops["T1"][24:], 2)
        assert (work.replayed, work.from_base, work.continued) == (30 + 6, 1, 1)
        for t, log in ops.items():
            same(brute(base_state(), log), copy.deepcopy(states[t]))
    before = copy.deepcopy(states)
    assert run(ops["T0"][3:5], 3).replayed == 0 and run([], 4).replayed == 0 and states == before
