"""Signals are shuffled before they are taken apart into affinity keys."""

import re

from test_ranking import START, items_table, signal_table

from storyloom.operators import affinity


def test_keys_are_not_shuffled(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 2, "save", 1.0, START) for i in range(6)]
    plan = affinity.fold_affinities(signal_table(spark, rows), items_table(spark))._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("profile_id" in keys for keys in shuffled) and not any("dimension" in keys for keys in shuffled)
