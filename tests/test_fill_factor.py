"""The fill factor's search against a scan of the loss table."""

from __future__ import annotations

import random

from stockloom.operators import policy
from stockloom.params import FILL_TARGET, Params


def test_fill_factor_is_the_first_that_fits(spark):
    r = random.Random(8)
    # dust lets a loss rise from one k to the next
    table = [(abc, k / 100, max(0.0, 0.4 - k / 1500) + r.random() * 1e-3) for abc in "AB" for k in range(601)]
    needs = [(i, r.choice("ABC"), r.choice((*FILL_TARGET, "other")), r.choice((None, 0.0, r.random() * 300)), 1 + 40 * r.random()) for i in range(400)]
    losses = spark.createDataFrame(table, "abc string, k double, loss double")
    rows = spark.createDataFrame(needs, "i int, abc string, tier string, sigma double, lot double")
    found = policy.fill_factor(rows, losses, Params())
    for x in found.collect():
        cap = Params().safety_cap
        if not x.sigma:
            assert x.k_fill == 0
            continue
        allowed = (1 - FILL_TARGET.get(x.tier, FILL_TARGET["standard"])) * x.lot / x.sigma
        own = [(k, loss) for abc, k, loss in table if abc == x.abc]
        assert x.k_fill == (min(next((k for k, loss in own if loss <= allowed), own[-1][0]), cap) if own else cap)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan  # no scan of the table a row
