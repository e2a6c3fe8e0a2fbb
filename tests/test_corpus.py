"""Quantiles by rank and summaries as states, against the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacescan.plans import corpus, states


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 1000 + [1.0], "normal", "ties"])
def test_quantiles(spark, values):
    rng = np.random.default_rng(2)
    values = rng.normal(size=5003).tolist() if values == "normal" else rng.integers(0, 40, 3000).astype(float).tolist() if values == "ties" else values
    at = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = dict(corpus.quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "x double"), "x", at).collect())
    assert list(got) == list(at) and np.allclose([got[p] for p in at], np.quantile(values, at), rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert corpus.quantiles(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_states_of_batches_that_share_packages(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{rng.integers(60)}", str(rng.choice(["a", "b", "c"]))) for _ in range(900)]
    df = lambda r: spark.createDataFrame(r, "package string, rule string")
    numbers, parts = None, []
    for k in range(0, 900, 300):
        numbers = states.numbered(df(rows[k : k + 300]), numbers)
        parts.append(states.rules(df(rows[k : k + 300]), numbers))
    one = states.merged_rules(states.merged_rules(parts[0], parts[1]), parts[2])
    got = {r["rule"]: (r["n"], r["n_packages"]) for r in states.proportions(one, 60).collect()}
    assert got == {x: (sum(r == x for _, r in rows), len({p for p, r in rows if r == x})) for x in "abc"}
    assert numbers.count() == numbers.agg(F.countDistinct("number")).first()[0] == len({p for p, _ in rows})
