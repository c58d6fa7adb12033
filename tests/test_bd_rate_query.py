"""The registered BD-rate query against whole curves."""

import pytest

from marlstone import catalog
from marlstone.operators import sweep

SF = "/root/testdata/sf0.001"


def test_bd_rate_query_takes_whole_curves(spark):
    prices = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        prices.setdefault(r["p_brand"], {}).setdefault(float(r["p_size"]), []).append(r["p_retailprice"])
    curves = {b: sorted((rate, round(sum(p) / len(p), 4)) for rate, p in c.items()) for b, c in prices.items()}
    assert max(rate for c in curves.values() for rate, _ in c) > 12
    split = lambda b: ([r for r, _ in curves[b]], [q for _, q in curves[b]])
    got = {r["p_brand"]: r["bd_rate_pct"] for r in catalog.queries()["agg40_bd_rate"](spark, SF).collect()}
    want = {b: sweep.bd_rate_of(*split("Brand#11"), *split(b)) for b in curves if b in got}
    assert len(got) >= len(curves) - 1 and any(v is not None for v in want.values())
    for b, v in want.items():
        assert got[b] == (None if v is None else pytest.approx(v, rel=1e-4, abs=1e-4)), b
