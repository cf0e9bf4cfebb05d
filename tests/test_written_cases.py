"""The written cases of every rule."""

import pytest

from tests.written_cases import CASES


@pytest.mark.parametrize(("name", "pairs", "f"), CASES, ids=[c[0] for c in CASES])
def test_case(spark, name, pairs, f):
    rows = spark.createDataFrame([(k, None if x is None else str(x)) for k, (x, _) in enumerate(pairs)], "id long, x string")
    got = {r["id"]: r["value"] for r in f(rows).collect()}
    assert {k: got.get(k) for k in range(len(pairs))} == {k: w for k, (_, w) in enumerate(pairs)}
