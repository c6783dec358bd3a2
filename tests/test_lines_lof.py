"""Factors of order lines: right rows, and no copy of the lines is stored for the two passes that read them."""

import numpy as np
import pandas as pd
import pytest

from farpoint.catalog import QUERIES, clusters
from tests.test_exact_lof import brute_lof

QUERIES_OF_LINES = ["l8_projected_lof_lines", "l8_projected_recall_lines", "l8_exact_lof_lines"]
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    rng = np.random.default_rng(21)
    n = 260
    numbers = [rng.integers(1, 51, n), rng.uniform(900, 90000, n).round(2), rng.integers(0, 11, n) / 100, rng.integers(0, 9, n) / 100]
    table = pd.DataFrame(dict(zip(_NUMBERS, (v.astype(float) for v in numbers))))
    table.loc[:39, _NUMBERS] = table.loc[0, _NUMBERS].to_numpy()  # copies
    table.insert(0, "l_orderkey", np.arange(n))
    for key in ("l_partkey", "l_suppkey"):
        table[key] = rng.integers(0, 50, n)
    table["l_linenumber"] = np.int32(1)
    table["l_returnflag"], table["l_linestatus"] = np.where(np.arange(n) % 3, "R", "N"), "O"
    folder = tmp_path_factory.mktemp("lines")
    table.to_parquet(folder / "lineitem.parquet")
    x = table[_NUMBERS].to_numpy()
    return str(folder), table, (x - x.mean(axis=0)) / x.std(axis=0)


@pytest.mark.parametrize("name", QUERIES_OF_LINES)
def test_no_lines_are_stored(spark, lines, monkeypatch, name):
    def refused(df, name):
        raise AssertionError(f"stores {name}")

    monkeypatch.setattr(clusters, "materialize", refused)
    folder, table, x = lines
    rows = QUERIES[name](spark, folder).collect()
    if name == "l8_projected_recall_lines":
        assert [(r.points, r.recall, r.under, r.proven_lacking) for r in rows] == [(221, 1.0, 0, 0)]
        return
    assert sorted(r.id for r in rows) == sorted(f"{r.l_orderkey}-1-{r.l_partkey}-{r.l_suppkey}" for r in table.itertuples())
    found = {int(r.id.split("-")[0]): r.lof for r in rows}
    np.testing.assert_allclose([found[i] for i in range(len(x))], brute_lof(x, 5), atol=2e-6)
