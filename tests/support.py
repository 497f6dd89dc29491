"""Where the test tables are, and how results are compared."""

import os

import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    cols = sorted(expected.columns)
    assert sorted(found.columns) == cols

    def ordered(x):
        x = x[cols].astype(object).where(x[cols].notna(), None)
        return x.iloc[x.map(str).apply("\x1f".join, axis=1).argsort(kind="stable").to_numpy()].reset_index(drop=True) if len(x) else x.reset_index(drop=True)

    a, b = ordered(found), ordered(expected)
    assert len(a) == len(b)
    for c in cols:
        for x, y in zip(a[c], b[c]):
            assert x == y or (x is None and y is None) or (isinstance(x, float) and abs(x - y) <= 2e-4 * max(1, abs(y))), (c, x, y)
