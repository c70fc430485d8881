"""The driver's entry and the base queries against their SQL."""

import decimal
import numbers
import os

import numpy as np
import pandas as pd
import pytest

from quarry.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that compares alike from both engines: one null, dates as text, numbers rounded."""
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(y) for y in x]
    if pd.isna(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (numbers.Number, decimal.Decimal)):
        return round(float(x), 4)
    return str(x).removesuffix(" 00:00:00")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
        want = con.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda df: sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
        got, want = key(got), key(want)
        assert got == want, (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
        assert got, "no rows: this proves nothing"


def test_entry_imports_without_the_corpus_package():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
