import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def d():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    return D


@pytest.fixture(scope="session")
def samples(d):
    import duckdb

    return [tuple(r) for r in duckdb.sql(f"SELECT lang, text FROM '{d}/lang_samples.parquet' ORDER BY lang, sample_no").fetchall()]
