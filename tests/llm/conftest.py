import pytest


@pytest.fixture(scope="session")
def documents(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").to_pylist()
