import pytest


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    key = lambda t: tuple((x is None, "" if x is None else str(x)) for x in t)
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=key)
