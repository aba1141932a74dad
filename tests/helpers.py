"""Small helpers of the tests."""


def rows(df, *columns):
    """Sorted tuples of a DataFrame, nulls first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))
