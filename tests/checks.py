"""Helpers of the tests."""


def rows(df, *names):
    """Rows as sorted plain tuples, missing values last."""
    picked = df.select(*names) if names else df
    return sorted(
        (tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    )
