"""Result rows in a form that compares."""


def table(df):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near(rows, digits=9):
    """Floats rounded for comparison."""
    return sorted(
        (tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in rows), key=repr
    )
