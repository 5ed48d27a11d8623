"""Helpers that several test modules import by this module's own name."""


def values(df, *names):
    """Rows as sorted tuples of the named columns."""
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)
