"""Rows of a frame as a sorted list, for comparisons."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
