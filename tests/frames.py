"""Helpers that several test modules share. Not in conftest: that name is no module of its own once a subfolder has one."""


def rows(df):
    return [tuple(r) for r in df.collect()]
