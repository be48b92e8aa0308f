"""Shared by the tests here."""


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
