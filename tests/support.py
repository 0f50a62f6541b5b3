"""What several test modules share: the folder of the tables, and the comparison of both engines' rows."""

DATA = "/root/testdata"


def same(df, relation) -> None:
    """Rows of both sides, whatever their order."""
    assert sorted(df.columns) == sorted(relation.columns)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    theirs = sorted(tuple(map(repr, r)) for r in relation.select(*(f'"{c}"' for c in cols)).fetchall())
    assert ours == theirs
