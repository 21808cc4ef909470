import os

from vecloom import session


def paths(*tables):
    return [os.path.isdir(t._vecloom_path.removeprefix("file:")) for t in tables]


def test_scratch_keeps_what_it_is_told(spark):
    df = spark.range(5)
    with session.scratch() as keep:
        a = session.materialize(df)
        with session.scratch() as inner:
            b, c = session.materialize(df), inner(session.materialize(df))
        assert paths(a, b, c) == [True, False, True]
        d = keep(session.materialize(c))
    assert paths(a, c, d) == [False, False, True] and d.count() == 5


def test_clean_up(spark):
    a = session.materialize(spark.range(3))
    session.clean_up(spark)
    assert paths(a) == [False]
