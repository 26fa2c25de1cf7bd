"""Tables that jobs write for themselves go with the scope that they were written in."""

from __future__ import annotations

import os
import threading

import pytest

from helixframe.plans.tables import discard, materialise, scope


def there(path):
    return os.path.exists(path.removeprefix("file:"))


def test_scope_keeps_what_it_is_told_to(spark):
    keep, other = [], []
    with scope(spark, keep):
        materialise(spark.range(3), "a", other)
        gone = list(other)
        assert materialise(spark.range(4), "b", keep).count() == 4
    assert [there(p) for p in gone + keep] == [False, True]
    discard(spark, keep)


def test_scopes_nest(spark):
    outer, inner, loose = [], [], []
    with scope(spark, outer):
        with scope(spark, inner):
            materialise(spark.range(3), "a", inner)
            materialise(spark.range(3), "b", loose)
        first = list(inner)
        assert there(first[0]) and not there(loose[0])
    assert not there(first[0])


def test_tables_of_other_threads_are_left_alone(spark):
    """A second query of the same driver writes while a scope of the first one is open, and after it."""
    made, wrote, go = [], threading.Event(), threading.Event()

    def second():
        df = materialise(spark.range(7), "second", paths)
        wrote.set()
        go.wait(60)
        made.append(df.count())

    paths: list[str] = []
    thread = threading.Thread(target=second)
    with scope(spark, []):
        materialise(spark.range(3), "first")
        thread.start()
        assert wrote.wait(60)
    go.set()
    thread.join(60)
    assert made == [7] and there(paths[0])


def test_a_scope_that_fails_leaves_nothing(spark):
    wrote = []
    with pytest.raises(RuntimeError), scope(spark, []):
        materialise(spark.range(3), "a", wrote)
        raise RuntimeError
    assert not there(wrote[0])
