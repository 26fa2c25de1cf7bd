"""Running moments of streamed frames against the batch operators, over a restart."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.operators import structural
from helixframe.plans import primitives
from helixframe.streaming import moments
from tests.builders import make, values

KEY = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "run string, frame long, xyz array<double>"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, moments.PROVIDER)
    yield spark
    spark.conf.set(KEY, before)


def take(spark, root, products, **more):
    """One run of the query over what is new under root/in; its states go to root/out."""
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    made = moments.running_moments(stream, 4, products, **more)
    write = lambda batch, k: batch.write.mode("append").parquet(f"{root}/out")
    made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return moments.latest(spark.read.parquet(f"{root}/out"))


@pytest.mark.parametrize("products", [False, True])
def test_as_the_batch_after_a_restart(rocks, tmp_path, products):
    spark, rng = rocks, np.random.default_rng(2)
    x = 1e5 + rng.normal(size=(60, 4, 3)) * [3, 2, 1]
    rows = [("a" if k % 3 else "b", k, f.ravel().tolist()) for k, f in enumerate(x)]
    odd = [("a", 900, None), ("a", 901, [1.0]), ("c", 902, None)]
    for part in (rows[:25] + odd, rows[25:40], rows[40:]):  # each run of the query starts from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state = take(spark, str(tmp_path), products, shards=3)
    whole = moments.merged(state, products)
    assert {r.run: r.n for r in whole.collect()} == {"a": 40, "b": 20}
    for run in "ab":
        t = make(spark, x[[k for k in range(60) if ("a" if k % 3 else "b") == run]])
        own = whole.filter(f"run = '{run}'")
        assert own.first().mean == pytest.approx(t.mean, rel=1e-12)
        if products:
            got = np.zeros((12, 12))
            for r in moments.covariance(own).collect():
                got[r.i, r.j] = r.value
            assert got == pytest.approx(primitives.covariance(t), abs=1e-6)
        else:
            assert values(moments.rmsf(own), "atom_idx", "rmsf") == pytest.approx(values(structural.rmsf(t), "atom_idx", "rmsf"), abs=1e-6)


def test_too_many_products(spark):
    with pytest.raises(ValueError, match="analyse a selection"):
        moments.running_moments(spark.createDataFrame([], SCHEMA), 501, True)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=6), st.booleans(), st.integers(0, 99))
def test_moments_of_parts_are_those_of_all(sizes, products, seed):
    x = np.random.default_rng(seed).normal(loc=1e4, size=(sum(sizes), 3))
    now, at = None, 0
    for n in sizes:
        now = moments.merge(now, moments.of_frames(x[at : at + n], products), products)
        at += n
    want = moments.of_frames(x, products)
    assert now[0] == want[0] and np.allclose(now[1], want[1]) and np.allclose(now[2], want[2], atol=1e-6)
