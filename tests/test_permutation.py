"""Epochs by a keyed permutation, and quality over masked positions."""

import math

import pytest
from pyspark.sql import functions as F

from packetlake.operators.metrics import masked_positions, position_quality
from packetlake.operators.permutation import drawn_batches, drawn_positions, permuted_batches, place_of, row_at
from packetlake.sources.indexed import write_indexed


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 100, 101, 1000])
def test_places_are_a_permutation_and_its_inverse(spark, total):
    rows = spark.range(total).select("id", place_of(F.col("id"), total, 7).alias("place")).withColumn("back", row_at(F.col("place"), total, 7)).collect()
    assert sorted(r.place for r in rows) == list(range(total)) and all(r.back == r.id for r in rows)


def test_orders_of_two_seeds_differ_and_no_order_is_plain(spark):
    n = 2000
    places = [[r.p for r in spark.range(n).select(place_of(F.col("id"), n, s).alias("p")).collect()] for s in (1, 2)]
    for p in places:
        assert sum(i == x for i, x in enumerate(p)) < 12
        ups = sum(a < b for a, b in zip(p, p[1:])) / n
        assert 0.45 < ups < 0.55
        assert abs(sum(i * x for i, x in enumerate(p)) / n - (n - 1) ** 2 / 4) < n * n / 30
    assert sum(a == b for a, b in zip(*places)) < 12


def test_batches_drawn_from_the_store_are_those_of_the_epoch(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 3 + 5).alias("packet_no"), F.lit("x").alias("extra"))
    write_indexed(rows, "packet_no", str(tmp_path / "t"), per_segment=100)
    epoch = {(r.batch_id, r.pos): r.packet_no for r in permuted_batches(rows, "packet_no", 64, 3).collect()}
    assert len(epoch) == 1000
    for first, count in ((0, 1), (4, 3), (15, 1), (16, 2)):
        got = {(r.batch_id, r.pos): r.packet_no for r in drawn_batches(spark, str(tmp_path / "t"), 1000, 64, 3, first, count, 100).collect()}
        assert got == {k: v for k, v in epoch.items() if first <= k[0] < first + count}
    assert permuted_batches(rows.limit(0), "packet_no", 64, 3).count() == 0
    assert drawn_positions(spark, 0, 64, 3, 0).count() == 0


def test_one_batch_reads_its_places_and_sorts_nothing(spark):
    plan = drawn_positions(spark, 10**12, 64, 3, 10**9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = drawn_positions(spark, 10**12, 64, 3, 10**9).collect()
    assert len({r.row_idx for r in got}) == 64 and max(r.row_idx for r in got) > 10**10


def test_masked_positions(spark):
    big = 1e308
    rows = [
        (1, [[0.0, 1.0], [2.0, 0.0], [5.0, 5.0]], [1, 1, 0], [True, False, True]),
        (2, [[1000.0, 0.0], [0.0, 1000.0], [big, -big]], [1, 1, 1], [True, True, True]),
        (3, [[1.0, 2.0]], [7], [True]),  # a target without a score
        (4, [], [], []),
        (5, None, None, None),
        (6, [[0.0, 1.0], None], [None, 0], [True, None]),
    ]
    table = spark.createDataFrame(rows, "id int, logits array<array<double>>, targets array<int>, masked array<boolean>")
    positions = masked_positions(table, "logits", "targets", "masked", "id")
    got = {(r.id, r.pos): (r.hit, r.loss) for r in positions.collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0), (2, 1), (2, 2)}
    assert got[1, 0][0] and math.isclose(got[1, 0][1], math.log(1 + math.exp(-1)), rel_tol=1e-12)
    assert got[1, 2] == (True, math.log(2)) and got[2, 0] == (False, 1000.0) and got[2, 1] == (True, 0.0)
    whole = position_quality(positions).collect()[0]
    assert (whole.n, whole.hits, whole.unbounded) == (5, 3, 1)
    assert math.isclose(whole.loss, (math.log(1 + math.exp(-1)) + math.log(2) + 1000) / 4, rel_tol=1e-12)
    by = {r.pos: (r.n, r.unbounded, r.loss) for r in position_quality(positions.filter("pos = 2 AND id = 2"), "pos").collect()}
    assert by == {2: (1, 1, None)}
    parts = {position_quality(positions.repartition(n)).collect()[0].loss for n in (1, 2, 5)}
    assert len(parts) == 1
    assert position_quality(positions.filter("false")).collect()[0].n == 0
