from __future__ import annotations

import pytest

from lexloom.sources import tables


def test_a_table_is_read_anew_after_its_time(spark):
    now, reads = [0.0], []

    def load():
        reads.append(now[0])
        if now[0] == 20:
            raise OSError("gone")
        return spark.range(len(reads))

    held = tables.Refreshed(load, 10, lambda: now[0])
    for t, n in ((0, 1), (9, 1), (10, 2), (20, 2), (25, 2), (30, 4)):
        now[0] = t
        assert held.get().count() == n
    assert reads == [0, 10, 20, 30]


def test_a_first_failure_is_an_error():
    with pytest.raises(ZeroDivisionError):
        tables.Refreshed(lambda: 1 / 0).get()
