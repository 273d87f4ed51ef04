import datetime as dt

from bidscope.streaming import plans


def test_a_replayed_batch_keeps_its_day(spark, tmp_path, monkeypatch):
    batch = spark.range(1)
    days = iter([dt.date(1998, 2, 4), dt.date(1998, 2, 5)])
    monkeypatch.setattr(plans, "today_in", lambda tz: next(days))
    checkpoint = str(tmp_path / "ckpt")
    assert plans._day_of_batch(batch, checkpoint, 0, "UTC") == dt.date(1998, 2, 4)
    assert plans._day_of_batch(batch, checkpoint, 0, "UTC") == dt.date(1998, 2, 4)
    assert plans._day_of_batch(batch, checkpoint, 1, "UTC") == dt.date(1998, 2, 5)
