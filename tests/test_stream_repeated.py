"""The repeated stream: a delivery keeps its files, each application is decided once."""

from riskspark.plans import catalog as C
from riskspark.streaming import decisions as STR


def test_a_delivery_is_one_batch_of_all_its_files(spark, sf_small, monkeypatch):
    apps, sc = C.served(spark, sf_small)
    monkeypatch.setattr(C, "served", lambda *_: (apps.repartition(3), sc))
    asked = []
    real = STR.application_stream
    monkeypatch.setattr(STR, "application_stream", lambda s, path, files_per_trigger=None: (asked.append((files_per_trigger, len(s.read.parquet(path).inputFiles()))), real(s, path, files_per_trigger))[1])
    got = C.q_stream_decisions_repeated(spark, sf_small)
    assert asked == [(3, 6)] and got.count() == got.select("application_id").distinct().count() > 0
    assert got.count() == C.q_decisions(spark, sf_small).count()
