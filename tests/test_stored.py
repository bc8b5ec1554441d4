from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostvigil.operators import classify
from hostvigil.session import new_path
from hostvigil.sources import registry, stored

START = datetime(2026, 1, 1)
SCHEMA = "id STRING, seq BIGINT, timestamp TIMESTAMP_NTZ, status STRING, dt DATE"


def table(spark, **more):
    return stored.StoredTable(spark, new_path(spark, "stored"), SCHEMA)


def rows(spark, ids, day=lambda i: i % 4):
    made = [(str(i), i, START + timedelta(days=day(i), seconds=i), "new", (START + timedelta(days=day(i))).date()) for i in ids]
    return spark.createDataFrame(made, SCHEMA)


def status(frame):
    return {r.id: r.status for r in frame.collect()}


def test_versions_are_whole_and_old_ones_stay(spark):
    t = table(spark)
    assert t.version() == 0 and t.read().count() == 0 and t.newest(5).count() == 0
    assert t.append(rows(spark, range(8))) == 1 and t.append(rows(spark, range(8, 12))) == 2
    before = t.manifest()
    changes = spark.createDataFrame([("1", date(2026, 1, 2), None), ("9", date(2026, 1, 2), "done"), ("77", date(2026, 1, 2), "none"), ("2", date(2026, 1, 9), "other day")], "id STRING, dt DATE, status STRING")
    assert t.update(changes) == 3
    now = status(t.read())
    assert now == {str(i): {1: None, 9: "done"}.get(i, "new") for i in range(12)}
    assert set(status(t.read(version=2)).values()) == {"new"} and t.read(version=1).count() == 8
    after = t.manifest()
    assert after["2026-01-02"] != before["2026-01-02"] and all(after[d] == before[d] for d in before if d != "2026-01-02")
    assert sum(n for loads in after.values() for n in loads.values()) == 12
    assert t.read(since="2026-01-03").count() == 6 and t.read(until="2026-01-01").count() == 3
    assert t.update(changes.limit(0)) == 3  # nothing to do
    assert t.vacuum(keep=1) == 0  # the other dates still use both loads
    assert status(t.read()) == now
    with pytest.raises(ValueError):
        t.append(rows(spark, [50]).withColumn("dt", F.lit(None).cast("date")))


def test_a_writer_that_comes_too_late_changes_nothing(spark, monkeypatch):
    t = table(spark)
    t.append(rows(spark, range(8)))
    write = t._write

    def interrupted(frame):
        made = write(frame)
        monkeypatch.setattr(t, "_write", write)
        stored.StoredTable(spark, t.path, SCHEMA).append(rows(spark, [4, 100]))  # another writer, same date
        return made

    monkeypatch.setattr(t, "_write", interrupted)
    with pytest.raises(stored.Conflict):
        t.update(spark.createDataFrame([("0", date(2026, 1, 1), "done")], "id STRING, dt DATE, status STRING"))
    assert set(status(t.read()).values()) == {"new"} and t.read().count() == 10
    assert not t._commit(1, {})  # a version is created once
    monkeypatch.setattr(stored, "WAIT_SECONDS", 0)
    store, at = t._file(f"{t.path}/_versions/00000003.json")
    store.create(at, False).close()  # begun and never finished
    with pytest.raises(stored.Conflict):
        t.read()


def test_newest_rows_open_the_newest_dates_only(spark):
    t = table(spark)
    t.append(rows(spark, range(2000), lambda i: i // 2))  # a thousand days
    found = t.newest(50)
    assert [r.seq for r in found.collect()] == list(range(1999, 1949, -1))
    assert len({f.rsplit("/", 2)[1] for f in t.newest(50).inputFiles()}) == 25
    rare = t.newest(3, F.col("seq") % 20 == 0)
    assert [r.seq for r in rare.collect()] == [1980, 1960, 1940] and len({f.rsplit("/", 2)[1] for f in rare.inputFiles()}) <= 64
    assert t.newest(5, F.col("seq") < 0).count() == 0
    assert t.newest(5000).count() == 2000


def test_recoveries_close_the_alerts_before_them(spark):
    root = new_path(spark, "stored")
    full = "seq LONG, ts TIMESTAMP_NTZ, hostname STRING, alert_type STRING, severity STRING, description STRING, source STRING, metrics STRING, status STRING"
    at = lambda h: START + timedelta(hours=h)
    made = [(1, at(1), "a", "CPU_HIGH", "WARNING"), (2, at(30), "a", "CPU_CRITICAL", "CRITICAL"), (3, at(2), "a", "RAM_HIGH", "WARNING"), (4, at(2), "b", "CPU_HIGH", "WARNING"), (5, at(2), "a", "SECURITY_ATTACK", "HIGH")]
    stored.append_incidents(spark.createDataFrame([(*r, "d", "s", "m", "ACTIVE") for r in made], full), root, "alerts")
    back = lambda *r: spark.createDataFrame(list(r), "hostname STRING, metric STRING, ts TIMESTAMP_NTZ, seq LONG")
    stored.resolve_alerts(spark, root, back(("a", "CPU", at(3), 10), ("b", "CPU", at(1), 11)))
    read = lambda: {r.seq: (r.status, r.resolved_at) for r in stored.incident_table(spark, root, "alerts").read().collect()}
    assert read() == {1: ("RESOLVED", at(3)), 2: ("ACTIVE", None), 3: ("ACTIVE", None), 4: ("ACTIVE", None), 5: ("ACTIVE", None)}
    stored.resolve_alerts(spark, root, back(("a", "CPU", at(40), 20), ("a", "CPU", at(50), 21)))
    assert read()[2] == ("RESOLVED", at(40)) and read()[1] == ("RESOLVED", at(3))


def test_a_model_of_added_counts_is_that_of_all_rows(spark):
    rows = spark.createDataFrame([("apple pear", "fruit"), ("engine wheel", "car"), ("apple", "fruit"), (None, "car"), ("x", None)], "text STRING, label STRING")
    more = spark.createDataFrame([("wheel apple wheel", "car"), ("sail mast", "boat")], "text STRING, label STRING")
    path = new_path(spark, "registry")
    models = registry.ModelRegistry(spark, path)
    with pytest.raises(ValueError):
        models.load()
    assert [models.add(rows, "a"), models.add(more, "b"), models.add(more, "b")] == [1, 2, 2]
    labels, model = registry.ModelRegistry(spark.newSession(), path).load()
    known = rows.unionByName(more).where("text IS NOT NULL AND label IS NOT NULL")
    key = lambda f: sorted((r.token, [round(x, 9) for x in r.logp]) for r in f.collect())
    assert labels == ["boat", "car", "fruit"] and key(model) == key(classify.nb_train(known, labels))
    old, first = models.load(1)
    assert old == ["car", "fruit"] and key(first) == key(classify.nb_train(rows.where("text IS NOT NULL AND label IS NOT NULL"), old))
    with pytest.raises(ValueError):
        models.add(rows, "c", digits=4)
    assert not models._commit(2, {})


def test_a_pipeline_is_saved_with_its_version(spark):
    rows = spark.createDataFrame([(i, "apple pear" if i % 2 else "engine wheel", "fruit" if i % 2 else "car") for i in range(20)], "ord LONG, text STRING, label STRING")
    models = registry.ModelRegistry(spark, new_path(spark, "registry"))
    models.add(rows, "a")
    models.attach(classify.lr_train(rows, features=64))
    back = registry.ModelRegistry(spark, models.path).attached()
    assert {(r.text, r.predicted_label) for r in classify.lr_score(rows, back).collect()} == {("apple pear", "fruit"), ("engine wheel", "car")}
