"""Versions of datasets: commits that stop anywhere, conflicts, readers that keep theirs; and a stream that stops anywhere."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from terrazzo.model import PlanError
from terrazzo.operators import edits
from terrazzo.plans.parse import parse_filter
from terrazzo.sources.snapshots import Conflict, Snapshots
from terrazzo.streaming import ingest as streaming


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/store")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def two(store, a, b):
    t = store.begin()
    t.stage("a", store.spark.range(a))
    t.stage("b", store.spark.range(b))
    return t


def test_versions(store, spark):
    assert store.version() == 0 and store.names() == []
    assert two(store, 3, 5).commit() == 1 and store.names() == ["a", "b"]
    old = store.scan("a")
    t = store.begin()
    t.stage("a", t.scan("a").where("id > 0"))
    assert ids(t.scan("a")) == [1, 2] and ids(store.scan("a")) == [0, 1, 2]
    t.append("a", spark.range(7, 9))
    assert t.commit() == 2 and ids(store.scan("a")) == [1, 2, 7, 8] and ids(old) == [0, 1, 2] and ids(store.scan("a", 1)) == [0, 1, 2]
    with pytest.raises(PlanError):
        store.scan("c")
    with pytest.raises(PlanError):
        store.manifest(9)
    with pytest.raises(PlanError):
        store.begin().append("a", spark.range(2).withColumnRenamed("id", "other"))


class Stopped(RuntimeError):
    pass


def stopping_at(store, monkeypatch, step):
    """Lets the store do ``step`` of its steps, and then no more; a step may also stop right after it was done."""
    left = itertools.count()

    def stop(name, after):
        real = getattr(store, name)

        def run(*args):
            if not after and next(left) == step:
                raise Stopped(name)
            out = real(*args)
            if after and next(left) == step:
                raise Stopped(name)
            return out

        return run

    for name in ("write", "write_draft", "publish"):
        before = stop(name, False)
        monkeypatch.setattr(store, name, before)
        monkeypatch.setattr(store, name, stop(name, True))


def test_a_commit_that_stops_at_every_step(spark, tmp_path, monkeypatch):
    seen = set()
    for step in range(12):
        store = Snapshots(spark, f"file://{tmp_path}/stop{step}")
        two(store, 2, 3).commit()
        with monkeypatch.context() as patch:
            stopping_at(store, patch, step)
            try:
                two(store, 4, 6).commit()
                done = True
            except Stopped:
                done = False
        fresh = Snapshots(spark, f"file://{tmp_path}/stop{step}")
        sizes = fresh.scan("a").count(), fresh.scan("b").count()
        assert sizes in {(2, 3), (4, 6)} and (sizes == (4, 6) or not done)
        seen.add((sizes, done))
        assert two(fresh, 5, 7).commit() == fresh.version() and (fresh.scan("a").count(), fresh.scan("b").count()) == (5, 7)
        fresh.vacuum(keep=1, drafts=True)
        assert fresh.scan("a").count() == 5 and len(list((tmp_path / f"stop{step}" / "data").iterdir())) == 2
    assert {((2, 3), False), ((4, 6), False), ((4, 6), True)} <= seen


def test_conflicts(store, spark):
    two(store, 2, 3).commit()
    first, second, third = store.begin(), store.begin(), store.begin()
    first.stage("a", spark.range(10))
    second.stage("b", spark.range(20))
    third.stage("a", spark.range(30))
    assert first.commit() == 2 and second.commit() == 3  # another dataset's change is kept
    assert store.scan("a").count() == 10 and store.scan("b").count() == 20
    with pytest.raises(Conflict):
        third.commit()
    third.rollback()
    assert store.version() == 3 and store.scan("a").count() == 10


def test_two_commits_at_once(store, spark, monkeypatch):
    """Another commit takes the number between the look and the rename: the slower one looks again."""
    two(store, 2, 3).commit()
    slow = store.begin()
    slow.stage("a", spark.range(9))
    real = store.publish
    raced = []

    def publish(draft, version):
        if not raced:
            raced.append(version)
            monkeypatch.setattr(store, "publish", real)
            other = store.begin()
            other.stage("b", spark.range(8))
            assert other.commit() == version
        return real(draft, version)

    monkeypatch.setattr(store, "publish", publish)
    assert slow.commit() == 3 and raced == [2] and store.scan("a").count() == 9 and store.scan("b").count() == 8


def test_edits_over_versions(store, spark):
    two(store, 4, 4).commit()
    t = edits.Transaction(store)
    t.stage("a", edits.delete_where(store.dataset("a", ("id",)), parse_filter("id = 1")))
    t.rollback()
    t.stage("a", edits.delete_where(store.dataset("a", ("id",)), parse_filter("id = 1")))
    t.stage("b", spark.range(1))
    assert store.scan("a").count() == 4
    t.commit()
    assert ids(store.scan("a")) == [0, 2, 3] and store.scan("b").count() == 1


def test_vacuum_keeps_what_versions_name(store):
    for n in range(1, 5):
        two(store, n, n).commit()
    assert store.vacuum(keep=2) == 4 and store.scan("a", 3).count() == 3 and store.scan("a").count() == 4
    with pytest.raises(PlanError):
        store.scan("a", 1)


# --- the stream ---------------------------------------------------------------------------------


def put(folder, name, *features):
    (folder / name).write_text("\n".join(f if isinstance(f, str) else json.dumps(f) for f in features))


def feature(k, own=None):
    return {"type": "Feature", **({"id": own} if own else {}), "geometry": {"type": "Point", "coordinates": [k, k]}, "properties": {"n": k}}


def test_a_stream_that_stops_everywhere(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    total = 0
    for f in range(6):
        put(source, f"{f}.json", *(feature(total + k) for k in range(5)), feature(900 + f, f"own{f}"), "junk")
        total += 5
    run = lambda: streaming.load(spark, str(source), target, {"n": "long"}, files=1).awaitTermination(120)
    real_put, real_number = streaming.put_text, streaming.ingest.with_ordinal
    rng = random.Random(4)

    def sometimes(f):
        def tried(*args):
            luck = rng.random()
            if luck < 0.2:
                raise Stopped("before")
            out = f(*args)
            if luck > 0.8:
                raise Stopped("after")
            return out

        return tried

    monkeypatch.setattr(streaming, "put_text", sometimes(real_put))
    monkeypatch.setattr(streaming.ingest, "with_ordinal", sometimes(real_number))
    stops = 0
    for _ in range(40):
        try:
            run()
            break
        except Exception as e:  # the stream's own error, which names what stopped it
            assert "Stopped" in str(e)
            stops += 1
    features, skipped = streaming.loaded(spark, target)
    rows = features.collect()
    own = {r["feature_id"] for r in rows if r["feature_id"].startswith("own")}
    assert stops >= 3 and len(rows) == 36 and own == {f"own{f}" for f in range(6)} and sorted(r["n"] for r in rows) == sorted([*range(30), *range(900, 906)])
    given = sorted(int(r["feature_id"]) for r in rows if not r["feature_id"].startswith("own"))
    assert len(given) == len(set(given)) == 30 and given[0] >= 1 and given[-1] <= 36  # places among all features
    assert [r["reason"] for r in skipped.collect()] == ["RecordMalformed"] * 6
    monkeypatch.undo()
    put(source, "late.json", feature(77))
    run()
    assert streaming.loaded(spark, target)[0].where("n = 77").first()["feature_id"] == "37"


def test_ids_of_a_stream_without_ids(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    for f in range(4):
        put(source, f"{f}.json", *(feature(10 * f + k) for k in range(10)))
        streaming.load(spark, str(source), target, {"n": "long"}).awaitTermination(60)
    features, _ = streaming.loaded(spark, target)
    assert sorted(int(r["feature_id"]) for r in features.collect()) == list(range(1, 41)) and features.agg(F.countDistinct("n")).first()[0] == 40
