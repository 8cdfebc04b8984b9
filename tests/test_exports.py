"""Exported sets: staged writes, manifests, and runs that are lost half way."""

import pytest

from callweave.operators import writes as W


def rows(spark, bodies):
    return spark.createDataFrame(list(bodies.items()), "file string, body string").repartition(3)


def there(spark, folder):
    return {r.file: r.body for r in W.exported(spark, folder).collect()}


def test_stale_files_go_and_the_manifest_tells(spark, tmp_path):
    folder, one, two = f"file://{tmp_path}/set", {"a": "1", "b": "2", "c": None}, {"b": "2", "c": "3", "d": "4"}
    assert W.current_version(spark, folder) is None
    assert {tuple(r) for r in W.export_fixtures(rows(spark, one), folder).collect()} == {("a", "added"), ("b", "added"), ("c", "added")}
    assert there(spark, folder) == one
    assert {tuple(r) for r in W.export_fixtures(rows(spark, two), folder).collect()} == {("a", "removed"), ("b", "kept"), ("c", "changed"), ("d", "added")}
    assert there(spark, folder) == two and {r.file for r in W.manifest(spark, folder).collect()} == set(two)
    assert len(list((tmp_path / "set" / "versions").iterdir())) == 1 and {p.name for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")} == {"versions", "CURRENT"}
    assert W.export_fixtures(rows(spark, two).limit(0), folder).filter("change = 'removed'").count() == 3 and there(spark, folder) == {}


def test_a_run_lost_half_way_leaves_the_old_set(spark, tmp_path, monkeypatch):
    folder, one, two = f"file://{tmp_path}/set", {"a": "1"}, {"a": "2"}
    W.export_fixtures(rows(spark, one), folder)
    W.stage_export(rows(spark, two), folder)  # lost before the commit
    assert there(spark, folder) == one
    version = W.stage_export(rows(spark, two), folder)
    with monkeypatch.context() as m:
        m.setattr(W, "_store", lambda *_: (_ for _ in ()).throw(OSError("lost")))  # lost while the pointer is staged
        with pytest.raises(OSError):
            W.commit_export(spark, folder, version)
    assert there(spark, folder) == one
    W.commit_export(spark, folder, version)
    assert there(spark, folder) == two and len(list((tmp_path / "set" / "versions").iterdir())) == 1
    with pytest.raises(ValueError):
        W.stage_export(spark.createDataFrame([("a", "1"), ("a", "2")], "file string, body string"), folder)
    assert there(spark, folder) == two
