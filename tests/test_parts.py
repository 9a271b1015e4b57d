"""Shared parts: equal content is written once, a derived snapshot writes what changed, prune keeps what is named."""

import pytest
from pyspark.sql import functions as F

from symgrid.schema import RELATIONS, Index
from symgrid.sources import parts, store

A, B, C = (("r", "s", c * 40) for c in "abc")


def filled(spark, name, rows):
    schema = store.empty(spark).__getattribute__(name).schema
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def index(spark, files, version="1", n=3):
    """n symbols, references and facts per file, and a type relation of each file's type."""
    f = filled(spark, "files", [{"file_id": i, "path": f"src/{i}.cs", "content": f"{i} {version}"} for i in files])
    s = filled(spark, "symbols", [{"symbol_id": f"T:{i}.{k}", "file_id": i, "signature": version, "name_tokens": ["a", i]} for i in files for k in range(n)])
    r = filled(spark, "refs", [{"from_symbol_id": f"T:{i}.{k}", "to_symbol_id": "T:f1.0", "file_id": i, "loc_start": k, "ref_kind": "Call"} for i in files for k in range(n)])
    facts = filled(spark, "facts", [{"symbol_id": f"T:{i}.0", "fact_kind": "Route", "value": f"GET /{version}", "file_id": i} for i in files])
    t = filled(spark, "type_relations", [{"type_symbol_id": f"T:{i}.0", "related_symbol_id": f"T:Base{version}", "relation_kind": "BaseType"} for i in files])
    return Index(f, s, r, facts, t)


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def same(one, two):
    for name in parts.KEYS:
        assert bag(getattr(one, name)) == bag(getattr(two, name)), name


def on_disk(tmp_path):
    return {p.relative_to(tmp_path) for p in (tmp_path / "parts").glob("*/*")}


def test_a_derived_snapshot_writes_what_changed(spark, tmp_path):
    root, names = str(tmp_path), [f"f{i}" for i in range(40)]
    first = parts.publish(index(spark, names), root, *A, parts=64)
    before = on_disk(tmp_path)
    assert first == len(before) > 100
    fresh = index(spark, ["f3", "f7", "new"], version="2", n=2)
    removed = spark.createDataFrame([("f9",)], "file_id string")
    wrote = parts.derive(spark, root, A, B, fresh, removed)
    assert 0 < wrote <= 4 * len(parts.KEYS) and len(on_disk(tmp_path) - before) == wrote
    left = index(spark, [n for n in names if n not in ("f3", "f7", "f9")])
    want = Index(*[getattr(left, n).unionByName(getattr(fresh, n)) for n in parts.KEYS])
    same(parts.read(spark, root, *B), want)
    same(parts.read(spark, root, *A), index(spark, names))
    assert parts.symbols_of_files(spark, root, *B, files=spark.createDataFrame([("f3",)], "file_id string")).count() == 2


def test_equal_content_is_written_once(spark, tmp_path):
    root, names = str(tmp_path), [f"f{i}" for i in range(10)]
    assert parts.publish(index(spark, names), root, *A, parts=8) > 0
    again = index(spark, names)
    mixed = Index(*[getattr(again, n).orderBy(F.rand(3)).repartition(3) for n in parts.KEYS])
    assert parts.publish(mixed, root, *B, parts=8) == 0
    # Back to the seed's content: nothing new either.
    parts.derive(spark, root, A, C, index(spark, ["f1"], version="2"))
    assert parts.derive(spark, root, C, C, index(spark, ["f1"])) == 0
    same(parts.read(spark, root, *C), index(spark, names))


def test_prune_deletes_what_no_manifest_names(spark, tmp_path):
    root, names = str(tmp_path), [f"f{i}" for i in range(12)]
    parts.publish(index(spark, names), root, *A, parts=16)
    base = on_disk(tmp_path)
    parts.derive(spark, root, A, B, index(spark, ["f2"], version="2"))
    assert parts.prune(spark, root) == 0 and parts.prune(spark, root, grace=-1) == 0
    parts.remove(spark, root, *B)
    with pytest.raises(LookupError, match="INDEX_NOT_AVAILABLE"):
        parts.read(spark, root, *B)
    extra = len(on_disk(tmp_path) - base)
    assert parts.prune(spark, root) == 0 and parts.prune(spark, root, grace=-1) == extra > 0
    assert on_disk(tmp_path) == base
    same(parts.read(spark, root, *A), index(spark, names))


def test_a_part_that_was_deleted_meanwhile_is_written_again(spark, tmp_path, monkeypatch):
    root, names = str(tmp_path), ["f1", "f2"]
    commit = parts._commit

    def late(spark_, root_, *rest):
        parts.prune(spark, root, grace=-1)
        return commit(spark_, root_, *rest)

    monkeypatch.setattr(parts, "_commit", late)
    parts.publish(index(spark, names), root, *A, parts=4)
    same(parts.read(spark, root, *A), index(spark, names))


def test_odd_rows(spark, tmp_path):
    """Null files, repeated rows, no rows at all, and a fresh index with other columns."""
    root = str(tmp_path)
    own = index(spark, ["f1", None, "f1"])
    parts.publish(own, root, *A, parts=4)
    same(parts.read(spark, root, *A), own)
    none = store.empty(spark)
    assert parts.publish(none, root, *B) == 0
    assert all(getattr(parts.read(spark, root, *B), n).count() == 0 for n in parts.KEYS)
    assert [c.split()[0] for c in RELATIONS["files"].split(", ")] == none.files.columns
    with pytest.raises(ValueError, match="columns of files differ"):
        parts.derive(spark, root, A, C, Index(own.files.drop("content"), own.symbols, own.refs, own.facts, own.type_relations))
