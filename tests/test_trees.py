"""Hash trees against plain comparisons of all files."""

import random

from symgrid.operators import trees
from tests.test_operators import rows


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, sha256 string")


def plain(a, b):
    return sorted((p, "added" if p not in a else "removed" if p not in b else "modified") for p in a.keys() | b.keys() if a.get(p) != b.get(p))


def test_changes_equal_the_plain_diff(spark):
    r = random.Random(4)
    names = [f"{'/'.join(f'd{r.randrange(5)}' for _ in range(r.randrange(5)))}/f{i}".lstrip("/") for i in range(400)]
    a = {n: f"h{i}" for i, n in enumerate(names)}
    one = trees.tree(table(spark, a))
    for edits in (0, 1, 9):
        b = dict(a)
        for n in r.sample(names, edits):
            r.choice([lambda n=n: b.update({n: "other"}), lambda n=n: b.pop(n), lambda n=n: b.update({n + "/deep/er": "new"})])()
        two = trees.tree(table(spark, b))
        assert rows(trees.changed(one, two), "path", "change") == plain(a, b)
        assert (trees.root_hash(one) == trees.root_hash(two)) == (a == b)
    assert rows(one.filter("path = ''"), "n_files") == [(400,)]


def test_rows_compared_go_with_the_change(spark, monkeypatch):
    """One file of 2,000 changes: its directories' children are compared, no others."""
    a = {f"d{i // 100}/e{i // 10 % 10}/f{i % 10}": str(i) for i in range(2_000)}
    read, among = [], trees.among

    def counted(*args):
        out = among(*args)
        read.append(out.count())
        return out

    one, two = trees.tree(table(spark, a)), trees.tree(table(spark, a | {"d7/e3/f5": "x"}))
    monkeypatch.setattr(trees, "among", counted)
    assert rows(trees.changed(one, two), "path", "change") == [("d7/e3/f5", "modified")]
    assert sum(read) == 2 * (20 + 10 + 10)


def test_odd_trees(spark):
    empty, one = trees.tree(table(spark, {"x": "1"}).limit(0)), trees.tree(table(spark, {"a": "1", "b/c": None}))
    assert rows(trees.changed(empty, one), "path", "change") == [("a", "added"), ("b/c", "added")]
    assert rows(trees.changed(one, empty), "path", "change") == [("a", "removed"), ("b/c", "removed")]
    assert trees.changed(empty, empty).count() == 0
    # Renames, and hashes that change places, change the root.
    assert trees.root_hash(trees.tree(table(spark, {"a": "1", "b": "2"}))) != trees.root_hash(trees.tree(table(spark, {"a": "2", "b": "1"})))
    as_file, as_folder = trees.tree(table(spark, {"a": "1"})), trees.tree(table(spark, {"a/b": "1"}))
    assert rows(trees.changed(as_file, as_folder), "path", "change") == [("a", "removed"), ("a/b", "added")]
