"""Late resolution reads the references once to learn what is asked, and stretches that no hint has aren't moved."""

from pyspark.sql import functions as F

from symgrid.operators import refs
from tests.test_adjacency import plan


def test_references_are_read_once_before_they_are_bound(spark, tmp_path, monkeypatch):
    stored, keep = [], refs.durable
    monkeypatch.setattr(refs, "durable", lambda df: stored.append(plan(df)) or keep(df))
    made = [(f"f{i}", "", "Go" if i % 2 else "Run", ["D", "this", None, "elsewhere", "x/y"][i % 5], "Unresolved" if i % 3 else "Resolved") for i in range(60)]
    spark.createDataFrame(made, "from_symbol_id string, to_symbol_id string, to_name string, to_container_hint string, resolution_state string").write.parquet(f"{tmp_path}/late_refs")
    known = spark.createDataFrame([("M:N.D.Go", "M:N.D.Go()"), ("M:N.E.Go", "M:N.E.Go()"), ("M:N.E.Run", "M:N.E.Run()")], "symbol_id string, fqname string")
    got = refs.resolve(spark.read.parquet(f"{tmp_path}/late_refs"), known)
    assert [p.count("late_refs") > 0 for p in stored] == [True, False, False]
    # The hints that names with several symbols have begin with these; nothing else of a name is moved.
    assert any(all(f"'{s}'" in line or s in line for s in ("d", "else", "x/y")) and "IN" in line.upper() for line in stored[-1].splitlines() if "Condition" in line)
    bound = {r["from_symbol_id"]: (r["to_symbol_id"], r["resolution_state"]) for r in got.collect()}
    for name, _, to, hint, state in made:
        open_ = state == "Unresolved"
        want = "M:N.E.Run" if to == "Run" else "M:N.D.Go" if hint == "D" else ""
        assert bound[name] == ((want, "Resolved") if open_ and want else ("", state))
    assert got.filter(F.col("to_symbol_id") != "").count() == sum(v[0] != "" for v in bound.values())
