"""A workspace's search makes tokens that are not published once, in tasks by the number of symbols."""

from symgrid import session
from symgrid.operators import search, workspace
from tests.test_operators import rows
from tests.test_workspace import baseline, reread, symbol  # noqa: F401


def test_tokens_are_made_once_and_dealt_out(spark, baseline, monkeypatch):  # noqa: F811
    monkeypatch.setattr(session, "HARD_ROWS", 1)
    tasks, stored, made, keep = [], [], search.postings, workspace.durable
    monkeypatch.setattr(search, "postings", lambda s, *more: tasks.append(s.rdd.getNumPartitions()) or made(s, *more))
    own = workspace.refresh(baseline, workspace.empty(baseline), reread(spark, "a", symbol("M:N.A.Go", "a", "sa")))
    published = made(baseline.symbols, "file_id", "stable_id")
    want = rows(workspace.search_merged(baseline, own, "n", index=published), "symbol_id", "origin", "score")
    tasks.clear()
    monkeypatch.setattr(workspace, "durable", lambda df: stored.append(df.columns) or keep(df))
    assert rows(workspace.search_merged(baseline, own, "n"), "symbol_id", "origin", "score") == want and want
    assert stored == [["symbol_id"]]
    assert tasks == [max(8, baseline.symbols.count()), max(8, own.symbols.count())]
