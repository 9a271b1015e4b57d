"""Every stage of the pipeline on odd rows and on an empty table."""

import corpus_pipeline as p
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_stage(spark, odd, empty, name, stage):
    for docs in (odd, empty):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "encoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if docs is empty:
            assert not rows
    if name in ("toxicity", "personal_data", "encoding"):
        assert len(rows) == 0 and stage(spark, odd, SF).count() == odd.count()
    if name == "toxicity":
        assert stage(spark, odd, SF).exceptAll(odd).count() == 0


def test_all_stages(spark, odd):
    docs = odd
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.filter("n_ids is null and ids is not null").count() == 0 and docs.count() > 0
