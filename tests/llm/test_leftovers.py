"""After a run inside ``staging`` the shared folder and the catalog are as before, also when it fails."""

from pathlib import Path

import pytest
from samples import docs, odd, odd_rows  # noqa: F401

import corpus_pipeline
from washboard.llm.lm_scores import lm_scores
from washboard.llm.repeats import remove_repeats
from washboard.session import shared_folder, staging


def left(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    return sorted(p.name for p in folder.glob("washboard*")), sorted(t.name for t in spark.catalog.listTables())


@pytest.mark.parametrize("run", [lm_scores, remove_repeats])
def test_operators_with_catalog_tables(spark, odd, run):
    before = left(spark)
    with staging(spark):
        assert run(odd).count() == len(odd_rows())
        assert left(spark) != before
    assert left(spark) == before
    with pytest.raises(ZeroDivisionError), staging(spark):
        run(odd).count()
        raise ZeroDivisionError
    assert left(spark) == before


def test_pipeline(spark, sf_dir, monkeypatch):
    before = left(spark)
    with staging(spark):
        assert corpus_pipeline.run(spark, sf_dir).count() > 0
        tables = set(left(spark)[0]) - set(before[0])
        assert len(tables) == 1 and "sum_of_squares_packing" in tables.pop()
    assert left(spark) == before

    def fails(spark, docs, sf_dir):
        raise ZeroDivisionError

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("fails", fails)])
    with pytest.raises(ZeroDivisionError), staging(spark):
        corpus_pipeline.run(spark, sf_dir)
    assert left(spark) == before
