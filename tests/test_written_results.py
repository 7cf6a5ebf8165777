"""Results are written with the columns that the query reads, not with texts that nothing shows."""

import pytest

from casequarry.plans import queries_report as q

SF = "/root/testdata/sf0.001"


class Written(Exception):
    pass


@pytest.fixture
def written(monkeypatch):
    seen = {}

    def write(df, label="table"):
        seen[label] = df
        raise Written

    monkeypatch.setattr(q, "cut_lineage", write)
    return seen


def test_recommendations_write_what_they_read(spark, written):
    with pytest.raises(Written):
        q.recommendations(spark, SF)
    assert tuple(written["results"].columns) == q.ADVISED


def test_nested_reports_write_what_they_show(spark, written):
    with pytest.raises(Written):
        q.nested_reports(spark, SF)
    assert tuple(written["results"].columns) == q.SHOWN
    with pytest.raises(Written):
        q.exported_reports(spark, SF)
    assert {"details", "sources_used"} <= set(written["results"].columns)
