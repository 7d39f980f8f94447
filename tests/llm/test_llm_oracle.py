import pytest

from tributary.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(compare, name):
    compare(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name, cols", [("p8_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id", "pii_kind", "found_text"]), ("p9_passages", ["doc_id", "item_id", "start_char", "end_char"]), ("p10_redacted", ["doc_id", "text"])])
def test_runs_over_the_test_table(spark, sf, name, cols):
    df = QUERIES[name](spark, sf)
    assert df.columns == cols and df.count() > 0
