import pytest

from lodestone.llm.queries import QUERIES, SQL
from tests.test_queries import connect, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema(spark, sf, name):
    columns = {
        "p1_found": ["id_a", "id_b"], "p3_found": ["id", "kind", "start_pos"], "p4_found": ["id_a", "id_b"], "p6_ids": ["doc_id", "ids"],
        "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "span_start", "span_len"],
    }
    df = QUERIES[name](spark, sf)
    assert df.columns == columns.get(name, df.columns)
