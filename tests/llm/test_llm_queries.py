import os

import pytest

from corpusloom.llm import plans
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
COLUMNS = {"p1_found": ["field", "row_no", "raw", "slug"], "p3_found": ["slug_a", "slug_b"], "p5_found": ["entry_a", "entry_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
