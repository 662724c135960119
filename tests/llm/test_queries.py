from __future__ import annotations

import os

import pytest

from lectern.llm.queries import oracle_sql, queries
from tests.oracle import connection, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p2_found": "id_a int, id_b int", "p2_groups": "question_id int, same_words_id int, group_id int", "p3_found": "group_id int, question_id int", "p4_found": "source_table string, record_id int, defect string", "p5_found": "source_table string, keep_id bigint, copy_id bigint",
    "p6_found": "note_id int, field_name string, markup string", "p10_found": "doc_id bigint, level int",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, FOLDER, queries()[name], oracle_sql()[name], connection(FOLDER))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs_and_has_its_columns(spark, name):
    df = queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    assert df.count() > 0
