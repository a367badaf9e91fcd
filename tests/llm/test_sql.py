"""Queries that SQL can express against their SQL on the small table."""

import os

import duckdb
import pytest

from limnos.llm.oracle import ORACLE
from limnos.llm.queries import QUERIES
from tests.llm.tables import odd_documents, write_documents

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


def test_quality_of_scripts_without_blanks(spark, tmp_path):
    """Code and SQL agree on texts whose words are long because nothing parts them, and on odd rows."""
    lines = ["清潔的文字沒有空格所以一行就是一個很長的詞句", "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำ", "unbrokenlatinlettersarenowords", "1234567890123456789"]
    rows = odd_documents() + [(9000 + k, "\n".join(f"{line}{n}" for n in range(60)), "s") for k, line in enumerate(lines)]
    folder = write_documents(spark, str(tmp_path), rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE['op9_quality_rules']})").fetchall()
    got = [tuple(r) for r in QUERIES["op9_quality_rules"](spark, folder).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[0]: r[-1] for r in got if r[0] >= 9000} == {9000: True, 9001: True, 9002: False, 9003: False}
