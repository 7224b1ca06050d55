import __spark_entry__
from lodestone.plans import register


def test_register_is_whole():
    assert set(register.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["question_id", "chunk_id", "score", "rank"] and rows.count() > 0
