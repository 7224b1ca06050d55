"""Scores against their SQL where letters and halves are odd."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    """A folder of documents and questions; gives a query's rows and its SQL's."""
    base = tmp_path_factory.mktemp("scores")
    asked = [(71, "Inges of stwhly erth ouer to eresea thingoror"), (72, " ".join(["Seven", *(f"w{k:02}x" for k in range(41))]))]
    texts = [asked[0][1], "mit eingeß be\nInges war da", asked[1][1], "only w07x of them have some other things there 5", "Press and w01x w02x w03x w04x w05x"]
    docs = [(10 * k + (7, 0, 1, 3)[k % 4], f"{asked[q][1]}\n{t}", "en", "web", 1) for k, (q, t) in enumerate((q, t) for q in (0, 1) for t in texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(asked, "item_id bigint, text string").coalesce(1).write.parquet(f"{base}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet/*.parquet'")

    def both(name):
        frame = __spark_entry__.queries()[name](spark, str(base))
        want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        return Counter(map(tuple, frame.collect())), Counter(want)

    return both


def test_histogram_counts_sharp_s_as_its_sql(scored):
    got, want = scored("score_histogram")
    assert got == want


def test_scores_round_halves_as_their_sql(scored):
    got, want = scored("evidence_score")
    assert got == want
