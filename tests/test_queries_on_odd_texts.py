"""Queries on texts with white space at their ends, in runs and in other kinds, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrain.operators import chunking as ck
from lexigrain.plans import registry

ODD = [" lead", "trail ", "two  blanks  in it", "\n\n", " ", "", None, "tab\tand\r\nline end\n", "a\xa0b \u3000", "1. TERM. x\n\n2.1 LAW. y  3. Z end", "ARTICLE IV\nThe text.  ",
       "w " * 600, "  " + "x y\n" * 700, "\n".join(["word"] * 1000) + "\n\n", "plain words in a row", "é😀 ü\n ß", "  12. Begin here " * 60, "x" * 70 + "  " + "y" * 30]
NAMES = "A24_length_stats C12_chunk_content_hash C5_word_tokens C7_tokens_in_range C8_headings C9_chunks C9a_sections C9d_hard_split C9f_trim C17_with_context S15_replace_chunks".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    texts = ODD * 3
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts),
                             "n_chars": pa.array([len(x or "") for x in texts], pa.int64())}), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_give_what_the_sql_gives(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(tuple, registry.QUERIES[name](spark, folder).select(*columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)


def test_tokens_in_own_range_are_those_of_the_join(spark):
    texts = spark.createDataFrame([(i, x, a, b) for i, x in enumerate(ODD) for a, b in ((0, 5), (1, 9), (3, 3), (2, 5000), (-4, 4))], "document_id int, text string, char_start int, char_end int")
    for single in (False, True):
        tokens = ck.tokens(texts.dropDuplicates(["document_id"]), single)
        want = ck.tokens_in_range(tokens, texts.select("document_id", "char_start", "char_end"))
        assert sorted(map(tuple, ck.tokens_in_own_range(texts, single).collect())) == sorted(map(tuple, want.collect()))
    assert texts.select(F.count("*")).first()[0] == 5 * len(ODD)
