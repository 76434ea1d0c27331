"""Queries against their SQL on small tables made for a rule, nulls told from empty strings."""

import duckdb
import pytest

from paperloom import plans


@pytest.fixture()
def differences(spark, tmp_path):
    """(rows of the query only, rows of its SQL only) over tables given as SELECTs."""

    def run(name: str, **tables: str):
        con = duckdb.connect()
        for table, select in tables.items():
            con.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
        df = plans.queries()[name](spark, str(tmp_path))
        want = con.execute(plans.oracle_sql()[name])
        at = [df.columns.index(c[0]) for c in want.description]
        plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
        got, rows = sorted((plain(r[n] for n in at) for r in df.collect()), key=repr), sorted((plain(r) for r in want.fetchall()), key=repr)
        assert rows
        return [r for r in got if r not in rows], [r for r in rows if r not in got]

    return run


def test_nothing_missing_is_null(differences):
    benchmark = "SELECT 1::BIGINT AS item_id, 'user the a' AS text"
    conversations = "SELECT 1::BIGINT AS conv_id, 'user' AS role, 'the a' AS text"
    assert differences("coverage_rate", benchmark=benchmark, conversations=conversations, documents="SELECT 'en' AS lang") == ([], [])


def test_something_missing_is_named(differences):
    benchmark = "SELECT 1::BIGINT AS item_id, 'user zebra the' AS text"
    conversations = "SELECT 1::BIGINT AS conv_id, 'user' AS role, 'the a' AS text"
    assert differences("coverage_rate", benchmark=benchmark, conversations=conversations, documents="SELECT 'en' AS lang") == ([], [])


def test_bytes_of_images_are_rounded(differences):
    lines = "SELECT k AS l_orderkey, 1 AS l_linenumber, 150::BIGINT AS l_partkey, 16::BIGINT AS l_suppkey, 50.0::DOUBLE AS l_quantity, 2494.0 + k / 4.0 AS l_extendedprice FROM range(9) r(k)"
    assert differences("kept_images", lineitem=lines) == ([], [])


def test_noise_inside_a_block_stays(differences):
    rows = "SELECT 1::BIGINT AS conv_id, k AS turn, 'Head one two three four five six ' || CASE WHEN k = 1 THEN 'x\nHead' ELSE 'y' END || ' more words and still more' AS text FROM range(4) r(k)".replace("\n", "' || chr(10) || '")
    assert differences("noise_suppression", conversations=rows) == ([], [])


@pytest.mark.parametrize("name", ["noise_suppression", "header_footer_noise"])
def test_all_turns_count_for_noise(differences, name):
    # of 100 turns "Mid" begins the 64 in the middle, "Ends" the others; four turns of ten have no text
    text = "CASE WHEN conv_id = 2 AND k > 5 THEN NULL ELSE (CASE WHEN k BETWEEN 18 AND 81 THEN 'Mid' ELSE 'Ends' END) || ' one two three four five six seven Foot' || (k % 3) END"
    rows = f"SELECT conv_id, k AS turn, {text} AS text FROM range(100) r(k), (VALUES (1::BIGINT), (2::BIGINT)) c(conv_id) WHERE conv_id = 1 OR k < 10"
    assert differences(name, conversations=rows) == ([], [])


def test_search_tokens_of_whole_texts(differences, spark, tmp_path):
    texts = ["数字化转型 AI", "三个字 ab", "café au lait", "x１２ ٣٤ 5a_b c-dd", "abc中文", "Über UBER uber", "", "é"]
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS doc_id, '{text}' AS text" for k, text in enumerate(texts)) + " UNION ALL SELECT 99, NULL"
    assert differences("search_token_sets", documents=rows) == ([], [])
    got = {r.doc_id: r.n_tokens for r in plans.queries()["search_token_sets"](spark, str(tmp_path)).collect()}
    # a run of five characters is itself and its 4, 3 and 2 windows; words end where any letters do
    assert got == {0: 11, 1: 2, 2: 2, 3: 4, 4: 1, 5: 1, 6: 0, 7: 0, 99: 0}
