"""Every query with SQL against DuckDB on the smallest tables, and the entry module's contract."""

import ast
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__  # noqa: E402
from cairnspark.plans import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert columns == sorted(names) and got == want


def test_entry_lists_all():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_llm_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "cairnspark")):
        if os.sep + "llm" in folder:
            continue
        for name in (n for n in names if n.endswith(".py")):
            tree = ast.parse(open(os.path.join(folder, name)).read())
            said = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in s for s in said), name


def against_sql(spark, folder, name, documents, **others):
    """The query's and the SQL's rows over written tables."""
    con = duckdb.connect()
    for t, df in {"documents": documents, **others}.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})")
    return sorted(map(plain, map(tuple, got.collect())), key=repr), sorted(map(plain, found.fetchall()), key=repr)


def test_markdown_of_a_long_source_comes_in_parts(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "build_markdown", spark.range(450).selectExpr("id AS doc_id", "'s' AS source", "concat(repeat('ab ', 13334), id, ' ') AS text"))
    assert got == want and [r[1] for r in got] == [0, 1]


def test_equal_scores_rank_by_id(spark, tmp_path):
    """Texts of the same words in another order have sums that differ in the last bit only."""
    words = "'alpha', 'beta', 'gamma', 'delta', 'omega', 'sigma', 'kappa'"
    text = f"array_join(transform(array_sort(transform(array({words}), w -> struct(md5(concat(w, id % 5)) AS k, w AS w))), x -> x.w), ' ')"
    docs = spark.range(60).selectExpr("id AS doc_id", f"concat({text}, '. ', repeat(concat('w', id, ' '), 3)) AS text", "'en' AS lang", "concat('src', id % 3) AS source", "100L AS n_chars")
    got, want = against_sql(spark, tmp_path, "hybrid_topk", docs, benchmark=spark.createDataFrame([(1, "omega beta kappa alpha sigma delta gamma")], "item_id bigint, text string"))
    assert got == want and len(got) == 8


def test_old_sources_are_found_by_their_titles(spark, tmp_path):
    """260 sources, of which queries name some of the oldest; and some that all titles hold a word of."""
    text = "CASE WHEN id IN (5, 17, 40) THEN concat('kappa', id, ' stands here alone') ELSE concat('plain words of text', id) END"
    docs = spark.range(260).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "concat('src', id) AS source", "30L AS n_chars")
    asked = spark.createDataFrame([(1, "x y kappa5 lambda"), (2, "x y kappa nothing"), (3, "x y plain nowhere")], "item_id bigint, text string")
    got, want = against_sql(spark, tmp_path, "hybrid_search", docs, benchmark=asked)
    assert got == want and {r[2] for r in got if r[0] == 1} >= {"e5"} and {r[2] for r in got if r[0] == 2} >= {"e5", "e17", "e40"}
