"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.SQL))
def test_same_rows(spark, duck, name):
    ours = __spark_entry__.queries()[name](spark, SF)
    theirs = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in ours.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs.fetchall()), key=repr)
    if a != b:  # a plain message: lists this long are not worth a diff
        raise AssertionError(f"{len(a)} and {len(b)} rows; first apart: {next(((x, y) for x, y in zip(a, b) if x != y), None)}"[:800])


def test_units_of_long_documents_stay_apart(spark, tmp_path):
    """Line 1,000 and word 100,000 have the numbers of the next document's first ones."""
    texts = [(1, "\n" * 1000 + "gamma"), (2, "gamma"), (3, " " * 100000 + "gamma delta"), (4, "alpha gamma")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "gamma x"), (4, "alpha x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: sorted((r.unit_id, r.term_id) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("term_pattern_join", "missing_terms"):
        theirs = con.execute(f"select unit_id, term_id from ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert run(name) == sorted(theirs), name
    assert [x for x in run("term_pattern_join") if x[0] == 2000] == [(2000, 2), (2000, 2)]
    # Word 100,000 of document 3 is gamma, word 0 of document 4 is alpha.
    assert [x for x in run("term_exact_join") if x[0] == 400000] == [(400000, 2), (400000, 4)]


def test_acronyms_that_a_text_repeats_stay(spark, tmp_path):
    """Runs within a text, at its start where the made output ends with the same acronym, and over a line's end."""
    texts = [(1, "see SS SS SS there"), (2, "DEF DEF begins"), (3, "TO\nTO"), (4, ""), (5, None), (6, "DEF"), (7, "DEFG ABC ABC")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = sorted((r.doc_id, r.text) for r in __spark_entry__.queries()["acronym_collapse"](spark, str(tmp_path)).collect())
    assert ours == sorted(con.execute(f"select doc_id, text from ({__spark_entry__.oracle_sql()['acronym_collapse']})").fetchall())
    assert ours[0] == (1, "ABC and very very DEF see SS SS SS there")


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.QUERIES) - set(__spark_entry__.SQL)))
def test_runs_and_does_not_depend_on_partitions(spark, name):
    query = __spark_entry__.queries()[name]
    first = sorted(map(str, query(spark, SF).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sorted(map(str, query(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first and first == again


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 200 and set(out.columns) >= {"doc_id", "kind", "route"}


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/sparkfolio", tmp_path / "sparkfolio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
