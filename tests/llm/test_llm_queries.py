"""The registered queries against their SQL, and the pipeline stage by stage against SQL and plain versions."""

import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute
import corpus_pipeline

import __spark_entry__ as entry
from truthmill.llm import licenses, oracles
from truthmill.llm.queries import ORACLES, QUERIES
from truthmill.operators.shared import stored

FOLDER = "/root/testdata/sf0.001"


def same(a, b):
    return a == b or (isinstance(a, float) and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op11_hard_negatives"}))  # that one has no doc_id; its test is with its operator's
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = {r[columns.index("doc_id")]: dict(zip(columns, r)) for r in result.fetchall()}
    ours = df.collect()
    assert len(ours) == len(theirs)
    for row in ours:
        assert all(same(row[c], theirs[row.doc_id][c]) for c in columns), (row, theirs[row.doc_id])


@pytest.mark.parametrize("name", ["op4_license_scan", "op7_line_dedup", "op9_quality_rules"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("EvalPython", "MapIn", "InPandas", "InArrow", "Cartesian"))


@pytest.mark.parametrize("name", ["op2_histogram_shards", "op1_interpolated_model", "op10_substring_dedup"])
def test_rows_of_the_others(spark, name):
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_repeated_long_lines_go_by_sql_too(spark, tmp_path):
    """One or two lines of fifty words and more are runs; the rule of three lines alone leaves them."""
    long, half = " ".join(f"a{i}" for i in range(50)), [" ".join(f"{c}{i}" for i in range(25)) for c in "bc"]
    rows = [(1, f"x\n{long}\ny"), (2, f"z\n {long} \nq"), (3, "\n".join(half)), (4, "new\n" + "\n\n".join(half)), (5, half[0]), (6, f"{long}\n{long}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(ORACLES["op7_line_dedup"])
    columns = [c[0] for c in result.description]
    got = sorted(map(tuple, QUERIES["op7_line_dedup"](spark, str(tmp_path)).select(*columns).collect()))
    assert got == sorted(result.fetchall())
    assert [r[columns.index("n_removed")] for r in got] == [0, 1, 0, 2, 0, 2]


def by_query_and_sql(spark, folder, name, docs):
    """Columns and sorted rows of a query over the given documents, equal to those of its SQL."""
    docs.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    got = sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect()), key=str)
    wanted = sorted(result.fetchall(), key=str)
    assert len(got) == len(wanted) and all(same(a, b) for x, y in zip(got, wanted) for a, b in zip(x, y))
    return columns, got


def test_wrapped_notices_by_sql_too(spark, tmp_path):
    rows = []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        for width in (1, 3, 7, 99):
            rows.append((len(rows), "a b\n" + "\n".join(" * " + " ".join(words[j : j + width]) for j in range(0, len(words), width)) + "\nend"))
        rows.append((len(rows), "\n".join(w + " z" * 5 for w in words)))
        rows.append((len(rows), "\n".join([" ".join(words[:3]), *words[5:]])))
    rows += [(7, None), (8, ""), (8, "it was released\nLicensed under the Apache License, Version 2.0."), (9, "cc\nby cc by")]
    columns, got = by_query_and_sql(spark, tmp_path, "op4_license_scan", spark.createDataFrame(rows, "doc_id long, text string"))
    labels = {r[columns.index("doc_id")]: r[columns.index("labels")] for r in got}
    assert labels[30] == labels[31] == labels[32] == "bsd" and labels[34] == ""  # by lines alone only number 33 has a label


def test_junk_beyond_a_quarter_by_sql_and_numpy(spark, tmp_path):
    """The estimate on half of the texts judges one group, the usual one another, a pool of small groups a third, and one is too small."""
    rng = np.random.default_rng(17)
    words = [f"{a}{b}" for a in ("wor", "te", "ran", "mil") for b in ("d", "xt", "ge", "ler", "sing")]
    rows = []
    for lang, source, n, junk in (("en", "a", 300, 0.4), ("en", "b", 200, 0.1), (None, "c", 70, 0.1), (None, None, 60, 0.0), ("de", "d", 40, 0.5)):
        for i in range(n):
            bad = i < junk * n
            own = rng.choice(words, 100 if bad else rng.integers(30, 300))
            text = " ".join(w + "$$$" if bad and rng.random() < 0.8 else w.title() if rng.random() < 0.05 else w for w in own)
            rows.append((len(rows), text, lang, source))
    rows += [(5000, None, "en", "a"), (5001, "few words", "en", "a"), (5002, "a b c d e " * 20, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    columns, got = by_query_and_sql(spark, tmp_path, "op9_quality_rules", docs)
    plain = brute.quality([r[1:] for r in rows])
    found = {r[columns.index("doc_id")]: (r[columns.index("distance")], r[columns.index("kept")]) for r in got}
    assert len(found) == len(rows)
    for i, (key, *_) in enumerate(rows):
        assert found[key][1] == plain[i][1] and same(found[key][0], plain[i][0]), (key, found[key], plain[i])
    assert not any(plain[i][1] for i in range(120)) and sum(plain[i][1] for i in range(120, 300)) >= 120


def test_one_row_of_each_group_of_near_copies_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = text + " tail"
    rows = [(5, text), (5, near), (5, text), (9, near), (None, text), (7, "other words here"), (None, "quite alone"), (None, "quite alone"), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "7", "8", "8", "None"]  # texts without words are no copies


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")

    def run(i, docs):
        """The stage's result, its input now being DuckDB's documents."""
        path = f"{tmp_path}/in{i}"
        docs.write.parquet(path)
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        out = stored(corpus_pipeline.STAGES[i][1](spark, spark.read.parquet(path), FOLDER))
        if i < 4:
            assert out.columns == docs.columns
        return out

    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    rules = run(0, docs)
    assert ids(rules) == [r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.quality_rules()}) WHERE kept ORDER BY 1").fetchall()]
    lines = run(1, rules)
    cut = con.execute(f"SELECT doc_id, kept_sha256 FROM ({oracles.line_dedup()}) WHERE n_removed < n_word_lines ORDER BY 1").fetchall()
    assert sorted((r.doc_id, brute.sha(r.text)) for r in lines.select("doc_id", "text").collect()) == cut
    assert lines.filter("n_chars <> length(text)").isEmpty()
    near = run(2, lines)
    groups = brute.near([(r.doc_id, r.text) for r in lines.select("doc_id", "text").collect()])
    assert ids(near) == sorted(key for key, _, _, kept in groups if kept)
    clean = run(3, near)
    assert ids(clean) == [r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.benchmark_overlap()}) WHERE NOT contaminated ORDER BY 1").fetchall()]
    packed = run(4, clean)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect())
    )


#: Names that the stages use inside.
INSIDE = """_id _k _m _lines _gone _kept_text _gone_mark id mark number first order component_id any a b c n s1 s2 bands sig whole
_hs _splits hit hits items _item _lang _source kept_text text_hash n_shingles least smallest size heft own other i j gone new row""".split()


def test_pipeline_carries_odd_rows_and_columns(spark, odd, nothing):
    odd = odd.withColumns({name: F.lit(f"own {name}") for name in INSIDE})
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == odd.columns
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(ids) <= {None, 5, 6, 7, 8} and len(ids) == len(set(ids))
    assert docs.select("_k", "number").distinct().collect() == [("own _k", "own number")]
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
    assert docs.count() == 0
