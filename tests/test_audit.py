"""The audit's queries against their SQL, published results, and the entry without the llm folders."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from provenlake import constants as K
from provenlake.functions import text as T
from provenlake.operators import calibrate, extract, verdict
from provenlake.plans import lexical, review, samples, semantic, surface

DATA = "/root/testdata/sf0.001"
QUERIES = lexical.QUERIES | semantic.QUERIES | review.QUERIES | surface.QUERIES
ORACLES = lexical.ORACLES | semantic.ORACLES | review.ORACLES | surface.ORACLES
#: one of each family that shares its SQL
COMPARED = [n for n in QUERIES if n in ORACLES and not n.startswith("flag_")] + ["flag_numeric_mismatch", "flag_scope_overreach"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in samples.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", COMPARED)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in found.fetchall()]
    assert rounded([r[c] for c in cols] for r in df.collect()) == rounded(want)


def test_dedupe_keeps_the_first(spark):
    text = "The parser can detect duplicate invoices in the queue.\n\nThe parser can detect duplicate invoices in queue! The parser can detect the duplicate invoices in the queue. Every invoice was audited in 2024."
    found = extract.extract_claims(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert found.filter("doc_id = 1").count() == 2 and found.count() == 2


def test_stems(spark):
    words = "ties parties running king reduced used class cats gas is".split()
    row = spark.range(1).select(T.terms(F.lit(" ".join(words))).alias("t")).first()
    assert row.t == ["tie", "party", "runn", "king", "reduc", "used", "class", "cat", "gas"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "gold string, cal string")


def test_published_agreement(spark):
    """The synthetic set of twelve: agreement, kappa, weighted kappa, AC2."""
    gold = "supported contradicted unsupported supported not_checkable not_checkable supported contradicted contradicted partially_supported supported contradicted".split()
    cal = "supported contradicted contradicted supported not_checkable not_checkable supported contradicted contradicted not_checkable supported contradicted".split()
    p = pairs(spark, list(zip(gold, cal)))
    assert tuple(calibrate.exact_agreement(p).first()) == (10, 12)
    assert calibrate.kappa(p).first().kappa == pytest.approx(13 / 17)
    row = calibrate.weighted_agreement(p).first()
    assert (row.n, round(row.weighted_kappa, 4), round(row.ac2, 4)) == (9, 0.9854, 0.9860)
    empty = pairs(spark, [])
    assert calibrate.kappa(empty).first().kappa == 0 and calibrate.confusion(empty).count() == 25


def test_vectors(spark):
    row = spark.range(1).select(verdict.normalized_vector(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), verdict.normalized_vector(F.array(F.lit(0.0))).alias("z"), verdict.entail_label(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("l")).first()
    assert row.v == [0.6, 0.8] and row.z == [0.0] and row.l == "neutral"
    assert set(K.SEVERITY) == set(K.VERDICTS)


def test_entry_without_llm():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'provenlake.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in [*e.queries(), *e.oracle_sql()])\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
