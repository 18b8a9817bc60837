"""That long expressions are not computed again for every reader."""

from pyspark.sql import functions as F

from tarnlight.operators import gate
from tarnlight.operators import quality as ql
from tarnlight.sources import corpus as co


def test_audit_parses_once(spark):
    """The parts of an audit read the parsed fields; none of them folds over the lines again."""
    head = "---\ntitle: T\ntype: decision\nstatus: {}\nevidenceLevel: unit-test\nrelations: [related:{}]\n---\nbody"
    files = spark.createDataFrame([("a", "", head.format("partial", "b")), ("b", "", head.format("verified", "b")), ("c", "", "no head")], "slug string, source_path string, raw string")
    out = ql.audit_corpus(co.parse(files), ~co.is_excluded(F.col("status"), F.col("visibility")))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("b", "relations", "self"), ("b", "verifiedAt", "not allowed"), ("c", "frontmatter", "missing frontmatter")]


def test_rules_run_once(spark):
    """Decision and reason come from one expression."""
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    yes, why = gate._decided([(F.col("x") == 1, False, "one"), (F.col("x") == 2, True, F.lit("two"))], F.lit(True), F.lit("rest"))
    assert [tuple(r) for r in df.select("x", yes, why).orderBy("x").collect()] == [(1, False, "one"), (2, True, "two"), (3, True, "rest")]
