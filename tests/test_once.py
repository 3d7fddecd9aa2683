"""What is costly is worked out once: counted in the plans."""

import pytest
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.catalog import trail
from tracewell.catalog.registry import Inputs
from tracewell.functions.fields import normalized_proposition
from tracewell.functions.patterns import found, needles
from tracewell.functions.text import compare_key, compare_terms
from tracewell.operators import compare, versions


@pytest.fixture
def plan(spark):
    """The analyzed plan of a frame in full."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda frame: frame._jdf.queryExecution().analyzed().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_a_text_is_made_lower_case_once_per_pattern(spark, plan):
    rows = spark.createDataFrame([("The BBC SAID so",), ("nobody spoke",), (None,)], "text string")
    frame = rows.select(found(F.col("text"), K.REPORTING).alias("x"))
    assert len(needles(K.REPORTING)) > 2 and plan(frame).count("lower(") == 1
    assert [r.x for r in frame.collect()] == [True, False, None]


def test_keys_of_versions_are_made_once(spark, plan):
    given = Inputs(spark, "/root/testdata/sf0.001")
    made, snaps = (spark.createDataFrame([], f(given).schema) for f in (trail.made_versions, trail.snapshots))
    # six texts, the qualifiers, and the title that is looked for in passages
    assert plan(compare.bound_versions(made, snaps)).count(r"[^\p{L}\p{N} ]") == 8
    rows = spark.createDataFrame([("The  Re-Union, of the reunion!", None, "", "a b", ["according to X", "About it"])],
                                 "causal_language string, location string, quoted_speaker string, caption_context string, qualifiers array<string>")
    text = F.col("causal_language")
    row = compare.prepared(rows, {"text": text}).withColumns({"k": compare_key(text), "t": compare_terms(text)}).first()
    assert (row.text_key, row.text_terms, row.causal_language_terms) == (row.k, row.t, row.t)
    assert row.location_key is None and row.location_terms is None and row.quoted_speaker_terms == []
    assert [(m.label, m.key, m.terms) for m in row.meant] == [("About it", "about it", row.meant[0].terms)]


def test_passages_that_can_not_be_chosen_are_not_scored(spark, plan):
    given = Inputs(spark, "/root/testdata/sf0.001")
    frame = versions.select_passages(trail.snapshots(given).limit(0), trail.claims(given))
    scored = plan(frame).split("transform(filter(passages")[1]
    assert "provenance" in scored[:scored.index("\\p{L}")]


def test_framing_goes_whatever_its_case(spark):
    texts = ["FACT-CHECK: According to the Desk, it rained.", "Desk said that it rained", "it rained", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.x for r in rows.select(normalized_proposition(F.col("text"), F.lit(None).cast("string")).alias("x")).collect()]
    assert got == ["it rained", "it rained", "it rained", None]
