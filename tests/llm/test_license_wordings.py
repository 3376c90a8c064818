"""Which family a tie goes to."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.llm import license


def test_ties_go_to_the_first_family_by_name(spark, monkeypatch):
    found = spark.createDataFrame([(0, 1, n, 0, f, 0.9, True, 0.8) for n, f in enumerate(("MIT", "ISC", "MPL-2.0"))], "row long, doc_id long, line int, stretch long, family string, probability double, confirmed boolean, template_share double")
    documents = spark.createDataFrame([(0, 1, -1, 0, None, 0.0)], "row long, doc_id long, line int, stretch long, family string, probability double")
    monkeypatch.setattr(license, "scored", lambda *_: documents)
    monkeypatch.setattr(license, "confirmations", lambda _: found)
    monkeypatch.setattr(license, "notices", lambda x: x.select("row", "line", "family", "confirmed", "probability", F.col("template_share")))
    out = license.scan(documents, None).first()
    assert (out.license, out.n_confirmed, out.families) == ("ISC", 3, "ISC,MIT,MPL-2.0")
