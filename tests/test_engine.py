from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexloom.engine import Engine

from test_sources import XML

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import this module

CHARACTERS = '<c><character><literal>書</literal><misc><grade>2</grade><stroke_count>10</stroke_count><freq>169</freq><jlpt>4</jlpt></misc><reading_meaning><rmgroup><reading r_type="ja_on">ショ</reading><reading r_type="ja_kun">か.く</reading><meaning>write</meaning></rmgroup></reading_meaning></character></c>'


class Lengths:
    """A stand-in encoder."""

    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_engine(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    (tmp_path / "k.xml").write_text(CHARACTERS)
    e = Engine(spark, str(tmp_path / "store"))
    assert e.ready() == 0
    e.build(str(tmp_path / "d.xml"), str(tmp_path / "k.xml"), encoder=Lengths())
    assert e.ready() == 2
    q = spark.createDataFrame([(1, "How do you say bread in Japanese?", [20.0, 1.0]), (2, "書いた", None), (3, "to write", [30.0, 1.0]), (4, "犬書く無", None)], "qid long, query string, qv array<double>")
    best = {r.qid: r for r in e.search(q).where("rank = 1").collect()}
    assert best[1].reading == "パン" and best[1].method == "heuristic" and best[3].kanji_form == "書く"
    assert best[2].kanji_form == "書く" and best[2].inflection == "Past" and [(p.text, p.rt) for p in best[2].ruby] == [("書", "か"), ("く", None)]
    assert best[2].variants.kana_only == ["カク"]
    lifted = e.with_segments(spark.createDataFrame([(9, "カク無書く画")], "qid long, query string"))
    assert [r.surface for r in lifted.orderBy("rank").collect()][:1] == ["カク"]
    assert [r.text for r in e.segments(spark.createDataFrame([(1, "パンを書く")], "id long, sentence string")).orderBy("pos").collect()] == ["パン", "を", "書く"]
    card = e.cards(spark.createDataFrame([("書",), ("無",)], "literal string")).orderBy("literal").collect()
    assert {c.literal: c.stroke_count for c in card} == {"書": 10, "無": None} and [w.kanji_form for c in card if c.literal == "書" for w in c.words] == ["書く"]
    assert e.group("strokes", 10).count() == 1 and e.random_character(1, "N5").first().literal == "書" and e.groups().count() == 10
    assert [(r.lang, r["count"]) for r in e.loanword_facets().collect()] == [("eng", 1), ("por", 1)] and e.loanword_page("wasei").count() == 1 and e.loanword_page("xxx").count() == 0
    assert len(e.conjugation(spark.createDataFrame([("書く",)], "word string")).first().inflected_forms) == 15
    assert e.related(F.col("id") == 10).count() == 0
    (tmp_path / "d2.xml").write_text(XML.replace("to draw", "to paint").replace("<ent_seq>11", "<ent_seq>14"))
    changes = {(r.id, r.change) for r in e.refresh(str(tmp_path / "d2.xml"), encoder=Lengths()).collect()}
    assert changes == {(10, "changed"), (11, "gone"), (14, "new")} and {r.id for r in e.table("vectors").collect()} == {10, 14}
    full = Engine(spark, str(tmp_path / "full"))
    full.build(str(tmp_path / "d2.xml"))
    assert sorted(map(str, full.table("entries").collect())) == sorted(map(str, e.table("entries").select(full.table("entries").columns).collect()))
