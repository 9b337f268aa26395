"""Rule packs read from files and run over books."""

import re

import duckdb

from folioscope.functions.dialect import Dialect
from folioscope.operators import relations
from folioscope.plans import catalogue, registry
from folioscope.sources import files

RULES = 'pack,rule,pattern,most_per_1k\nsea,S1,"\\b(?:ship|sail)s?\\b",1\nsea,S2,"storm, again",0\nsea,S3,[0-9]{4},0\nsea,S4,,0\nsea,S5,x,many\n'


def test_a_pack_is_a_file(spark, tmp_path):
    (tmp_path / "sea.csv").write_text(RULES)
    (tmp_path / "land.csv").write_text("pack,rule,pattern,most_per_1k\nland,L1,(?i)HILL,0\n")
    rules = files.packs(spark, str(tmp_path))
    assert sorted((r.pack, r.rule) for r in rules.collect()) == [("land", "L1"), ("sea", "S1"), ("sea", "S2"), ("sea", "S3")]
    texts = {"a": "The ship and the sails. storm, again storm, again.", "b": "A hill, a Hill <!-- hill --> and a ship.", "c": "ship ship ship", "d": "hill 1999", "e": "ship"}
    books = [("a", "Sea", None), ("b", "x", " Sea/ "), ("c", "None", None), ("d", "Sea", "Land"), ("e", "Tales of Water", "")]
    frames = {
        "pack_rules": rules, "pack_matches": spark.createDataFrame([("sea", "tales of water"), ("land", "sea")], "pack string, matched string"), "pack_projects": spark.createDataFrame(books, "manuscript_id string, genre string, subgenre string"),
        "chapters": spark.createDataFrame([(m, "chapter-1.md", 1, t) for m, t in texts.items()] + [("a", "chapter-2.md", 2, None)], "manuscript_id string, chapter string, ord long, raw string"),
    }
    found = {(r.manuscript_id, r.rule): (r.n, r.pack) for r in relations.run("pack_findings", **frames).collect()}
    assert found == {("a", "S1"): (2, "sea"), ("a", "S2"): (2, "sea"), ("b", "S1"): (1, "sea"), ("d", "L1"): (1, "land"), ("e", "S1"): (1, "sea")}
    bands = {r.manuscript_id: (r.n, r.band) for r in relations.run("pack_bands", **frames).collect()}
    assert bands == {"a": (2, "watch"), "b": (1, "clean"), "d": (1, "clean"), "e": (1, "clean")}
    assert len(re.findall("hill", texts["b"].lower())) == 3


#: Words end where no letter follows, of whatever script; a vertical tab is a blank; a mark belongs to its letter.
ODD = ["\xd1\xed \xf1dollar rent cent\u0301 cost\xe9", "may\x0b3 \xf1price \u03b1tv tv", "\u0661road road \u00b2road"]


def test_markers_end_at_any_letter_in_both_engines(spark, tmp_path):
    spark.createDataFrame([(i, t, "es", "s1", len(t)) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r) for r in catalogue.QUERIES["marker_scan"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == set(db.execute(catalogue.ORACLES["marker_scan"]).fetchall())
    assert {x for x in found if x[1] in ("money", "date", "street", "broadcast")} == {("es", "money", 1, 1), ("es", "date", 1, 1), ("es", "street", 2, 1), ("es", "broadcast", 1, 1)}


def test_rules_end_at_any_letter_in_both_engines(spark):
    rows = [("m1", f"c{i}", i, t) for i, t in enumerate(ODD)]
    frame = relations.run("pack_findings", chapters=spark.createDataFrame(rows, "manuscript_id string, chapter string, ord long, raw string"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.execute("CREATE TABLE odd (manuscript_id VARCHAR, chapter VARCHAR, ord BIGINT, raw VARCHAR)")
    db.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", rows)
    sql = registry.doubles(registry.BUILDERS["pack_findings"](Dialect(False, {"chapters": "odd"})))
    found = {tuple(r) for r in frame.collect()}
    assert found == set(db.execute(sql).fetchall()) and len(found) == 4
    # texts stay where they are read: a book's texts do not all go to one task
    assert "SortMergeJoin" not in plan.split("LocalTableScan")[0]
