"""The ledger of used material, batch by batch, against one made of all chapters at once."""

from folioscope.functions.dialect import SPARK
from folioscope.operators.lint import over_frames
from folioscope.plans import contain
from folioscope.streaming import ledger


def test_batches_add_up_to_a_rebuild(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    texts = {("a", 1): "# One\n\nNight fell like a grey curtain. “Go,” muttered Ann. “Go,” said Bob.", ("a", 2): "Night again, like a grey curtain. Bob whispered, “No.”", ("b", 1): "Rain. “Yes,” whispered Cal."}
    later = {("a", 3): "Dawn rose like a red sail. “Up,” muttered Ann.", ("a", 1): "Nothing is left here.", ("b", 2): ""}
    for (m, i), text in texts.items():
        (folder / m).mkdir(parents=True, exist_ok=True)
        (folder / m / f"chapter-{i}.md").write_text(text)

    def step():
        ledger.ledger_stream(spark, str(folder), str(out), str(tmp_path / "check")).awaitTermination()
        return {(r.manuscript_id, r.kind, r.item): r.n for r in ledger.ledger(spark, str(out)).collect()}

    def rebuilt(all_texts):
        rows = [(m, f"chapter-{i}.md", t) for (m, i), t in all_texts.items()]
        found = over_frames(f"SELECT * FROM {contain.uses(SPARK, 'chapters_to_check')} x", chapters=spark.createDataFrame(rows, "manuscript_id string, chapter string, raw string"))
        sums = found.where("kind <> 'seen'").groupBy("manuscript_id", "kind", "item").sum("n").collect()
        return {(r[0], r[1], r[2]): r[3] for r in sums}

    first = step()
    assert first == rebuilt(texts) and first["a", "opening", "night"] == 2 and first["b", "tag", "whispered"] == 1
    assert any(k[1] == "simile" and n == 2 for k, n in first.items())
    for (m, i), text in later.items():
        (folder / "second" / m).mkdir(parents=True, exist_ok=True)
        (folder / "second" / m / f"chapter-{i}.md").write_text(text)
    assert step() == rebuilt(texts | later)
    chapters = {(r.batch, r.manuscript_id, r.chapter) for r in spark.read.parquet(str(out)).select("batch", "manuscript_id", "chapter").collect()}
    assert {c[1:] for c in chapters if c[0] == max(x[0] for x in chapters)} <= {(m, f"chapter-{i}.md") for m, i in later}
