"""Files in and out, hooks."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import clean
from corpusforge.operators import model, qa, spans, splits
from corpusforge.runtime import cut
from corpusforge.sources import conll, files


def test_texts_and_lines(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("x\r\ny\rz".encode())
    (tmp_path / "a.txt").write_text("Þ")
    (tmp_path / "c.md").write_text("no")
    got = {r["file"]: r["text"] for r in files.read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"b.txt": "x\ny\nz", "a.txt": "Þ"}
    assert conll.file_lines(spark, str(tmp_path)).where("file = 'b.txt'").count() == 3


def test_json_forms(spark, tmp_path):
    rows = [{"label": "PER", "subtype": None}, {"label": "LOC", "subtype": "SET"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "o.json").write_text(json.dumps(rows[0]))
    schema = "label string, subtype string"
    for name, n in (("a", 2), ("l", 2), ("o", 1)):
        assert files.read_json_any(spark, str(tmp_path / f"{name}.json"), schema).count() == n
    paths = [str(tmp_path / f"{n}.json") for n in ("a", "l", "o", "gone")]
    assert files.merge_json(spark, paths, schema).count() == 5
    with pytest.raises(FileNotFoundError):
        files.existing(spark, [str(tmp_path / "gone")])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc', [1, 2]), (2, None, [])], "id int, text string, xs array<int>")
    files.write_csv(df, str(tmp_path / "c"))
    got = {r["id"]: (r["text"], r["xs"]) for r in files.read_csv(spark, str(tmp_path / "c"), "id int, text string, xs string").collect()}
    assert got == {1: ('a "b",\nc', "[1,2]"), 2: (None, "[]")}


def test_manifest_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "experiment string, n int")
    m = json.loads(files.manifest(df, random_seed=42))
    assert m["random_seed"] == 42 and m["experiments"] == [{"experiment": "a", "n": 1}]
    files.write_html_report(spark.createDataFrame([("<b>",)], "x string"), str(tmp_path / "r.html"), "t")
    page = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in page and json.loads(page.split('id="data">')[1].split("</script>")[0]) == [{"x": "<b>"}]
    with pytest.raises(ValueError):
        files.manifest(spark.range(files.MANIFEST_ROWS + 1))


def _written(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_bytes_of_conll_files(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "B-Person"), (2, 0, "c", "O"), (3, 0, "d", "O")], "sent_id int, tok_id int, token string, label string").repartition(3)
    conll.write_conll(t, str(tmp_path / "after"), ["sent_id"])
    conll.write_conll(t, str(tmp_path / "between"), ["sent_id"], trailing_blank=False)
    assert _written(tmp_path / "after") == b"a\tO\nb\tB-Person\n\nc\tO\n\nd\tO\n\n"
    assert _written(tmp_path / "between") == b"a\tO\nb\tB-Person\n\nc\tO\n\nd\tO\n"


def test_json_array_file(spark, tmp_path):
    rows = [(2, "þá", None), (1, 'a "b"', ["x"])]
    files.write_json_array(spark.createDataFrame(rows, "id int, text string, xs array<string>"), str(tmp_path / "j"), ["id"])
    want = json.dumps([{"id": 1, "text": 'a "b"', "xs": ["x"]}, {"id": 2, "text": "þá", "xs": None}], ensure_ascii=False, indent=2)
    assert _written(tmp_path / "j").decode() == want + "\n"
    files.write_json_array(spark.createDataFrame([], "id int"), str(tmp_path / "e"), ["id"])
    assert _written(tmp_path / "e") == b"[]\n"


def test_tagged_lines(spark):
    lines = ["orð\tN\torð", "bad\tN", "", "ok\tC\tok"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ln int, line string")
    assert [(r["word"], r["block"]) for r in conll.tagged_lines(df).orderBy("ln").collect()] == [("orð", 0), ("ok", 1)]


def test_model_hooks(spark):
    def load():
        return lambda texts: [[{"start": 0, "end": 2, "word": t[:3], "entity": "PER", "score": 0.5}] if t.startswith("Ari") else [] for t in texts]

    df = spark.createDataFrame([(1, "Ari kom"), (2, None), (3, "x")], "id long, text string")
    assert [tuple(r) for r in model.tag_texts(df, load, "id", "text").collect()] == [(1, 0, 2, "Ari", "PER", 0.5)]
    e = {r["id"]: r["embedding"] for r in model.embed_texts(df, lambda: lambda ts: [[len(t), 1.0] for t in ts], "text").collect()}
    assert e == {1: [7.0, 1.0], 2: None, 3: [1.0, 1.0]}


def test_small_helpers(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "g string, no int")
    assert sorted(r["no"] for r in qa.sample_places(df, ["g"], "no").collect()) == [0, 2, 5, 9]
    assert spark.createDataFrame([("a\tb",)], "t string").select(clean.visible_blanks(F.col("t"))).first()[0] == "a⇥b"
    assert spark.createDataFrame([("x\x07\u200b" + "y" * 120,)], "t string").select(clean.visible_blanks(F.col("t"))).first()[0] == "x\\u0007\\u200b" + "y" * 87 + "..."
    assert cut(df).count() == 10
    assert [r["no"] for r in splits.shuffled(df, ["no"]).collect()] == [r["no"] for r in splits.shuffled(df.repartition(3), ["no"]).collect()]


def test_dataset_round_trip(spark):
    texts = spark.createDataFrame([(1, "Ari ok Þóra", "non"), (2, None, None)], "doc_id long, text string, lang string")
    names = spark.createDataFrame([(0, "Þóra", "PER", "NIC"), (1, "Ari", "PER", None)], "ent int, text string, label string, subtype string")
    packed = spans.pack_dataset(texts, spans.occurrences(texts, names, "doc_id", "text"), spans.word_spans(texts, "doc_id", "text"), "doc_id", ["lang"])
    one = packed.where("doc_id = 1").first()
    assert one["entity_types"] == ["PER", "PER-NIC"] and one["entity_start_chars"] == [0, 7] and one["word_end_chars"] == [2, 5, 10]
    assert packed.where("doc_id = 2").first()["entity_types"] == []
    assert {(r["type"], r["text"]) for r in spans.unpack_dataset(packed, "doc_id").collect()} == {("PER", "Ari"), ("PER-NIC", "Þóra")}
