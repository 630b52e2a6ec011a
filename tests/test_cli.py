"""The command line: arguments and whole runs on small files."""

import pytest

from corpusforge.__main__ import arguments, main

TEXT = "Ari\tB-Person\nkom\tO\n\nnú\tB-Date\n\nÍsland\tB-Location\ner\tO\n"


def _lines(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_arguments():
    a = arguments(["split", "in", "out"])
    assert (a.method, a.location_eval_ratio, a.seed) == ("sCR", 0.5, 42)
    with pytest.raises(SystemExit):
        arguments(["split", "in", "out", "--method", "x"])


def test_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    main(["filter", str(tmp_path / "in"), str(tmp_path / "out"), "--types", "Person", "--stats", str(tmp_path / "stats")])
    assert _lines(tmp_path / "out") == "Ari\tB-Person\nkom\tO\n\nnú\tO\n\nÍsland\tO\ner\tO\n\n"
    assert spark.read.json(str(tmp_path / "stats")).agg({"removed": "sum"}).first()[0] == 2


def test_split(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(TEXT for _ in range(10)))
    main(["split", str(tmp_path / "in"), str(tmp_path / "out"), "--method", "none"])
    n = {k: _lines(tmp_path / "out" / k).count("\n\n") + 1 for k in ("train", "dev", "test")}
    assert sum(n.values()) == 30 and n["dev"] >= 2 and n["test"] >= 3


def test_align(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Ari Sk kom, ari fór.")
    (tmp_path / "names.json").write_text('[{"ent": 0, "text": "Ari", "label": "PER"}, {"ent": 1, "text": "Ari Sk", "label": "PER"}]')
    main(["align", str(tmp_path / "in"), str(tmp_path / "names.json"), str(tmp_path / "out")])
    assert _lines(tmp_path / "out").split() == "Ari B-Person Sk I-Person kom O , O ari B-Person fór O . O".split()
