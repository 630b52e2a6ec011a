"""Golden cases of single operators."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import clean, similarity, unicode_fns
from corpusforge.operators import align, cluster, entities, extract, leakage, qa, spans, splits, stats
from corpusforge.sources import conll


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("f, text, want", [
    (clean.strip_line_numbers, "12. [Þa] for 3 menn", "Þa for 3 menn"),
    (clean.strip_line_numbers, "12\nok [fe]", "ok fe"),
    (clean.remove_braces, "a {x {y} z} b", "a z} b"),
    (clean.join_broken_words, "hann kon-\nungr mælti\n\n þa", "hann konungr\nmælti\nþa"),
    (lambda c: clean.join_broken_words(c, "·"), "kon·ungr mælti a·b·c", "konungr\nmælti ab\n·c"),
    (clean.space_punctuation, 'hann for. " þa kom... ok-a', 'hann for . "\nþa kom .\n.\n.\nok - a'),
    (clean.remove_dot_below, "q̣uað", "quað"),
    (clean.remove_dot_below, "ạ", "ạ"),
    (unicode_fns.remove_dot_below_composed, "ạ", "a"),
    (clean.repair_mojibake, "HlÃ\xadÃ°arenda", "Hlíðarenda"),
    (clean.repair_mojibake, "þǫr", "þǫr"),
    (clean.comparison_key, "  Hann \t KOM ", "hann kom"),
    (clean.plain_markup, "<ex>a</ex>  b &amp;lt; &#x41;c", "a b < c"),
    (clean.long_label, "per", "Person"),
    (clean.long_label, "SHIP", "SHIP"),
    (clean.tei_running_text, "<TEI><body a='1'><w><me:dipl>Hann <ex>kom</ex>.</me:dipl></w><me:dipl/> <w><me:dipl>Ok</me:dipl></w></body></TEI>", "Hann kom .\nOk"),
    (clean.tei_running_text, "<TEI/>", ""),
    (unicode_fns.nfc, "ǫ", "ǫ"),
])
def test_text(spark, f, text, want):
    assert one(spark, text, f) == want


@pytest.mark.parametrize("f", [clean.strip_line_numbers, clean.remove_braces, clean.join_broken_words, clean.space_punctuation, clean.remove_dot_below, clean.comparison_key, clean.plain_markup, clean.tei_running_text, unicode_fns.nfc, clean.repair_mojibake])
def test_null_and_empty_text(spark, f):
    assert one(spark, None, f) in (None, "")
    assert one(spark, "", f) == ""


def test_peeled_tokens(spark):
    text = """Haraldr "konungr" (fór), til Noregs...  [sic] '\""""
    assert " ".join(one(spark, text, clean.peel_tokens)) == """Haraldr " konungr " ( fór ) , til Noregs . . . [ sic] ' \""""


def test_words(spark):
    text = "þórr's q̣uað ½x ꜵ́ gaf-i a_b ᚠᚢ ²"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = spans.word_spans(df, "id", "text").orderBy("id", "pos").collect()
    assert [r["word"] for r in got] == ["þórr's", "q", "uað", "½x", "ꜵ", "gaf-i", "a_b", "ᚠᚢ", "²"]
    assert all(text[r["start"] : r["end"] + 1] == r["word"] for r in got)


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "Ari ok Þari, Ari\nAri. Arinn"), (2, None)], "id int, text string")
    names = spark.createDataFrame([(0, "Ari", "PER", None), (1, "ari", "PER", None), (2, "Ari", "PER", None), (3, "", "PER", None)], "ent int, text string, label string, subtype string")
    got = {(r["text"], r["start"], r["end"]) for r in spans.occurrences(docs, names, "id", "text").collect()}
    assert got == {("Ari", 0, 2), ("Ari", 17, 19), ("ari", 8, 10)}
    assert spans.occurrences(docs, names, "id", "text", keep="all").count() == 5
    assert spans.occurrences(docs, names.limit(0), "id", "text").count() == 0


def test_bio_spans(spark):
    rows = [(1, i, t, l) for i, (t, l) in enumerate([("Áslaug", "B-Person"), ("Þorgeirsdóttir", "I-Person"), ("kom", "O"), ("Noregi", "I-Location"), ("Ari", "B-Person"), ("x", None)])]
    t = spark.createDataFrame(rows, "s int, tok_id int, token string, label string")
    assert [(r["text"], r["label"]) for r in extract.bio_entities(t, ["s"]).orderBy("start").collect()] == [("Áslaug Þorgeirsdóttir", "PER"), ("Ari", "PER")]


@pytest.mark.parametrize("body, want", [
    ("(NPR-D Aðalsteini-aðalsteinn) (NPR-D konungi-konungur)", [("Aðalsteini", "PER"), ("Aðalsteini konungi", "PER-ROL")]),
    ("(NPR-N Eiríkur-eiríkur) (NP-PRN (N-N konungur-konungur))", [("Eiríkur", ""), ("Eiríkur konungur", "PER-ROL")]),
    ("(NPR-N konungur-konungur) (NPR-N Ari-ari)", [("Ari", "PER"), ("konungur Ari", "PER-ROL")]),
    ("(NPRS-N Danir-danir)", []),
])
def test_treebank(spark, body, want):
    texts = spark.createDataFrame([("f", f"( (IP-MAT {body} ) (ID A,1.1))\n\n( (IP (NPR-N ARI-ari)) (ID A,1.2))")], "file string, text string")
    got = [(r["dipl_text"], r["label"]) for r in extract.psd_entities(extract.psd_sentences(texts)).orderBy("sent", "no").collect()]
    assert got == want + ([] if any(w[0].lower() == "ari" for w in want) else [("ARI", "")])


W = "<w><choice><me:dipl>{0}</me:dipl><me:norm>{1}</me:norm></choice></w>"


def test_tei_names(spark):
    xml = f"<placeName>{W.format('noꝛeg', 'Noreg')}</placeName> <persName>{W.format('<ex>a</ex>ri', 'Ari')}{W.format('x', 'y')}</persName><addName type=\"patronymic\">{W.format('p', 'P')}</addName><addName type=\"\">{W.format('q', 'Q')}</addName><addName type=\"odd\">{W.format('z', 'Z')}</addName>"
    df = spark.createDataFrame([(1, xml), (2, None)], "id int, xml string")
    got = [(r["dipl_text"], r["norm_text"], r["label"], r["subtype"]) for r in extract.tei_names(df).orderBy("ord").collect()]
    assert got == [("noꝛeg", "Noreg", "LOC", None), ("ari x", "Ari y", "PER", None), ("p", "P", "PER", "PAT"), ("q", "Q", "PER", None), ("z", "Z", "PER", "ODD")]


def test_tei_persons(spark):
    xml = f"<persName><forename>{W.format('a', 'A')}</forename><roleName>{W.format('k', 'K')}</roleName><addName type=\"nickname\">{W.format('n', 'N')}</addName></persName><placeName><country>{W.format('c', 'C')}</country><region>{W.format('r', 'R')}</region></placeName>"
    got = [(r["dipl_text"], r["norm_text"], r["label"], r["subtype"]) for r in extract.tei_persons(spark.createDataFrame([(1, xml)], "id int, xml string")).orderBy("ord").collect()]
    assert got == [("a", "A", "PER", None), ("a k", "A K", "PER", "ROL"), ("a n", "A N", "PER", "NIC"), ("n", "N", "PER", "NIC"), ("r", "R", "LOC", "REG"), ("c", "C", "LOC", "CNY")]


def test_tei_geog_names_and_compat(spark):
    df = spark.createDataFrame([(1, f"<geogName type=\"river\">{W.format('a', 'A')}{W.format('b', 'B')}</geogName>")], "id int, xml string")
    assert extract.tei_geog_names(df).first()["norm_text"] == "A B"
    assert extract.tei_geog_names(df, compat=True).first()["norm_text"] == "A A B B"


def test_labels(spark):
    df = spark.createDataFrame([("", None), ("PER-ROL", None), ("LOC", "X"), (None, None)], "label string, subtype string")
    assert [tuple(r) for r in entities.split_label(df).collect()] == [("PER", None), ("PER", "ROL"), ("LOC", "X"), ("PER", None)]


def _align(spark, tokens, names):
    docs = spark.createDataFrame([(1, tokens)], "doc_id int, tokens array<string>")
    listed = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "ent long, text string, label string")
    return [r["label"] for r in align.align(docs, listed).orderBy("tok_id").collect()]


def test_alignment(spark):
    assert _align(spark, "Haraldr Gormsson ok Haraldr".split(), [("Haraldr", "PER"), ("Haraldr Gormsson", "PER")]) == ["B-Person", "I-Person", "O", "B-Person"]
    assert _align(spark, "ari Ari ari".split(), [("Ari", "PER")]) == ["O", "B-Person", "B-Person"]
    for text, want in (("Ari - Sk", 3), ("Ari Sk", 2), ("Ari- Sk", 0), ("x ari-sk", 1)):
        assert sum(x != "O" for x in _align(spark, text.split(), [("Ari-Sk", "PER")])) == want


def test_similarity(spark):
    df = spark.createDataFrame([("haraldr", "haraldi"), ("martha", "marhta"), ("þórr", "thor"), ("", ""), (None, "a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(similarity.jaro_col(a, b).alias("j"), similarity.jaro_winkler_col(a, b).alias("w"), similarity.combined_similarity(a, b).alias("c"), F.levenshtein(a, b).alias("l"), similarity.common_prefix(a, b).alias("p")).collect()
    assert rows[0]["j"] == pytest.approx(0.904761904) and rows[0]["w"] == pytest.approx(0.942857142) and rows[0]["c"] == pytest.approx(0.876190476)
    assert rows[1]["j"] == pytest.approx(0.944444444) and rows[2]["l"] == 3 and rows[0]["p"] == 6 and rows[3]["c"] == 1.0 and rows[4]["c"] is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(similarity.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0], abs=1e-9)


def test_rareness_and_factors(spark):
    rows = [(1, i, l) for i, l in enumerate(["B-Person", "I-Person", "B-Location"] + ["O"] * 5)] + [(2, i, l) for i, l in enumerate(["B-Person"] + ["O"] * 7)]
    t = spark.createDataFrame(rows, "sent_id int, tok_id int, label string")
    s = {r["type"]: r["rareness"] for r in stats.corpus_stats(t).collect()}
    assert s["Person"] == pytest.approx(2.415037, abs=1e-6) and s["Location"] == 4.0
    for method, want in (("sC", (4, 2)), ("sCR", (4, 3)), ("sCRD", (5, 2)), ("nsCRD", (4, 2))):
        f = {r["sent_id"]: r["factor"] for r in splits.factors(t, stats.corpus_stats(t), ["sent_id"], method).collect()}
        assert (f[1], f[2]) == want


@pytest.mark.parametrize("n, dev", [(10, 1), (20, 3), (33, 4), (100, 15), (0, 0)])
def test_split_sizes(spark, n, dev):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = splits.ratio_split(df, ["k"])
    assert got.count() == n and got.where("split = 'dev'").count() == dev and got.where("split = 'test'").count() == dev


def test_conll_readers(spark):
    lines = "Ari\tX\tB-Person\n\tO\nkom\n  \n\n\nok\tO".split("\n")
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ln int, line string")
    a = [(r["sent_id"], r["tok_id"], r["token"], r["label"]) for r in conll.sentence_ids(conll.parse_conll(df, "last")).orderBy("sent_id", "tok_id").collect()]
    assert a == [(1, 1, "Ari", "B-Person"), (2, 1, "ok", "O")]
    b = [(r["token"], r["label"]) for r in conll.sentence_ids(conll.parse_conll(df, "second")).orderBy("sent_id", "tok_id").collect()]
    assert b == [("Ari", "X"), ("", "O"), ("ok", "O")]


def test_conll_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(s, i, f"w{s}{i}", "O") for s in (1, 2) for i in range(3)], "sent_id int, tok_id int, token string, label string")
    conll.write_conll(t, str(tmp_path / "x"), ["sent_id"])
    back = conll.read_conll(spark, str(tmp_path / "x"))
    assert {(r["sent_id"], r["token"]) for r in back.collect()} == {(r["sent_id"], r["token"]) for r in t.collect()}


def test_running_count_over_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(50)], "p string, o int, f boolean")
    got = conll.running_count(df, ["p"], "o", F.col("f"), "n", block=7).orderBy("o").collect()
    assert [r["n"] for r in got] == [i // 3 + 1 for i in range(50)]


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, "Áðr kom HANN þar  um kveld. ok fór\n\n\nheim"), (2, "x"), (3, None)], "doc_id int, text string")
    sents = spark.createDataFrame([(1, "kom hann þar um kveld."), (2, "ok fór"), (3, None)], "review_id int, text string")
    pairs = leakage.contained_pairs(docs, sents, "doc_id", "review_id")
    assert [tuple(r) for r in pairs.collect()] == [(1, 1)]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in leakage.remove_sentences(docs, sents, pairs, "doc_id", "review_id").collect()}
    assert got == {1: ("Áðr ok fór\n\nheim", 1), 2: ("x", 0), 3: (None, 0)}


def test_invalid_characters(spark):
    df = spark.createDataFrame([(1, "a\tb\n\x01c\ue000\ufffd"), (2, None), (3, "ok")], "id int, text string")
    got = [(r["line"], r["position"], r["category"]) for r in qa.invalid_characters(df, "id").orderBy("line", "position").collect()]
    assert got == [(1, 2, "non-printable character"), (2, 1, "control character"), (2, 3, "private use character"), (2, 4, "replacement character")]


def test_clusters(spark):
    rows = [(i, "PER", t) for i, t in enumerate(["Haraldr", "Haraldi", "Haralds", "Eiríkr", "Eiríks", "Óláfr", "Óláfs"])] + [(99, "LOC", "Noregr")]
    df = spark.createDataFrame(rows, "id long, kind string, text string")
    c = cluster.cluster_names(df, vector=None)
    by = {r["text"]: r["cluster"] for r in c.collect()}
    assert by["Haraldr"] == by["Haraldi"] == by["Haralds"] != by["Eiríkr"] == by["Eiríks"] and by["Óláfr"] == by["Óláfs"] and by["Noregr"] == -1
    cut = cluster.cluster_names(df, vector=None, limit=3)
    assert {r["text"] for r in cut.collect()} == {r[2] for r in rows}


def test_curation(spark):
    c = spark.createDataFrame([(i, "k", "", f"t{i}", i % 3) for i in range(6)], "id long, kind string, block string, text string, cluster int")
    h = cluster.History(c)
    h.apply(cluster.merge, [2, 1])
    h.apply(cluster.create, [0], "k")
    got = {r["id"]: r["cluster"] for r in h.now.collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1}
    h.undo()
    assert {r["id"]: r["cluster"] for r in h.now.collect()}[0] == 0
    assert cluster.search(c, "T1").count() == 1 and cluster.export(c).count() == 3


def test_blocks_of_names_align_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ari Sk ok ari - sk , Haraldr Gormsson".split()), (2, []), (3, None), (4, ["Haraldr", None, "Ari"])], "doc_id long, tokens array<string>")
    names = spark.createDataFrame([(0, "Ari", "PER"), (1, "Ari-Sk", "LOC"), (2, "Haraldr", "PER"), (3, "Haraldr Gormsson", "PER"), (4, "ok", "ORG")], "ent long, text string, label string")
    rows = lambda: sorted((r["doc_id"], r["tok_id"], str(r["token"]), r["label"]) for r in align.align(docs, names).collect())
    one = rows()
    monkeypatch.setattr(align, "BLOCK", 2)
    assert rows() == one and len(one) == 12
