"""Problem 2."""

import numpy as np
import pytest

from corpusforge.llm.sentences import ACTION, NEXT, SYM, SYMBOLS, run_transducer, sentences, split_sentences

#: Sentences are set apart by |.
CASES = [
    "„Eldur saga! |Mál lög þær,“ svaraði hún L. Þórgeirsson vinur... |Vakti brátt þeir.",
    "„Skip ekki?“ svaraði hún hestur. |(Hon kom.) |Nú o.s.frv. |„Ár.“ |„Dagr,“ kvað hon.",
    "Year asked etc. |Priest shore ca. 2 fjord. |“Where?” he asked Mr. Hallgrímr. |He saw MS. B. 216 realm.",
    "Hon kom 24. sept. 1485 hennar. |Pris 7.683 not.|Day came...  here.\n\n|15. Upphaf Steingrímr\n\n|Saga kom\nok fór",
    "far ring talte ø? |på mand sr. gunnvaldr kom. |„kirkja!“ sagði hann nú. |„kirkja!“ |hjem kom",
    "«Sinus invenit! |Niger altus!» inquit laetus. |«Ille qui... frater.» |«Quis?» |Mox i. e. dies.",
    "Ann bad: »Kom nu!« |Saa gik de bl.a. hjem. |»Red i ofte sort...« |»Nej,« sagde han.",
    "白色的找到。|“山谷？”他说道大海4.5里。|（马看见。）|“你好。”|看见……。",
    "山へ来た。|「来た？」と彼は見た4.1里だ。|「見た。」|母は聞いた",
    "जंगल आया । |द्वीप देखा? |रात गया।",
    "ᛅᛋ᛫ᛚᚱ᛭|ᚦᛅᛏ᛬ᛘ᛭",
    "ทะเลกับพ่อ |การเดินทาง 1003 ที่นั่น\nปลา",
    "Βίος νόμος; |Τότε ναῦς; κύων σ. 116 ποιητής. |«Στρατός;» |Νῦν.",
    "Мир т. е. дом. |Всё и т. д. и сон. |«Конь пришёл,» сказал он. |Лес к. |Мир?",
    "Vestis... |(Ut equus 6.212 mons?) |«Mors si? |Iter!» respondit rex.|Invenit d. Grímgeirr.",
    "Hann sá AM 233 fol. hringr þ. e. matr, f. Kr. lét.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    text, want, at = case.replace("|", ""), [], 0
    for part in case.split("|"):
        lead = len(part) - len(part.lstrip())
        want.append((at + lead, at + len(part.rstrip()) - 1))
        at += len(part)
    _, start, end = split_sentences([text])
    got = list(zip(start.tolist(), end.tolist()))
    assert [text[a : b + 1] for a, b in got] == [text[a : b + 1] for a, b in want]


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 5_000])
def test_prefix_scan_equals_one_long_run(n):
    symbols = np.random.default_rng(n).integers(0, len(SYMBOLS), n).astype(np.uint8)
    state, want = 0, []
    for s in symbols:
        want.append(ACTION[state, s])
        state = NEXT[state, s]
    for chunk in (7, 64, 512):
        assert run_transducer(symbols, chunk).tolist() == want


def test_long_text_in_chunks():
    unit = "Hann kom þar. Hon fór heim!\n\n"
    _, start, _ = split_sentences([unit * 20_000, None, "", " \n ", unit])
    assert len(start) == 40_002


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (4, "\n \n"), (1, "A b. C d."), (5, ".")], "text_id long, text string").selectExpr("*", "'x' as start_pos")
    got = sorted((r["text_id"], r["sentence"], r["start_pos"], r["end_pos"]) for r in sentences(df).collect())
    assert got == [(1, 0, 0, 3), (1, 0, 0, 3), (1, 1, 5, 8), (1, 1, 5, 8), (5, 0, 0, 0)]
    assert sentences(df.limit(0)).count() == 0


def test_spans_are_trimmed_and_ordered(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/clean_text.parquet")
    s = sentences(t).join(t.select("text_id", "text"), "text_id").selectExpr("*", "substring(text, start_pos + 1, end_pos - start_pos + 1) as s")
    assert s.where("s <> trim(s) or s = '' or length(s) <> end_pos - start_pos + 1").count() == 0
    assert SYM["RESET"] == 0


def test_texts_in_pieces_give_the_same(spark, sf_dir):
    """Pieces of a few hundred characters over many tasks against texts read whole."""
    t = spark.read.parquet(f"{sf_dir}/clean_text.parquet").select("text_id", "text")
    rows = t.where("length(text) > 0").limit(200).collect()
    joined = [(-i - 1, "\n\n".join(r["text"] for r in rows[i::4])) for i in range(4)] + [(-9, "orð " * 3_000), (-10, "ok " * 3_000), (-1, "x")]
    df = t.unionByName(spark.createDataFrame([*joined, joined[0]], "text_id long, text string")).cache()
    key = lambda f: sorted(tuple(r) for r in f.collect())
    want = key(sentences(df))
    assert key(sentences(df, long=300)) == want and len(want) > 800


def test_one_long_text(spark):
    unit = "Hann kom þar siðan aptr. Hon fór heim!\n\n"
    df = spark.createDataFrame([(1, unit * 20_000)], "text_id long, text string")
    got = sentences(df, long=50_000).agg({"sentence": "max", "end_pos": "max", "*": "count"}).first()
    assert sorted(got) == [39_999, 40_000, 20_000 * len(unit) - 3]
