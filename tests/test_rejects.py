"""Problem 6: parsed rows and failing lines, against a reader written character by character."""

import random

import pytest

from corpusforge.sources import tsv_rejects
from corpusforge.sources.tsv_rejects import TYPES, parse_lines


def fields(line):
    """Fields of a line, or None if quotes are broken."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            cell = line[i : j if j >= 0 else len(line)]
            if '"' in cell:
                return None
            i = j if j >= 0 else len(line)
        out.append(cell)
        if i >= len(line):
            return out
        i += 1


def sound(line):
    """None if the line gives no row, else whether it is sound."""
    if line is None:
        return False
    line = line[:-1] if line.endswith("\r") else line
    if not line or line[0] == "#":
        return None
    f = fields(line)
    if f is None or len(f) != 4:
        return False
    whole = all(x and all(c in "0123456789" for c in x) and int(x) > 0 for x in f[:2])
    ok = f[2] != "" and not any(ord(c) < 32 and c != "\t" or 127 <= ord(c) <= 159 or c == "�" for c in f[2])
    return whole and ok and (f[3] == "O" or f[3][:2] in ("B-", "I-") and f[3][2:] in TYPES)


def test_random_lines():
    rng = random.Random(5)
    parts = ["1", "2", "0", "x", "", '"', '""', "\t", "\t", "\t", "O", "B-Person", "tok", "þ", "\r", "\x85", "�", "#", " ", "\x00", "I-Date", '"a\tb"', '"1"', "\n", "99999999999999999999", "9223372036854775807", "9223372036854775808", "00000000000000000000000012"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    lines += ["\t".join(rng.choice(parts) for _ in range(4)) for _ in range(20_000)] + [f'1\t2\t{rng.choice(parts)}\tO' for _ in range(2_000)] + [None, "1\t2\ttok\tO", "007\t1\tx\tO"]
    kept, sent, tok, token, label, long_sent, long_tok, reason = [x.to_pylist() for x in parse_lines(list(lines))]
    for i, line in enumerate(lines):
        want = sound(line)
        assert kept[i] == (want is not None), line
        if want is not None:
            assert (reason[i] is None) == want, (line, reason[i])
            if want:
                f = fields(line[:-1] if line.endswith("\r") else line)
                number = [x if x is not None else int(y) for x, y in ((sent[i], long_sent[i]), (tok[i], long_tok[i]))]
                assert (*number, token[i], label[i]) == (int(f[0]), int(f[1]), f[2], f[3])


def test_reasons():
    lines = ["1\t2\tx", "1\t2\tx\tO\ty", '1\t2\t"x\tO', "0\t1\tx\tO", "1\t-1\tx\tO", '1\t1\t""\tO', "1\t1\tx\x07\tO", "1\t1\tx\tB-Ship", None, "x\ry"]
    want = ["fewer than 4 fields", "more than 4 fields", "broken quoting", "sentence number is no whole number above 0", "token number is no whole number above 0", "empty token", "control character", "unknown label", "null line", "control character"]
    assert parse_lines(lines)[7].to_pylist() == want


def test_numbers_of_any_length():
    _, sent, tok, _, _, long_sent, long_tok, reason = [x.to_pylist() for x in parse_lines(["9223372036854775807\t9223372036854775808\tx\tO", "00" * 20 + "7\t1" + "0" * 60 + "\tx\tO"])]
    assert reason == [None, None] and sent == [2**63 - 1, 7] and long_sent == [None, None] and tok == [None, None] and long_tok == [str(2**63), "1" + "0" * 60]


def test_table(spark):
    long = "1\t1\t" + "a" * 300_000 + "\tO"
    rows = [(1, "f", 1, "1\t1\tx\tO", "clash"), (1, "f", 1, "1\t1\tx\tO", "clash"), (2, None, None, None, ""), (3, "f", 3, "", ""), (4, "f", 4, "# c", ""), (5, "f", 5, long, "")]
    df = spark.createDataFrame(rows, "line_id long, file string, line_no int, line string, token string")
    assert sorted(r["line_id"] for r in tsv_rejects.failed_lines(df).collect()) == [2]
    assert sorted(len(r["token"]) for r in tsv_rejects.sound_rows(df).collect()) == [1, 1, 300_000]
    assert tsv_rejects.load_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ['1\t1\t"a ""b"""\tO', '"1"\t1\t""""\t"O"'])
def test_quotes(text):
    assert parse_lines([text])[7].to_pylist() == [None]
