"""Problem 6: tab-separated token lines, loaded with the lines that fail kept apart."""

from __future__ import annotations

import io
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, functions as F

NAMES = ("sent", "tok", "token", "label")
TYPES = ("Person", "Location", "Organization", "Miscellaneous", "Date", "Time", "Money", "Percent")
LABEL = "^(?:O|[BI]-(?:" + "|".join(TYPES) + "))$"
#: Every field bare or wholly enclosed in quotes.
SOUND_QUOTES = re.compile(r'(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*')
CONTROL = r"[\x00-\x08\x0A-\x1F\x7F-\x{9F}\x{FFFD}]"
#: The largest number that the columns sent and tok hold, in digits; fixed value.
LARGEST = "9223372036854775807"
COLUMNS = (*NAMES, "long_sent", "long_tok")
SCHEMA = "line_id long, file string, line_no int, sent long, tok long, token string, label string, long_sent string, long_tok string, reason string"


def _number(digits: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(the value if it fits 64 bits, else its digits) of strings of digits; the other of the two is null."""
    d = pc.utf8_ltrim(digits, "0")
    n = pc.utf8_length(d)
    fits = pc.or_kleene(pc.less(n, len(LARGEST)), pc.and_kleene(pc.equal(n, len(LARGEST)), pc.less_equal(d, LARGEST)))
    return pc.cast(pc.if_else(fits, d, None), pa.int64()), pc.if_else(fits, None, d)


def parse_lines(lines: list[str | None]) -> tuple[pa.Array, ...]:
    """(kept, sent, tok, token, label, long_sent, long_tok, reason) of lines; `kept` is false for empty lines and comments.

    Structural rejects come from the callback of the CSV reader for rows with a wrong number of fields; quotes that do
    not enclose a whole field, and line breaks inside a line, would make the reader join or cut lines, so those lines are
    told apart before. The fields of the other rows are read as text and cast as vectors.
    """
    n = len(lines)
    reason: list[str | None] = [None] * n
    kept = [True] * n
    todo: list[int] = []
    for i, x in enumerate(lines):
        if x is None:
            reason[i] = "null line"
            continue
        if x.endswith("\r"):
            x = lines[i] = x[:-1]
        if not x or x[0] == "#":
            kept[i] = False
        elif "\r" in x or "\n" in x or "\x00" in x:
            reason[i] = "control character"
        elif '"' in x and not SOUND_QUOTES.fullmatch(x):
            reason[i] = "broken quoting"
        else:
            todo.append(i)
    bad: list[int] = []

    def invalid(row) -> str:
        bad.append(row.number)
        reason[todo[row.number - 1]] = f"{'fewer' if row.actual_columns < row.expected_columns else 'more'} than 4 fields"
        return "skip"

    out = {c: [None] * n for c in COLUMNS}
    if todo:
        data = "\n".join(lines[i] for i in todo).encode("utf-8", "surrogatepass") + b"\n"
        t = csv.read_csv(
            io.BytesIO(data),
            read_options=csv.ReadOptions(column_names=list(NAMES), use_threads=False, block_size=max(1 << 20, len(data) + 1)),
            parse_options=csv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
            convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in NAMES}, strings_can_be_null=False, check_utf8=False),
        ).combine_chunks()
        skip = set(bad)
        at = [i for k, i in enumerate(todo, 1) if k not in skip]
        if t.num_rows != len(at):
            raise RuntimeError("rows and lines do not match")
        f = {c: t.column(c).combine_chunks() for c in NAMES}
        number = r"^0*[1-9][0-9]*$"
        faults = [
            ("sentence number is no whole number above 0", pc.invert(pc.match_substring_regex(f["sent"], number))),
            ("token number is no whole number above 0", pc.invert(pc.match_substring_regex(f["tok"], number))),
            ("empty token", pc.equal(f["token"], "")),
            ("control character", pc.match_substring_regex(f["token"], CONTROL)),
            ("unknown label", pc.invert(pc.match_substring_regex(f["label"], LABEL))),
        ]
        first = pa.nulls(t.num_rows, pa.string())
        for text, mask in reversed(faults):
            first = pc.if_else(mask, text, first)
        good = pc.is_null(first)
        (sent, long_sent), (tok, long_tok) = (_number(pc.if_else(good, f[c], None)) for c in ("sent", "tok"))
        cols = (sent, tok, pc.if_else(good, f["token"], None), pc.if_else(good, f["label"], None), long_sent, long_tok)
        for c, v in zip(COLUMNS, cols):
            for i, x in zip(at, v.to_pylist()):
                out[c][i] = x
        for i, x in zip(at, first.to_pylist()):
            if x is not None:
                reason[i] = x
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
    return (pa.array(kept, pa.bool_()), *(pa.array(out[c], k) for c, k in zip(COLUMNS, kinds)), pa.array(reason, pa.string()))


def load_lines(df: DataFrame) -> DataFrame:
    """Every data line of df(line_id, file, line_no, line) parsed; `reason` is null for the sound ones.

    Empty lines and comments give no row. A null line fails. Line numbers may repeat, they are not used. A lines of any
    length is read whole. Numbers may have any number of digits: one beyond 64 bits is sound, its column is null and its
    digits, without leading zeros, are in long_sent or long_tok. No shuffle; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            kept, *cols = parse_lines(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["line_id", "file", "line_no", *COLUMNS, "reason"]).filter(kept)

    one = df.select(F.col("line_id").cast("long"), F.col("file").cast("string"), F.col("line_no").cast("int"), F.col("line").cast("string"))
    return one.mapInArrow(run, SCHEMA)


def sound_rows(df: DataFrame) -> DataFrame:
    return load_lines(df).where("reason is null").drop("reason")


def failed_lines(df: DataFrame) -> DataFrame:
    return load_lines(df).where("reason is not null").select("line_id", "file", "line_no", "reason")
