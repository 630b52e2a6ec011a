"""Problem 6: lines of token files that cannot be loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusforge.runtime import table
from corpusforge.sources import tsv_rejects


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return tsv_rejects.failed_lines(table(spark, d, "raw_lines")).select("line_id")


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    return tsv_rejects.sound_rows(table(spark, d, "raw_lines"))


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Failed lines per kind of fault that SQL can tell: a null line, a wrong number of fields, anything else."""
    r = tsv_rejects.failed_lines(table(spark, d, "raw_lines"))
    kind = F.when(F.col("reason") == "null line", "null").when(F.col("reason").endswith("4 fields"), "fields").otherwise("other")
    return r.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def p6_rejects(spark: SparkSession, d: str) -> DataFrame:
    return tsv_rejects.failed_lines(table(spark, d, "raw_lines"))


QUERIES = {f.__name__: f for f in (p6_found, p6_rows, p6_rejects, p6_reasons)}

_FIELD = r'("([^"]|"")*"|[^"\t\n\r]*)'
_NUMBER = r'("0*[1-9][0-9]*"|0*[1-9][0-9]*)'
_TOKEN = r'("([^"\x00-\x08\x0A-\x1F\x7F-\x{9F}\x{FFFD}]|"")+"|[^"\x00-\x1F\x7F-\x{9F}\x{FFFD}]+)'
_LABEL = r"(O|[BI]-(Person|Location|Organization|Miscellaneous|Date|Time|Money|Percent))"
_SOUND = rf'^{_NUMBER}\t{_NUMBER}\t{_TOKEN}\t({_LABEL}|"{_LABEL}")$'
_WHOLE = f"regexp_matches(l, '^{_FIELD}(\\t{_FIELD})*$')"
_LINES = r"(select *, case when ends_with(line, chr(13)) then substr(line, 1, length(line) - 1) else line end as l from raw_lines)"
_DATA = "(l is null or (l <> '' and l[1] <> '#'))"


def _cell(k: int) -> str:
    raw = f"regexp_extract(l, '^{_FIELD}\\t{_FIELD}\\t{_FIELD}\\t{_FIELD}$', {2 * k - 1})"
    return f"case when {raw} like '\"%' then replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') else {raw} end"


def _int(k: int) -> str:
    return f"try_cast({_cell(k)} as bigint)"


def _long(k: int) -> str:
    return f"case when {_int(k)} is null then ltrim({_cell(k)}, '0') end"


ORACLES = {
    "p6_found": f"select line_id from {_LINES} where {_DATA} and (l is null or not regexp_matches(l, '{_SOUND}'))",
    "p6_reasons": f"""select case when l is null then 'null' when {_WHOLE} and not regexp_matches(l, '^{_FIELD}\\t{_FIELD}\\t{_FIELD}\\t{_FIELD}$') then 'fields' else 'other' end as kind, count(*) as n
        from {_LINES} where {_DATA} and (l is null or not regexp_matches(l, '{_SOUND}')) group by 1""",
    "p6_rows": f"""select line_id, file, line_no, {_int(1)} as sent, {_int(2)} as tok, {_cell(3)} as token, {_cell(4)} as label, {_long(1)} as long_sent, {_long(2)} as long_tok
        from {_LINES} where {_DATA} and regexp_matches(l, '{_SOUND}')""",
}
