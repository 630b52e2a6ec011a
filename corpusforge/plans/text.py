"""Queries of the text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusforge.functions import clean, unicode_fns
from corpusforge.functions.chars import NOT_WS, PUNCT_LEAD, PUNCT_TRAIL, WORD_PATTERN, WS, WS_LINE
from corpusforge.operators import qa, spans, stats
from corpusforge.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    """SQL that replaces all matches; line ends are written with chr so that both engines see the same."""
    return f"regexp_replace({x}, {q(pattern)}, {to if to.startswith('chr') or '||' in to else q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


NL = "chr(10)"
UNIX = sub("text", "\\r\\n?", NL)


def _lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def _docs(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id"):
    t = table(spark, d, name).select(key, "text")
    return t.withColumn("text", clean.unix_newlines(F.col("text")))


def _map(spark, d, f, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return _docs(spark, d, name, key).select(key, f(F.col("text")).alias("text"))


@query(f"select text_id, {sub(sub(UNIX, rf'(?m)^\p{{Nd}}+[^\p{{L}}\p{{N}}_\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]*{WS_LINE}*\n?', ''), r'[\[\]]', '')} as text from clean_text")
def clean_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, clean.strip_line_numbers, "clean_text", "text_id")


_BRACED = f"replace(replace({UNIX}, '(', '{{'), ')', '}}')"


@query(f"select doc_id, array_to_string(list_filter(list_transform({_lines(_BRACED)}, lambda x: {strip(sub(sub(strip('x'), r'\{[^}]*\}', ''), f'{WS}+', ' '))}), lambda x: x <> ''), {NL}) as text from documents")
def clean_braces(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, lambda c: clean.remove_braces(F.replace(F.replace(c, F.lit("("), F.lit("{")), F.lit(")"), F.lit("}"))))


def _joined(x: str, mark: str) -> str:
    m = "\\" + mark if mark == "-" else mark
    part = rf"([^\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}{m}]+)"
    joined = f"regexp_replace({x}, {q(f'{part}{m}{WS}*{part}{WS}*')}, '\\1\\2' || {NL}, 'g')"
    return f"array_to_string(list_filter(list_transform({_lines(joined)}, lambda x: {sub('x', f'^{WS}+', '')}), lambda x: x <> ''), {NL})"


@query(f"select text_id, {_joined(UNIX, '-')} as text from clean_text")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, clean.join_broken_words, "clean_text", "text_id")


@query(f"select doc_id, {_joined(f'''replace({UNIX}, ', ', '· ')''', '·')} as text from documents")
def dehyphenate_dot(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, lambda c: clean.join_broken_words(F.replace(c, F.lit(", "), F.lit("· ")), "·"))


@query("select doc_id, text from documents")
def strip_dot_below(spark: SparkSession, d: str) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("u"), F.lit("ụ"))
    return table(spark, d, "documents").select("doc_id", clean.remove_dot_below(marked).alias("text"))


_P = r"[.,:;!?…―\-–—]"


def _spaced(x: str) -> str:
    t = sub(x, f"{WS}+", " ")
    t = sub(t, f"({NOT_WS})({_P})", r"\1 \2")
    t = sub(t, f"({_P})({NOT_WS})", r"\1 \2")
    t = f"regexp_replace({t}, '([.!?…]) \" ', '\\1 \"' || {NL}, 'g')"
    t = f"regexp_replace({t}, '([.!?…]) ', '\\1' || {NL}, 'g')"
    t = f"regexp_replace({t}, '([.!?…])' || {NL} || '\"', '\\1 \"', 'g')"
    return strip(f"regexp_replace({sub(t, ' +', ' ')}, {NL} || ' ', {NL}, 'g')")


@query(f"select doc_id, {_spaced(UNIX)} as text from documents")
def punct_spacing_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d, clean.space_punctuation)


@query("select doc_id, nfc_normalize(text) as text from documents")
def nfc_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", unicode_fns.nfc(F.col("text")).alias("text"))


@query()
def nfkc_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", unicode_fns.nfkc_key(F.col("text")).alias("text"))


@query("select doc_id, text from documents")
def mojibake_repaired(spark: SparkSession, d: str) -> DataFrame:
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", clean.repair_mojibake(broken).alias("text"))


@query(f"select doc_id, {strip(sub('lower(text)', f'{WS}+', ' '))} as text from documents")
def comparison_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean.comparison_key(F.col("text")).alias("text"))


_MARKUP = f"lower({strip(sub(sub('text', '<[^>]+>', ''), f'{WS_LINE}+', ' '))})"


@query(f"select doc_id, {_MARKUP} as text from documents")
def markup_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean.markup_key(F.col("text")).alias("text"))


def _plain(x: str) -> str:
    t = strip(sub(sub(x, "<[^>]+>", ""), f"{WS}+", " "))
    for name, char in clean.ENTITIES:
        t = f"replace({t}, {q(name)}, {q(char)})"
    return strip(sub(t, "&[a-zA-Z0-9#]+;", ""))


@query(f"select doc_id, {_plain('text')} as text, replace(text, {NL}, ' ') as line from documents")
def markup_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean.plain_markup(F.col("text")).alias("text"), clean.one_line(F.col("text")).alias("line"))


_CHUNK = f"(?s)^({PUNCT_LEAD}*)(.*?)({PUNCT_TRAIL}*)$"
_TOKENS = f"""
    lines as (select doc_id, {strip("unnest(string_split_regex(" + UNIX + ", '\\n+'))")} as l from documents),
    chunks as (select doc_id, unnest(list_filter(string_split_regex(l, {q(f'{WS}+')}), lambda x: x <> '')) as c from lines where l <> ''),
    toks as (select doc_id, unnest(list_concat(list_concat(
        list_filter(string_split(regexp_extract(c, {q(_CHUNK)}, 1), ''), lambda x: x <> ''), list_filter([regexp_extract(c, {q(_CHUNK)}, 2)], lambda x: x <> '')),
        list_filter(string_split(regexp_extract(c, {q(_CHUNK)}, 3), ''), lambda x: x <> ''))) as token from chunks)"""


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, token) of all documents."""
    lines = _docs(spark, d).select("doc_id", F.explode(clean.sentence_lines(F.col("text"))).alias("l"))
    return lines.select("doc_id", F.explode(clean.peel_tokens(F.col("l"))).alias("token"))


@query(f"with {_TOKENS} select token, count(*) as n, count(distinct doc_id) as documents from toks group by token")
def tokens_peeled(spark: SparkSession, d: str) -> DataFrame:
    per = doc_tokens(spark, d).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("documents"))


@query(f"with {_TOKENS} select token, count(*) as n from toks group by token order by n desc, token limit 50")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return doc_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(f"select doc_id, len(regexp_extract_all(text, {q(WORD_PATTERN)})) as words from documents where text is not null")
def word_count_regex(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", spans.count_words(F.col("text")).cast("long").alias("words"))


_PLACED = f"""a as (select doc_id, regexp_extract_all(text, {q(WORD_PATTERN)}) as w, string_split_regex(text, {q(WORD_PATTERN)}) as s from documents where text is not null),
    b as (select doc_id, unnest(w) as word, unnest(s[1:len(w)]) as gap, generate_subscripts(w, 1) as k from a where len(w) > 0),
    words as (select doc_id, k - 1 as pos, word, sum(length(gap) + length(word)) over (partition by doc_id order by k) - length(word) as start from b)"""


@query(f"""with {_PLACED} select doc_id, cast(pos as integer) as pos, word, cast(start as integer) as start, cast(start + length(word) - 1 as integer) as "end" from words""")
def word_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.word_spans(table(spark, d, "documents"), "doc_id", "text")


@query(f"select doc_id, len(w) as words, cast(list_sum(list_transform(w, lambda x: length(x))) as bigint) as chars from (select doc_id, regexp_extract_all(text, {q(WORD_PATTERN)}) as w from documents where text is not null) where len(w) > 0")
def word_span_totals(spark: SparkSession, d: str) -> DataFrame:
    w = spans.word_spans(table(spark, d, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum(F.col("end") - F.col("start") + 1).alias("chars"))


@query(f"""with {_PLACED} select x.doc_id, word from (select * from words where pos % 7 = 3) x join documents d on x.doc_id = d.doc_id where substr(d.text, cast(start + 2 as integer), length(word)) <> word""")
def span_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh word is moved by one, so that the check has something to find."""
    t = table(spark, d, "documents")
    moved = F.when(F.col("pos") % 7 == 3, 1).otherwise(0)
    words = spans.word_spans(t, "doc_id", "text").withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved})
    return spans.verify_spans(words, t, "doc_id", "text").select("doc_id", "word")


@query(f"""with a as (select doc_id, unnest(regexp_extract_all(text, {q(WORD_PATTERN)})) as word, generate_subscripts(regexp_extract_all(text, {q(WORD_PATTERN)}), 1) as pos from documents),
    b as (select doc_id, unnest(regexp_extract_all(text, {q(NOT_WS + '+')})) as expected, generate_subscripts(regexp_extract_all(text, {q(NOT_WS + '+')}), 1) as pos from documents)
    select doc_id, cast(pos - 1 as integer) as pos, word, expected from a full outer join b using (doc_id, pos) where word is distinct from expected""")
def boundary_verify(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return spans.boundary_differences(spans.word_spans(t, "doc_id", "text"), t, "doc_id", "text")


_BAD = r"[\x{FFFD}\p{C}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


@query(f"""with l as (select doc_id, unnest({_lines('text')}) as t, generate_subscripts({_lines('text')}, 1) as line from documents),
    c as (select doc_id, line, t, unnest(string_split(t, '')) as char, generate_subscripts(string_split(t, ''), 1) as position from l where regexp_matches(t, '{_BAD}'))
    select doc_id, cast(line as integer) as line, cast(position as integer) as position, char, 'U+' || lpad(to_hex(unicode(char)), cast(greatest(4, length(to_hex(unicode(char)))) as integer), '0') as code,
        case when regexp_matches(char, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'control character' when char = chr(65533) then 'replacement character'
            when regexp_matches(char, '[\\x{{E000}}-\\x{{F8FF}}]') then 'private use character' else 'non-printable character' end as category,
        substr(t, greatest(0, position - 21) + 1, position - 1 + 20 - greatest(0, position - 21)) as context
    from c where regexp_matches(char, '{_BAD}')""")
def invalid_chars(spark: SparkSession, d: str) -> DataFrame:
    return qa.invalid_characters(table(spark, d, "documents"), "doc_id")


@query("""select source, count(*) as texts, cast(sum(length(text)) as bigint) as chars, cast(sum(len(regexp_extract_all(text, """ + q(WORD_PATTERN) + """))) as bigint) as words from documents group by source""")
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.text_metrics(table(spark, d, "documents"), ["source"])


@query(f"""with a as (select doc_id, source, text, {strip(sub('text', f'{WS}+', ' '))} as k from documents)
    select source, cast(sum(length(text)) as bigint) as before, cast(sum(length(k)) as bigint) as after, round(100.0 * sum(length(k)) / sum(length(text)), 4) as kept_percent from a group by source""")
def keep_percent(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("k", clean.strip_blank(F.regexp_replace("text", F.lit(f"{WS}+"), F.lit(" "))))
    return t.groupBy("source").agg(F.sum(F.length("text")).alias("before"), F.sum(F.length("k")).alias("after"), F.round(100.0 * F.sum(F.length("k")) / F.sum(F.length("text")), 4).alias("kept_percent"))


_VISIBLE = f"array_to_string(list_transform(string_split(translate(text, ' ' || chr(9) || {NL}, '␣⇥⏎'), ''), lambda x: case when regexp_matches(x, '\\p{{C}}') then '\\u' || lpad(lower(to_hex(unicode(x))), cast(greatest(4, length(to_hex(unicode(x)))) as integer), '0') else x end), '')"


@query(f"select doc_id, case when length(v) > 100 then left(v, 100) || '...' else v end as shown from (select doc_id, {_VISIBLE} as v from documents)")
def visible_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean.visible_blanks(F.col("text")).alias("shown"))


@query(f"select doc_id, line from (select doc_id, unnest({_lines('text')}) as t, cast(generate_subscripts({_lines('text')}, 1) - 1 as integer) as line from documents) where regexp_matches(t, '^{WS}')")
def leading_blanks(spark: SparkSession, d: str) -> DataFrame:
    return qa.leading_blanks(table(spark, d, "documents"), "doc_id")


@query("select md5(text) as digest, count(*) as n, min(doc_id) as first_row, max(doc_id) as last_row from documents group by 1 having count(*) > 1")
def dup_texts(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated(table(spark, d, "documents").select(F.md5("text").alias("digest"), "doc_id"), ["digest"], "doc_id")


@query("select digest, doc_id, n from (select md5(text) as digest, doc_id, count(*) over (partition by md5(text)) as n from documents) where n > 1")
def dup_texts_rows(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated_rows(table(spark, d, "documents").select(F.md5("text").alias("digest"), "doc_id"), ["digest"])



@query("select 'documents' as origin, count(*) as n, count(text) as texts from documents union all select 'clean_text', count(*), count(text) from clean_text union all select 'abuse_review', count(*), count(text) from abuse_review")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    from corpusforge.sources.files import union_sources as union

    parts = [table(spark, d, n).select(F.lit(n).alias("origin"), "text", F.lit(1).alias(f"from_{n}")) for n in ("documents", "clean_text", "abuse_review")]
    return union(*parts).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"))
