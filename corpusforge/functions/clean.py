"""Cleaning of text columns (Column -> Column), all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusforge.functions.chars import NOT_WS, PUNCT_LEAD, PUNCT_TRAIL, WS, WS_LINE


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip_blank(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return _sub(c, f"^{WS}+|{WS}+$", "")


def unix_newlines(c: Column) -> Column:
    return _sub(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def _join(a: Column) -> Column:
    return F.array_join(a, "\n")


def strip_line_numbers(c: Column) -> Column:
    """Without the number and signs that lead a line, and without square brackets. A line that holds a number only is
    joined to the next, as its line end goes with the number."""
    return _sub(_sub(c, rf"(?md)^\p{{Nd}}+[^\p{{L}}\p{{N}}_\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]*{WS_LINE}*\n?", ""), r"[\[\]]", "")


def remove_braces(c: Column) -> Column:
    """Without {...}; blanks squeezed in each line, empty lines dropped."""
    squeezed = F.transform(lines(c), lambda x: strip_blank(_sub(_sub(strip_blank(x), r"\{[^}]*\}", ""), f"{WS}+", " ")))
    return _join(F.filter(squeezed, lambda x: x != ""))


def join_broken_words(c: Column, mark: str = "-") -> Column:
    """Words broken by `mark` joined, with a line break after them; lines without leading blanks, blank lines dropped."""
    m = "\\" + mark if mark in "-]^\\" else mark
    part = rf"([^\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}{m}]+)"
    joined = _sub(c, f"{part}{m}{WS}*{part}{WS}*", "$1$2\n")
    left = F.transform(lines(joined), lambda x: _sub(x, f"^{WS}+", ""))
    return _join(F.filter(left, lambda x: x != ""))


def remove_dot_below(c: Column) -> Column:
    """Without U+0323, the mark of unclear readings; composed letters stay."""
    return F.replace(c, F.lit("̣"))


def space_punctuation(c: Column) -> Column:
    """Punctuation set off by blanks, one sentence a line; a closing quote stays with its sentence."""
    p = r"[.,:;!?…―\-–—]"
    t = _sub(c, f"{WS}+", " ")
    t = _sub(t, f"({NOT_WS})({p})", "$1 $2")
    t = _sub(t, f"({p})({NOT_WS})", "$1 $2")
    t = _sub(t, r'([.!?…]) " ', '$1 "\n')
    t = _sub(t, r'([.!?…]) (?!")', "$1\n")
    return strip_blank(_sub(_sub(t, " +", " "), "\n ", "\n"))


#: Named entities in the order in which they are replaced; fixed values.
ENTITIES = (("&horbar;", "-"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'))


def plain_markup(c: Column) -> Column:
    """Without tags; blanks squeezed; named entities resolved, other entities dropped."""
    t = strip_blank(_sub(_sub(c, "<[^>]+>", ""), f"{WS}+", " "))
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip_blank(_sub(t, "&[a-zA-Z0-9#]+;", ""))


def tei_running_text(c: Column) -> Column:
    """Running text of the diplomatic readings in the body of a TEI file; an empty string where there is no body."""
    body = F.lit("")
    for tag in ("tei:body", "body"):
        found = F.regexp_extract(c, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        body = F.when(found != "", found).otherwise(body)
    body = _sub(body, r"<me:dipl\s*/>", "")
    words = F.transform(F.regexp_extract_all(body, F.lit("(?s)<me:dipl[^>]*>(.*?)</me:dipl>"), F.lit(1)), plain_markup)
    return space_punctuation(F.array_join(F.filter(words, lambda w: w != ""), " "))


def comparison_key(c: Column) -> Column:
    """Lower case, blanks squeezed: equal keys, equal sentences."""
    return strip_blank(_sub(F.lower(c), f"{WS}+", " "))


def markup_key(c: Column) -> Column:
    """Lower case without tags, blanks squeezed but line breaks kept."""
    return F.lower(strip_blank(_sub(_sub(c, "<[^>]+>", ""), f"{WS_LINE}+", " ")))


def one_line(c: Column) -> Column:
    """Line breaks as blanks; positions stay valid."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read rightly; anything else unchanged."""
    raw = F.encode(F.when(c.rlike(r"^[\x00-\x{ff}]*$"), c).otherwise(F.lit("")), "ISO-8859-1")
    good = c.rlike(r"^[\x00-\x{ff}]*$") & F.is_valid_utf8(raw.cast("string"))
    return F.when(good, F.decode(raw, "UTF-8")).otherwise(c)


#: Short and long names of entity types; fixed values.
LABELS = {"PER": "Person", "LOC": "Location", "ORG": "Organization", "MISC": "Miscellaneous"}


def long_label(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.upper(c)), c)


def code_point(c: Column) -> Column:
    """Hexadecimal number of a character, four digits or more."""
    h = F.hex(F.ascii(c))
    return F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h)


def visible_blanks(c: Column, most: int = 100) -> Column:
    """For people: blanks drawn as signs, other invisible characters as \\uXXXX; longer than `most` it ends in three dots."""
    signs = F.transform(F.split(F.translate(c, " \t\n", "␣⇥⏎"), ""), lambda x: F.when(x.rlike(r"\p{C}"), F.concat(F.lit("\\u"), F.lower(code_point(x)))).otherwise(x))
    text = F.array_join(signs, "")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def peel_tokens(c: Column) -> Column:
    """Tokens of a sentence: chunks between blanks with the punctuation at their ends set apart."""
    chunks = F.filter(F.split(c, f"{WS}+"), lambda x: x != "")
    shape = f"^({PUNCT_LEAD}*)(.*?)({PUNCT_TRAIL}*)$"
    one = lambda x, k: F.regexp_extract(x, "(?s)" + shape, k)
    signs = lambda s: F.filter(F.split(s, ""), lambda y: y != "")
    return F.flatten(F.transform(chunks, lambda x: F.concat(signs(one(x, 1)), F.filter(F.array(one(x, 2)), lambda y: y != ""), signs(one(x, 3)))))


def sentence_lines(c: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(c, "\n+"), strip_blank), lambda x: x != "")
