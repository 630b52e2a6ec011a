"""Problem 1: one consistent form for text that looks the same.

The work is done by DuckDB inside the Arrow batches of each partition. Order: Unicode composition; invisible characters
out, spaces to the ordinary one; wide and ligated letters and digits to plain ones; in words that mix scripts, look-alike
letters to the script of the word; composition again. Manuscript letters, punctuation, quotes and dashes stay.
"""

from __future__ import annotations

import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Look-alike letters, one line per Latin letter: Latin, Cyrillic, Greek ('-' where there is none).
TWINS = """
A А Α|B В Β|C С Ϲ|E Е Ε|H Н Η|I І Ι|J Ј Ϳ|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y У Υ|Z - Ζ|V Ѵ -|Q Ԛ -|W Ԝ -
a а α|c с ϲ|e е -|h һ -|i і ι|j ј ϳ|k к κ|o о ο|p р ρ|s ѕ -|x х χ|y у γ|v ѵ ν|d ԁ -|q ԛ -|w ԝ -|u - υ
æ ӕ -|Æ Ӕ -|þ - ϸ|Þ - Ϸ
ä ӓ -|Ä Ӓ -|ë ё -|Ë Ё -|ï ї ϊ|Ï Ї Ϊ|ö ӧ -|Ö Ӧ -|ă ӑ -|Ă Ӑ -|ç ҫ -
á - ά|Á - Ά|É - Έ|í - ί|Í - Ί|ó - ό|Ó - Ό|ú - ύ|Ý - Ύ|ý ӳ -|Ḱ Ќ -|ḱ ќ -|è ѐ -|È Ѐ -|ў - -
"""
#: Letters drawn like another letter of the Latin script.
OWN_TWINS = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "Đ": "Ð", "Ɖ": "Ð", "ʜ": "h"}
#: Characters without a shape, and spaces other than U+0020.
INVISIBLE = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
SPACES = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Blocks with wide, narrow, ligated, enclosed and positional forms of letters and digits; their plain forms follow from
#: Unicode. Fractions (½) are not among them: their plain form is three characters that look otherwise.
COMPAT_BLOCKS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2100, 0x214F), (0x2160, 0x2188), (0x2460, 0x24FF), (0x3371, 0x33DF),
                 (0xFB00, 0xFB4F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFFDC), (0x1D400, 0x1D7FF), (0x1F130, 0x1F149))


def compat_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to, ligatures): single characters with a plain form of one character, and those with a longer one. Only
    forms of which the plain one is letters, digits and blanks inside count (so ⑴ and a lone positional mark do not)."""
    one: dict[str, str] = {}
    many: list[tuple[str, str]] = []
    for lo, hi in COMPAT_BLOCKS:
        for o in range(lo, hi + 1):
            c = chr(o)
            if o < 0x2150 and unicodedata.category(c)[0] not in "LN":
                continue  # signs such as № and ™ are no letters
            plain = "ſt" if o == 0xFB05 else unicodedata.normalize("NFKC", c)
            if plain in (c, unicodedata.normalize("NFC", c)) or plain.strip() != plain or not all(x == " " or unicodedata.category(x)[0] in "LMN" for x in plain):
                continue
            (many.append((c, plain)) if len(plain) > 1 else one.__setitem__(c, plain))
    return "".join(one), "".join(one.values()), many


def _twin_tables() -> dict[str, str]:
    rows = [x.split() for line in TWINS.split("\n") for x in line.split("|") if x.strip()]
    t = {"lat": "", "to_cyr": "", "lat_c": "", "cyr": "", "cyr_to": "", "grk": "", "grk_to": "", "lat_g": "", "to_grk": ""}
    for lat, cyr, grk in rows:
        if cyr != "-":
            t["cyr"] += cyr
            t["cyr_to"] += lat
            t["lat_c"] += lat
            t["to_cyr"] += cyr
        if grk != "-":
            t["grk"] += grk
            t["grk_to"] += lat
            t["lat_g"] += lat
            t["to_grk"] += grk
    return t


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(table: str = "batch") -> str:
    """SQL over a table (k, text) that gives (k, text, changed)."""
    one, to, _ = compat_tables()
    t = _twin_tables()
    plain = f"regexp_replace(regexp_replace(s0, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g')"
    compat_class = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in COMPAT_BLOCKS) + "]"
    # of the ligatures only those that a text holds are replaced in it
    held = "list_filter(getvariable('ligatures'), lambda p: contains(s1, p.c))"
    compat = f"list_reduce(list_prepend({{'c': translate(s1, {_q(one)}, {_q(to)}), 'p': ''}}, {held}), lambda x, p: {{'c': replace(x.c, p.c, p.p), 'p': ''}}).c"
    own = f"translate(w, {_q(''.join(OWN_TWINS))}, {_q(''.join(OWN_TWINS.values()))})"
    strict = {
        "lat": f"regexp_matches(translate(w, {_q(t['lat_c'] + t['lat_g'])}, ''), '\\p{{Latin}}')",
        "cyr": f"regexp_matches(translate(w, {_q(t['cyr'])}, ''), '\\p{{Cyrillic}}')",
        "grk": f"regexp_matches(translate(w, {_q(t['grk'])}, ''), '\\p{{Greek}}')",
    }
    to_latin = f"translate(w, {_q(t['cyr'] + t['grk'])}, {_q(t['cyr_to'] + t['grk_to'])})"
    to_cyr = f"translate({to_latin}, {_q(t['lat_c'])}, {_q(t['to_cyr'])})"
    to_grk = f"translate({to_latin}, {_q(t['lat_g'])}, {_q(t['to_grk'])})"
    mixed = "(regexp_matches(w, '\\p{Latin}')::INT + regexp_matches(w, '\\p{Cyrillic}')::INT + regexp_matches(w, '\\p{Greek}')::INT) > 1"
    word = f"""case when not {mixed} then {own}
        when not {strict['cyr']} and not {strict['grk']} then {own.replace('(w,', f'({to_latin},', 1)}
        when {strict['cyr']} and not {strict['lat']} and not {strict['grk']} then {to_cyr}
        when {strict['grk']} and not {strict['lat']} and not {strict['cyr']} then {to_grk}
        else w end"""
    gap = r"\p{M}*"
    touch = f"[\\p{{Latin}}]{gap}[\\p{{Cyrillic}}\\p{{Greek}}]|[\\p{{Cyrillic}}]{gap}[\\p{{Latin}}\\p{{Greek}}]|[\\p{{Greek}}]{gap}[\\p{{Latin}}\\p{{Cyrillic}}]|[{''.join(OWN_TWINS)}]"
    words = f"array_to_string(list_transform(regexp_extract_all(s2, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')"
    return f"""
        with a as (select k, text, nfc_normalize(text) as s0 from {table}),
        b as (select k, text, {plain} as s1 from a),
        c as (select k, text, case when regexp_matches(s1, '{compat_class}') then {compat} else s1 end as s2 from b),
        d as (select k, text, case when regexp_matches(s2, '{touch}') then {words} else s2 end as s3 from c),
        e as (select k, text, case when s3 = text then text else nfc_normalize(s3) end as s4 from d)
        select k, s4 as text, coalesce(s4 <> text, false) as changed from e order by k"""


def ligatures_sql() -> str:
    """The statement that gives a connection the table of forms with a longer plain form."""
    return "set variable ligatures = [" + ", ".join(f"{{'c': {_q(c)}, 'p': {_q(p)}}}" for c, p in compat_tables()[2]) + "]"


def canonical_text(df: DataFrame, text_col: str = "text", out_col: str = "canonical") -> DataFrame:
    """df with `out_col` (the text in its consistent form) and `changed` (whether it differs from the text).

    Null stays null and unchanged, empty stays empty. Applying it twice changes nothing more. Texts are taken whole
    whatever their length; repeated rows and other columns stay as they are, but columns named `out_col` or `changed` are
    replaced. No shuffle: one DuckDB connection per task works on the Arrow batches.
    """
    keep = [c for c in df.columns if c not in (out_col, "changed")]
    base = df.select(*keep)
    schema = base.select(*keep, F.lit("").alias(out_col), F.lit(True).alias("changed")).schema
    schema[out_col].nullable = True
    sql, ligatures, at = canonical_sql(), ligatures_sql(), keep.index(text_col)

    def run(batches):
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        con.execute(ligatures)
        for b in batches:
            part = pa.table({"k": pa.array(range(b.num_rows), pa.int64()), "text": b.column(at).cast(pa.string())})
            con.register("batch", part)
            got = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("batch")
            text = got.column("text").combine_chunks().cast(pa.string()) if b.num_rows else pa.array([], pa.string())
            changed = got.column("changed").combine_chunks() if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, text, changed], names=[*keep, out_col, "changed"])

    return base.mapInArrow(run, schema)
