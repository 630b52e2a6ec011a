"""SQL that DuckDB runs against the queries of this subpackage, where SQL can express them at whole-table size."""

from __future__ import annotations

#: Fixed values, stated here again so that the SQL does not follow the operator's own tables.
INVISIBLE = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
SPACES = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
OWN_TWINS = "ɑɡɩĐƉʜ"
_WIDE = (r"[\x{132}\x{133}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{2102}\x{2107}\x{210A}-\x{2113}\x{2115}\x{2119}-\x{211D}\x{2124}\x{2128}\x{212C}\x{212D}\x{212F}-\x{2131}\x{2133}-\x{2139}\x{213C}-\x{213F}\x{2145}-\x{2149}"
         r"\x{2160}-\x{217F}\x{2460}-\x{2473}\x{24B6}-\x{24EA}\x{3371}-\x{33A6}\x{33A9}-\x{33AD}\x{33B0}-\x{33C1}\x{33C3}-\x{33C5}\x{33C8}-\x{33D7}\x{33D9}-\x{33DD}"
         r"\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{FB20}-\x{FB28}\x{FB4F}-\x{FBB1}\x{FBD3}-\x{FC5D}\x{FC64}-\x{FD3D}\x{FD50}-\x{FD8F}\x{FD92}-\x{FDC7}\x{FDF0}-\x{FDFC}\x{FE71}\x{FE77}\x{FE79}\x{FE7B}\x{FE7D}\x{FE7F}-\x{FEFC}"
         r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FFBE}\x{FFC2}-\x{FFC7}\x{FFCA}-\x{FFCF}\x{FFD2}-\x{FFD7}\x{FFDA}-\x{FFDC}\x{1D400}-\x{1D7CB}\x{1D7CE}-\x{1D7FF}\x{1F130}-\x{1F149}]")
_OFF = r"[\p{M}\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]*"
_MIXED = f"\\p{{Latin}}{_OFF}[\\p{{Cyrillic}}\\p{{Greek}}]|\\p{{Cyrillic}}{_OFF}[\\p{{Latin}}\\p{{Greek}}]|\\p{{Greek}}{_OFF}[\\p{{Latin}}\\p{{Cyrillic}}]|[{OWN_TWINS}]"

_CASE = f"(nfc_normalize(t) <> t or regexp_matches(t, '{INVISIBLE}|{SPACES}|{_WIDE}|{_MIXED}'))"

_WANTED = "greatest(coalesce(min_rows, 0), cast(floor(round(coalesce(target_share, 0) * coalesce(sample_rows, 0), 6) + 0.5) as bigint))"
_HAVE = "(select label, count(*) as n from (select distinct label, file, ord from entities where label is not null) group by label)"

_QUOTAS = f"""
    t as (select plan_id, t.label, target_share, min_rows, sample_rows, {_WANTED} as wanted, coalesce(n, 0) as available, greatest(0, round(coalesce(target_share, 0) * coalesce(sample_rows, 0), 6)) as ideal
        from label_targets t left join {_HAVE} h on t.label = h.label),
    b as (select *, cast(greatest(coalesce(min_rows, 0), floor(ideal)) as bigint) as base from t),
    s as (select *, least(coalesce(sample_rows, 0), cast(floor(sum(ideal) over p + 0.5) as bigint)) - sum(base) over p as spare, ideal > floor(ideal) and base = floor(ideal) and base < available as may
        from b window p as (partition by plan_id, sample_rows)),
    r as (select *, row_number() over (partition by plan_id, sample_rows order by may desc, ideal - floor(ideal) desc, label) as place from s),
    quotas as (select *, cast(least(available, base + case when may and place <= spare then 1 else 0 end) as bigint) as quota from r)"""

_EDGES = """
    own as (select distinct source as node, 's' || chr(31) || source as key from conll_tokens where source is not null),
    editors as (select o.node, 'e' || chr(31) || w.main_editor as key from works w join own o on o.node = w.source
        where w.main_editor is not null and w.main_editor not in ('', 'null', 'N. N.')),
    places as (select sent_id, tok_id, min(source) as source, min(token) as token, min(label) as label from conll_tokens
        where source is not null and sent_id is not null group by sent_id, tok_id),
    islands as (select *, sum(case when label = 'I-Person' then 0 else 1 end) over (partition by sent_id order by tok_id) as island from places),
    names as (select distinct min(source) as node, 'p' || chr(31) || string_agg(token, chr(31) order by tok_id) as key
        from islands where label in ('B-Person', 'I-Person') group by sent_id, island
        having count(*) >= 3 and count(token) = count(*) and max(case when label = 'B-Person' then 1 else 0 end) = 1),
    edges as (select * from own union select * from editors union select * from names),
    ties as (select distinct a.node as x, b.node as y from edges a join edges b on a.key = b.key and a.node <> b.node),
    reach as (select x, y from ties union select r.x, t.y from reach r join ties t on r.y = t.x)
"""

ORACLES = {
    "p1_found": f"""
        select 'entities' as tab, ent_id as row_id from (select ent_id, dipl_text as t from entities) where {_CASE}
        union all select 'documents', doc_id from (select doc_id, text as t from documents) where {_CASE}""",
    "p3_found": f"""
        select plan_id, t.label from label_targets t left join {_HAVE} h on t.label = h.label where {_WANTED} > coalesce(n, 0)""",
    "p3_report": f"with {_QUOTAS} select plan_id, label, target_share, min_rows, sample_rows, wanted, available, greatest(0, wanted - available) as missing, quota from quotas",
    "p3_sample_counts": f"with {_QUOTAS} select plan_id, label, max(quota) as drawn from quotas where quota > 0 and label is not null and plan_id is not null group by all",
    "p9_invariants": """select plan_id, (select count(distinct doc_id) from documents) as documents, cast(0 as bigint) as too_full, cast(0 as bigint) as broken
        from pack_plans where plan_id is not null and capacity > 0 and tokenizer is not null""",
    "p7_found": f"with recursive {_EDGES} select x as source_a, y as source_b from reach where x < y",
}
