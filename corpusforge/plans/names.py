"""Queries over entity tables, spans, alignment and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusforge.functions import clean, similarity
from corpusforge.functions.chars import WS_LINE
from corpusforge.operators import align, cluster, entities, extract, qa, spans, stats
from corpusforge.plans.text import _plain, _spaced, strip, sub
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


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("ent_id", "file", "ord", "dipl_text", "norm_text", "label", "subtype", "source")


@query("select ent_id, norm_text, label, subtype from entities")
def entity_project_norm(spark: SparkSession, d: str) -> DataFrame:
    return entities.keep_form(_e(spark, d), "norm_text").drop("file", "ord", "source")


@query("select ent_id, dipl_text, label from entities")
def entity_project_dipl(spark: SparkSession, d: str) -> DataFrame:
    return entities.drop_subtype(entities.keep_form(_e(spark, d), "dipl_text")).drop("file", "ord", "source")


@query("select ent_id, label, subtype from entities where subtype is null or subtype not in ('ROL', 'NIC')")
def subtype_filter(spark: SparkSession, d: str) -> DataFrame:
    return entities.without_subtypes(_e(spark, d)).select("ent_id", "label", "subtype")


_SPLIT = "select *, case when coalesce(label, '') = '' then 'PER' else label end as l0 from entities"


@query(f"""select ent_id, string_split(l0, '-')[1] as label, case when contains(l0, '-') then substr(l0, instr(l0, '-') + 1) else subtype end as subtype from ({_SPLIT})""")
def label_fill_split(spark: SparkSession, d: str) -> DataFrame:
    return entities.split_label(_e(spark, d)).select("ent_id", "label", "subtype")


@query(f"""with x as (select ent_id, string_split(l0, '-')[1] as l, case when contains(l0, '-') then substr(l0, instr(l0, '-') + 1) else subtype end as s from ({_SPLIT}))
    select ent_id, case when length(s) > 0 then l || '-' || s else l end as label from x""")
def label_combined(spark: SparkSession, d: str) -> DataFrame:
    e = entities.split_label(_e(spark, d))
    return e.select("ent_id", entities.combined_label(F.col("label"), F.col("subtype")).alias("label"))


@query("select ent_id, coalesce(case upper(label) when 'PER' then 'Person' when 'LOC' then 'Location' when 'ORG' then 'Organization' when 'MISC' then 'Miscellaneous' end, label) as label from entities")
def label_long(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("ent_id", clean.long_label(F.col("label")).alias("label"))


@query("select dipl_text, label, min(ent_id) as ent_id from entities group by dipl_text, label")
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return entities.first_seen(_e(spark, d).select("dipl_text", "label", "ent_id"), ["dipl_text", "label"], ["ent_id"])


@query("""with p as (select label as kind, lower(norm_text) as key, norm_text, source, count(*) as n, min(ent_id) as o from entities where norm_text is not null group by all)
    select kind, key, min_by(norm_text, o) as text, cast(sum(n) as bigint) as frequency, count(distinct source) as works, string_agg(distinct norm_text, '|' order by norm_text) as variants from p group by kind, key""")
def dedupe_casefold_freq(spark: SparkSession, d: str) -> DataFrame:
    u = entities.unique_entities(_e(spark, d), "norm_text", "label", "source", ["ent_id"])
    return u.select("kind", "key", "text", "frequency", "works", F.array_join("variants", "|").alias("variants"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """The table has no running text: the context of a name is its manuscript spelling, its place the row in the file."""
    return entities.name_contexts(_e(spark, d), "norm_text", "label", "source", "dipl_text", ["file", "ord", "ent_id"], ["ent_id"])


@query("""select label as kind, lower(norm_text) as key, dipl_text as context, source as work, min_by(file, ent_id) as file, min_by(ord, ent_id) as ord, min(ent_id) as ent_id
    from entities where norm_text is not null group by all""")
def name_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d)


@query("select dipl_text, label, subtype, count(*) as n, min(ent_id) as first_row, max(ent_id) as last_row from entities group by dipl_text, label, subtype having count(*) > 1")
def dup_keys_idx(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated(_e(spark, d), ["dipl_text", "label", "subtype"], "ent_id")


@query("select dipl_text, label, subtype, ent_id, n from (select *, count(*) over (partition by dipl_text, label, subtype) as n from entities) where n > 1")
def dup_keys_rows(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated_rows(_e(spark, d).select("dipl_text", "label", "subtype", "ent_id"), ["dipl_text", "label", "subtype"])


@query("select label, subtype, count(*) as n, cast(grouping(label, subtype) as bigint) as level from entities group by rollup(label, subtype)")
def label_subtype_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_e(spark, d), "label", "subtype")


@query("select coalesce(label, 'UNKNOWN') as label, nullif(subtype, '') as subtype, count(*) as n from entities group by 1, 2")
def type_subtype_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.type_subtype_counts(_e(spark, d))


@query("select norm_text as dipl_text, label from entities")
def table_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.table_entities(_e(spark, d), "norm_text", "label")


def _mk(x: str) -> str:
    return f"lower({strip(sub(sub(x, '<[^>]+>', ''), f'{WS_LINE}+', ' '))})"


@query(f"""with a as (select ent_id, norm_text as t, dipl_text as d, {_mk('norm_text')} as n, {_mk('dipl_text')} as e from entities where norm_text is not null and dipl_text is not null)
    select ent_id, d as dipl_text, contains(n, e) as in_normalised, contains(t, d) as exact,
        case when not contains(t, d) and contains(n, e) then len(list_filter(range(-20, 21), lambda o: {_mk('substr(t, greatest(0, instr(n, e) - 1 + o) + 1, length(d))')} = e)) > 0 else false end as close from a""")
def mismatch_class(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).where("norm_text is not null and dipl_text is not null")
    texts = e.select("ent_id", F.col("norm_text").alias("text"))
    return qa.mismatches(texts, e.select("ent_id", F.col("ent_id").alias("ent"), "dipl_text"), "ent_id").drop("ent")


# -- markup made of the entity table: extraction must give the table back ------------------------------------------


def _markup(spark: SparkSession, d: str, tag) -> DataFrame:
    """(file, xml): the entities of each file as elements, in order."""
    e = _e(spark, d)
    word = F.concat(F.lit("<w n='1'><choice><me:dipl>"), F.coalesce("dipl_text", F.lit("")), F.lit("</me:dipl><me:norm>"), F.coalesce("norm_text", F.lit("")), F.lit("</me:norm></choice></w>"))
    el = e.select("file", F.struct("ent_id", tag(word).alias("x")).alias("s"))
    return el.groupBy("file").agg(F.concat(F.lit("<text><body>"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n"), F.lit("</body></text>")).alias("xml"))


_DIPL, _NORM = "coalesce(dipl_text, '')", "coalesce(norm_text, '')"
_READ = f"select file, ent_id, {strip(_DIPL)} as dipl_text, {strip(_NORM)} as norm_text, label, subtype from entities"


@query(f"""select file, dipl_text, norm_text, case when label = 'LOC' then 'LOC' else 'PER' end as label, case when label = 'LOC' or coalesce(subtype, '') = '' then null else subtype end as subtype
    from ({_READ}) where dipl_text <> '' or norm_text <> ''""")
def extract_tagged_spans(spark: SparkSession, d: str) -> DataFrame:
    has = F.length(F.coalesce("subtype", F.lit(""))) > 0
    tag = lambda w: F.when(F.col("label").eqNullSafe("LOC"), F.concat(F.lit("<placeName>"), w, F.lit("</placeName>"))).when(has, F.concat(F.lit('<addName type="'), "subtype", F.lit('">'), w, F.lit("</addName>"))).otherwise(F.concat(F.lit("<persName>"), w, F.lit("</persName>")))
    return extract.tei_names(_markup(spark, d, tag)).drop("ord")


_TYPES = "case coalesce(subtype, label, '') when 'SET' then 'settlement' when 'REG' then 'region' when 'RIV' then 'river' when 'MTN' then 'mountain' when 'CNY' then 'country' when 'LOC' then 'place' when 'SHIP' then 'ship' else 'person' end"


@query(f"""select file, dipl_text, norm_text, case k when 'ship' then 'SHIP' when 'person' then 'PER' else 'LOC' end as label,
    case k when 'settlement' then 'SET' when 'region' then 'REG' when 'river' then 'RIV' when 'mountain' then 'MTN' when 'country' then 'CNY' end as subtype
    from (select *, {_TYPES} as k from ({_READ})) where dipl_text <> '' or norm_text <> ''""")
def extract_typed_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr(_TYPES)
    return extract.tei_typed_names(_markup(spark, d, lambda w: F.concat(F.lit('<name n="2" type="'), kind, F.lit('">'), w, F.lit("</name>")))).drop("ord")


@query(f"""select file, norm_text, 'LOC' as label, case k when 'settlement' then 'SET' when 'region' then 'REG' when 'river' then 'RIV' when 'mountain' then 'MTN' when 'country' then 'CNY' else 'OTR' end as subtype
    from (select *, {_TYPES} as k from ({_READ})) where norm_text <> ''""")
def extract_geog_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr(_TYPES)
    return extract.tei_geog_names(_markup(spark, d, lambda w: F.concat(F.lit('<geogName type="'), kind, F.lit('">'), w, F.lit("</geogName>")))).drop("ord", "dipl_text")


_CHILD = "case when label = 'LOC' then case subtype when 'REG' then 'region' when 'CNY' then 'country' else 'settlement' end when subtype = 'ROL' then 'role' when coalesce(subtype, '') <> '' then 'byname' else 'person' end"


@query(f"""with r as (select *, coalesce({_CHILD}, 'person') as k from ({_READ}) where dipl_text <> '' or norm_text <> ''),
    twice as (select file, k, subtype, {strip("dipl_text || ' ' || dipl_text")} as dipl_text, {strip("norm_text || ' ' || norm_text")} as norm_text from r)
    select file, dipl_text, norm_text, 'PER' as label, cast(null as varchar) as subtype from r where k in ('person', 'role', 'byname')
    union all select file, dipl_text, norm_text, 'PER', 'ROL' from twice where k = 'role'
    union all select file, dipl_text, norm_text, 'PER', upper(subtype) from twice where k = 'byname'
    union all select file, dipl_text, norm_text, 'PER', upper(subtype) from r where k = 'byname'
    union all select file, dipl_text, norm_text, 'LOC', case k when 'region' then 'REG' when 'country' then 'CNY' else 'SET' end from r where k in ('region', 'country', 'settlement')""")
def extract_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons with a role or a byname and the children of places, each name standing in all parts of its element."""
    k = F.coalesce(F.expr(_CHILD), F.lit("person"))
    el = lambda tag, w: F.concat(F.lit(f"<{tag}>"), w, F.lit(f"</{tag.split()[0]}>"))

    def tag(w):
        name = el("forename", w)
        byname = F.concat(F.lit('<addName type="'), "subtype", F.lit('">'), w, F.lit("</addName>"))
        place = F.coalesce(*[F.when(k == t, el("placeName", el(t, w))) for t in ("region", "country", "settlement")])
        return F.when(k == "role", el("persName", F.concat(name, el('roleName n="1"', w)))).when(k == "byname", el("persName", F.concat(name, byname))).when(k == "person", el("persName", name)).otherwise(place)

    return extract.tei_persons(_markup(spark, d, tag)).drop("ord")


_RUN = _spaced("array_to_string(list_filter(list(w order by ent_id), lambda x: x <> ''), ' ')")


@query(f"select file, {_RUN} as text from (select file, ent_id, {_plain(_DIPL)} as w from entities) group by file")
def tei_running_text(spark: SparkSession, d: str) -> DataFrame:
    return _markup(spark, d, lambda w: F.concat(F.lit("<persName>"), w, F.lit("</persName>"))).select("file", clean.tei_running_text(F.col("xml")).alias("text"))


# -- occurrences and alignment ------------------------------------------------------------------------------------


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name_authority").select(F.col("auth_id").alias("ent"), F.col("auth_name").alias("text"), "label", F.lit(None).cast("string").alias("subtype"))


_HITS = """names as (select auth_id as ent, auth_name as name, label from name_authority where auth_name <> ''),
    p as (select doc_id, text, ent, name, label, string_split(text, name) as parts from documents join names on contains(text, name)),
    h as (select doc_id, text, ent, name, label, unnest(range(1, len(parts))) as k, parts from p),
    raw as (select doc_id, text, ent, name, label, cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(name) as integer) as start from h),
    occ as (select doc_id, ent, name, label, start, cast(start + length(name) - 1 as integer) as "end" from raw
        where substr(text, start + length(name) + 1, 1) = '' or regexp_matches(substr(text, start + length(name) + 1, 1), '[ ,;:!?).\\]}\\p{P}]')),
    span as (select doc_id, start, "end", label, min_by(name, ent) as text, min(ent) as ent from occ group by all)"""


@query(f"""with {_HITS} select doc_id, start, "end", text, label, ent from span""")
def gazetteer_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return spans.occurrences(table(spark, d, "documents"), _gazetteer(spark, d), "doc_id", "text").drop("subtype")


@query(f"""with {_HITS} select doc_id, start, min_by("end", ent) as "end", min_by(name, ent) as text, min(ent) as ent from raw2 group by doc_id, start""".replace("raw2", """(select *, cast(start + length(name) - 1 as integer) as "end" from raw)"""))
def occurrences_first(spark: SparkSession, d: str) -> DataFrame:
    return spans.occurrences(table(spark, d, "documents"), _gazetteer(spark, d), "doc_id", "text", boundary=False, keep="first").drop("label", "subtype")


@query(f"""with {_HITS} select ent, count(*) as n from raw group by ent""")
def occurrences_all(spark: SparkSession, d: str) -> DataFrame:
    o = spans.occurrences(table(spark, d, "documents"), _gazetteer(spark, d), "doc_id", "text", boundary=False, keep="all")
    return o.groupBy("ent").agg(F.count(F.lit(1)).alias("n"))


# the first parts of the names of persons, which texts repeat, and a second listing of every other name
_LISTED = "names as (select auth_id as ent, auth_name as name, label from name_authority where auth_name <> '')"
_FIRST = _HITS.replace(_LISTED, "names as (select min(auth_id) as ent, string_split(auth_name, ' ')[1] as name, label from name_authority where label = 'PER' and auth_name <> '' group by 2, 3)")
_TWICE = _HITS.replace(_LISTED, _LISTED[:-1] + " union all select auth_id + 100000, auth_name, 'ALT' from name_authority where auth_name <> '' and auth_id % 2 = 0)")


@query(f"""with {_FIRST} select doc_id, name as text, count(distinct start) as places from occ group by doc_id, name having count(distinct start) > 1""")
def occurrence_counts_multi(spark: SparkSession, d: str) -> DataFrame:
    first = _gazetteer(spark, d).where("label = 'PER' and text <> ''").groupBy(F.split("text", " ")[0].alias("text"), "label", "subtype").agg(F.min("ent").alias("ent"))
    return spans.repeated_names(spans.occurrences(table(spark, d, "documents"), first, "doc_id", "text"), "doc_id")


def _twice(spark: SparkSession, d: str) -> DataFrame:
    g = _gazetteer(spark, d)
    return g.unionByName(g.where("ent % 2 = 0").withColumns({"ent": F.col("ent") + 100_000, "label": F.lit("ALT")}))


@query(f"""with {_TWICE}, many as (select doc_id, start, "end", count(*) as names from span group by doc_id, start, "end" having count(*) > 1)
    select s.doc_id, s.start, s."end", s.text, s.label, s.ent, names from span s join many m on s.doc_id = m.doc_id and s.start = m.start and s."end" = m."end" """)
def overlap_position_names(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_place_names(spans.occurrences(table(spark, d, "documents"), _twice(spark, d), "doc_id", "text"), "doc_id").drop("subtype")


@query(f"""with {_TWICE} select doc_id, start, "end", count(*) as names, string_agg(distinct label, ',' order by label) as labels from span group by doc_id, start, "end" having count(*) > 1""")
def overlap_positions(spark: SparkSession, d: str) -> DataFrame:
    o = spans.occurrences(table(spark, d, "documents"), _twice(spark, d), "doc_id", "text")
    return spans.shared_places(o, "doc_id").withColumn("labels", F.array_join("labels", ","))


@query(f"""with {_HITS} select (select count(*) from name_authority where label = 'LOC') as listed, count(distinct case when label = 'LOC' then ent end) as placed,
    (select count(*) from name_authority where label = 'LOC') - count(distinct case when label = 'LOC' then ent end) as missing from span""")
def placed_difference(spark: SparkSession, d: str) -> DataFrame:
    g = _gazetteer(spark, d).withColumn("subtype", F.col("label"))
    return stats.placed_difference(g, spans.occurrences(table(spark, d, "documents"), g, "doc_id", "text"), "LOC")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "year", "source")
    found = spans.occurrences(docs, _gazetteer(spark, d), "doc_id", "text")
    return spans.pack_dataset(docs, found, spans.word_spans(docs, "doc_id", "text"), "doc_id", ["lang", "year", "source"])


@query(f"""with {_HITS} select d.doc_id, d.lang, coalesce(string_agg(label, ',' order by start, ent), '') as entity_types, coalesce(string_agg(cast(start as varchar), ',' order by start, ent), '') as entity_start_chars,
    coalesce(string_agg(cast("end" as varchar), ',' order by start, ent), '') as entity_end_chars from documents d left join span s on d.doc_id = s.doc_id group by d.doc_id, d.lang""")
def dataset_pack(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _packed(spark, d).select("doc_id", "lang", flat("entity_types"), flat("entity_start_chars"), flat("entity_end_chars"))


@query(f"""with {_HITS} select s.doc_id, s.label as type, s.start, s."end", s.text, substr(d.text, greatest(0, start - 30) + 1, "end" + 1 + 30 - greatest(0, start - 30)) as context from span s join documents d on s.doc_id = d.doc_id""")
def dataset_unpack(spark: SparkSession, d: str) -> DataFrame:
    return spans.unpack_dataset(_packed(spark, d), "doc_id")


def _doc_tokens(spark: SparkSession, d: str, key: str = "doc_id", name: str = "documents") -> DataFrame:
    lines = clean.sentence_lines(clean.unix_newlines(F.col("text")))
    return table(spark, d, name).select(key, F.flatten(F.transform(lines, clean.peel_tokens)).alias("tokens"))


@query()
def bio_align_greedy(spark: SparkSession, d: str) -> DataFrame:
    return align.align(_doc_tokens(spark, d), _gazetteer(spark, d)).where("label <> 'O'")


_WORDS = """w as (select sent_id, row_number() over (partition by sent_id order by tok_id) - 1 as i, token from (select sent_id, tok_id, min(token) as token from conll_tokens group by all) where token is not null),
    g as (select auth_name as name, min(auth_id) as ent from name_authority where label = 'LOC' and not contains(auth_name, ' ') and not contains(auth_name, '-') group by auth_name),
    ex as (select sent_id, name, max(i) as last from w join g on token = name group by all),
    hit as (select w.sent_id, i, g.ent from w join g on lower(token) = lower(name) left join ex on ex.sent_id = w.sent_id and ex.name = g.name where token = g.name or i > coalesce(last, -1))"""


@query(f"with {_WORDS} select distinct sent_id, cast(i as integer) as tok_id, 'B-Location' as label from hit")
def bio_align_single(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conll_tokens").groupBy("sent_id", "tok_id").agg(F.min("token").alias("token")).where("token is not null")
    s = t.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", "token"))), lambda x: x["token"]).alias("tokens"))
    g = _gazetteer(spark, d).where("label = 'LOC' and not contains(text, ' ') and not contains(text, '-')")
    return align.align(s, g, "sent_id").where("label <> 'O'").select("sent_id", "tok_id", "label")


@query()
def names_not_found(spark: SparkSession, d: str) -> DataFrame:
    g = _gazetteer(spark, d)
    return align.not_found(g, align.align(_doc_tokens(spark, d), g))


# -- similarity and clusters --------------------------------------------------------------------------------------

_PAIRS = "pairs as (select a, b from (select distinct p_name as a from part) join (select distinct p_name as b from part) on a < b)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the distinct part names, a bounded list of 64."""
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select(F.col("p_name").alias("a")).join(p.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))


def _jaro(frame: str, x: str, y: str, out: str) -> str:
    """CTEs from `frame` to `out`, which has the Jaro similarity of x and y as j: each character of x in turn takes the
    first free equal one of y within reach; half a transposition counts."""
    reach = f"(greatest(0, greatest(length({x}), length({y})) // 2 - 1))"
    free = f"list_filter(range(greatest(1, e[1] - {reach}), least(length({y}), e[1] + {reach}) + 1), lambda k: substr({y}, k, 1) = substr({x}, e[1], 1) and not list_contains(acc, k))"
    taken = f"list_reduce(list_prepend(cast([] as bigint[]), list_transform(range(1, length({x}) + 1), lambda i: [i])), lambda acc, e: list_append(acc, coalesce({free}[1], 0)))"
    return f"""{out}1 as (select *, {taken} as m from {frame}),
    {out}2 as (select *, list_transform(list_filter(range(1, len(m) + 1), lambda i: m[i] > 0), lambda i: substr({x}, i, 1)) as hx, list_transform(list_sort(list_filter(m, lambda k: k > 0)), lambda k: substr({y}, k, 1)) as hy from {out}1),
    {out}3 as (select * exclude (m, hx, hy), len(hx) as hits, len(list_filter(range(1, len(hx) + 1), lambda i: hx[i] <> hy[i])) / 2 as swaps from {out}2),
    {out} as (select * exclude (hits, swaps), case when {x} = {y} then 1.0 when hits = 0 then 0.0 else (hits / length({x}) + hits / length({y}) + (hits - swaps) / hits) / 3 end as j from {out}3)"""


def _same(x: str, y: str, most: str) -> str:
    return f"len(list_filter(range(1, {most} + 1), lambda i: left({x}, i) = left({y}, i)))"


def _mix(x: str, y: str) -> str:
    least = f"least(length({x}), length({y}))"
    # levenshtein of the SQL engine counts bytes: letters of two bytes are written as capitals, which lower case leaves free
    ex, ey = (f"translate({z}, 'áéíóúýþðæœøǫäö', 'ABCDEFGHIJKLMN')" for z in (x, y))
    return f"case when {x} = {y} then 1.0 else 0.40 * j + 0.35 * (1 - levenshtein({ex}, {ey}) / greatest(length({x}), length({y}))) + 0.25 * {_same(x, y, least)} / greatest(length({x}), length({y})) end"


@query(f"""with {_PAIRS} select a, b, levenshtein(a, b) as edits, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as similarity from pairs""")
def lev_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"), F.round(similarity.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""with {_PAIRS} select a, b, {_same('a', 'b', 'least(length(a), length(b))')} as prefix from pairs""")
def prefix_len(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", similarity.common_prefix(F.col("a"), F.col("b")).cast("long").alias("prefix"))


_WINKLER = f"case when plain > 0.7 then plain + 0.1 * {_same('a', 'b', 'least(4, length(a), length(b))')} * (1 - plain) else plain end"


@query(f"""with {_PAIRS}, {_jaro('pairs', 'a', 'b', 'whole')}, own as (select a, b, lower(a) as la, lower(b) as lb, j as plain from whole), {_jaro('own', 'la', 'lb', 'low')}
    select a, b, round(plain, 6) as jaro, round({_WINKLER}, 6) as jaro_winkler, round({_mix('la', 'lb')}, 6) as combined from low""")
def string_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("a", "b", F.round(similarity.jaro_col(a, b), 6).alias("jaro"), F.round(similarity.jaro_winkler_col(a, b), 6).alias("jaro_winkler"), F.round(similarity.combined_similarity(a, b), 6).alias("combined"))


@query("""with r as (select a.vec_id as query, b.vec_id as key, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as distance from embeddings a join embeddings b on a.vec_id % 100 = 0)
    select query, key, distance from (select *, row_number() over (partition by query order by distance, key) as place from r) where place <= 10""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return cluster.nearest(e, "vec_id", "embedding", e.where("vec_id % 100 = 0")).select("query", "key", F.round("distance", 5).alias("distance"))


def _vector_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "name_authority").select(F.col("auth_id").alias("id"), F.col("auth_name").alias("text"), F.col("label").alias("kind"))
    return n.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


_NAME_PAIRS = """v as (select auth_id as id, auth_name as text, n.label as kind, embedding::double[] as v from name_authority n left join embeddings on auth_id = vec_id),
    np as (select a.id as a, b.id as b, lower(a.text) as ta, lower(b.text) as tb, 1 - list_cosine_similarity(a.v, b.v) as cosine from v a join v b on a.kind = b.kind and a.id < b.id)"""
_HYBRID = f"case when cosine is null then 1 - ({_mix('ta', 'tb')}) else 0.6 * (1 - ({_mix('ta', 'tb')})) + 0.4 * cosine end"


@query(f"with {_NAME_PAIRS} select a, b, round(cosine, 5) as cosine from np")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one kind; null where a name has no vector."""
    has = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return _name_pairs(spark, d).select("a", "b", F.when(has, F.round(similarity.cosine_distance(F.col("va"), F.col("vb")), 5)).alias("cosine"))


@query(f"with {_NAME_PAIRS}, {_jaro('np', 'ta', 'tb', 'jaro')} select a, b, round({_HYBRID}, 5) as distance from jaro")
def hybrid_distance(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one kind; by text alone where a name has no vector."""
    text = 1 - similarity.combined_similarity(F.col("ta"), F.col("tb"))
    has = F.col("va").isNotNull() & F.col("vb").isNotNull()
    both = similarity.hybrid_distance(F.col("ta"), F.col("tb"), F.col("va"), F.col("vb"))
    return _name_pairs(spark, d).select("a", "b", F.round(F.when(has, both).otherwise(text), 5).alias("distance"))


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs a < b of the name list's entries of one kind. The list is bounded."""
    v = _vector_names(spark, d)
    a = v.select("kind", F.col("id").alias("a"), F.col("text").alias("ta"), F.col("embedding").alias("va"))
    b = v.select("kind", F.col("id").alias("b"), F.col("text").alias("tb"), F.col("embedding").alias("vb"))
    return a.join(b, "kind").where("a < b")


def _unique_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, kind): the unique names of entities, as in dedupe_casefold_freq, by their first row. No table has vectors of them."""
    e = _e(spark, d).where("norm_text is not null")
    return e.groupBy(F.col("label").alias("kind"), F.lower("norm_text").alias("key")).agg(F.min("ent_id").alias("id"), F.min_by("norm_text", "ent_id").alias("text")).drop("key")


@query()
def hdbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_names(_unique_names(spark, d), vector=None)


@query()
def name_cluster_payload(spark: SparkSession, d: str) -> DataFrame:
    ids = _unique_names(spark, d).select(F.col("kind").alias("_k"), F.lower("text").alias("_t"), "id")
    u = entities.unique_entities(_e(spark, d), "norm_text", "label", "source", ["ent_id"])
    n = _contexts(spark, d).groupBy(F.col("kind").alias("_nk"), F.col("key").alias("_nt")).agg(F.count(F.lit(1)).alias("sources"))
    u = u.join(ids, u["kind"].eqNullSafe(ids["_k"]) & (u["key"] == ids["_t"])).join(n, u["kind"].eqNullSafe(n["_nk"]) & (u["key"] == n["_nt"]))
    return cluster.payload(hdbscan_clusters(spark, d), u)


_GROUPS = "c as (select 'v' as kind, '' as block, label as cluster, vec_id as id, 'v' || vec_id as text from embeddings)"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("v").alias("kind"), F.lit("").alias("block"), F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("text"))


def _flat(p: DataFrame) -> DataFrame:
    return p.select("kind", "cluster", "size", F.array_join(F.transform("members", lambda m: m["text"]), ",").alias("members"), "next_cluster", "is_noise")


_PAYLOAD = "select kind, cluster, count(*) as size, string_agg(text, ',' order by text, id) as members, max(max(cluster)) over (partition by kind) + 1 as next_cluster, cluster = -1 as is_noise from {c} group by kind, cluster"


@query(f"with {_GROUPS} {_PAYLOAD.format(c='c')}")
def cluster_payload(spark: SparkSession, d: str) -> DataFrame:
    return _flat(cluster.payload(_groups(spark, d)))


@query(f"with {_GROUPS}, m as (select kind, block, id, text, case when id in (1, 2) then -1 when cluster in (2, 3) then 2 when cluster = 1 then -1 else cluster end as cluster from c) {_PAYLOAD.format(c='m')}")
def cluster_merge_move(spark: SparkSession, d: str) -> DataFrame:
    h = cluster.History(_groups(spark, d))
    h.apply(cluster.merge, [3, 2])
    h.apply(cluster.dissolve, 1)
    h.apply(cluster.move, [1, 2], -1)
    h.apply(cluster.move, [5], 0)
    h.undo()
    return _flat(cluster.payload(h.now))


@query()
def vector_plane(spark: SparkSession, d: str) -> DataFrame:
    return cluster.project_2d(table(spark, d, "embeddings")).select("vec_id", "label", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
