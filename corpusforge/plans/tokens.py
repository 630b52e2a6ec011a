"""Queries over token tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusforge.functions.chars import WS
from corpusforge.operators import entities, extract, leakage, splits, stats
from corpusforge.plans.text import strip
from corpusforge.runtime import table
from corpusforge.sources import conll

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of conll_tokens, each place once however often it was delivered."""
    t = table(spark, d, "conll_tokens").select("source", "split", "sent_id", "tok_id", "token", "label")
    return t.dropDuplicates(["sent_id", "tok_id"])


_T = "t as (select sent_id, tok_id, any_value(source) as source, any_value(split) as split, min(token) as token, min(label) as label from conll_tokens group by sent_id, tok_id)"
_E = f"{_T}, e as (select *, substr(label, 3) as type from t where regexp_matches(label, '^[BI]-'))"


@query(f"with {_E} select type, count(*) as entities from e where label like 'B-%' group by type")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.entity_counts(_tokens(spark, d))


@query(f"with {_E} select sent_id, type, count(*) as tokens from e group by sent_id, type")
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return stats.entity_tokens(_tokens(spark, d), ["sent_id"])


@query(f"with {_E} select sent_id, string_agg(distinct type, ',' order by type) as types from e group by sent_id")
def types_per_sentence(spark: SparkSession, d: str) -> DataFrame:
    return stats.types_per_sentence(_tokens(spark, d), ["sent_id"]).withColumn("types", F.array_join("types", ","))


_STATS = f"""{_E}, total as (select count(*) as total_tokens, count(distinct sent_id) as sentences from t),
    s as (select type, count(*) filter (label like 'B-%') as entities, count(*) as tokens, count(distinct case when label like 'B-%' then sent_id end) as sentences_with,
        any_value(sentences) as sentences, any_value(total_tokens) as total_tokens from e, total group by type),
    stats as (select *, round(-log2(tokens / total_tokens), 6) as rareness from s)"""


@query(f"with {_STATS} select * from stats")
def corpus_stats_rareness(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(_tokens(spark, d))


_SPANS = f"""{_E}, g as (select *, case when label like 'I-%' and lag(tok_id) over w = tok_id - 1 and lag(type) over w = type then 0 else 1 end as first from e window w as (partition by sent_id order by tok_id)),
    i as (select *, sum(first) over (partition by sent_id order by tok_id) as island from g),
    spans as (select sent_id, any_value(source) as source, min(tok_id) as start, max(tok_id) as "end", string_agg(coalesce(token, ''), ' ' order by tok_id) as text, count(*) as n,
        case any_value(type) when 'Person' then 'PER' when 'Location' then 'LOC' end as label, min_by(left(label, 1), tok_id) as k from i group by sent_id, island)"""


@query(f"""with {_SPANS} select sent_id, start, "end", text, n, label from spans where k = 'B' and label is not null""")
def bio_spans(spark: SparkSession, d: str) -> DataFrame:
    return extract.bio_entities(_tokens(spark, d), ["sent_id"])


@query(f"""with {_SPANS} select source, label, text, count(*) as n from spans where k = 'B' and label is not null group by source, label, text""")
def bio_names_by_source(spark: SparkSession, d: str) -> DataFrame:
    return extract.bio_entities(_tokens(spark, d), ["sent_id"], extra=["source"]).groupBy("source", "label", "text").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_T} select sent_id, tok_id, case when regexp_matches(label, '^[BI]-') and substr(label, 3) not in ('Person', 'Location') then 'O' else label end as label from t")
def bio_filter(spark: SparkSession, d: str) -> DataFrame:
    return entities.filter_types(_tokens(spark, d)).select("sent_id", "tok_id", "label")


@query(f"with {_E} select source, type, count(*) as original, count(*) filter (type in ('Person', 'Location')) as kept, count(*) filter (type not in ('Person', 'Location')) as removed from e group by source, type")
def bio_filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    return entities.filter_statistics(_tokens(spark, d), ["source"])


@query(f"with {_E}, c as (select source, type, count(*) as n from e group by source, type) select source, type, n, round(100.0 * n / sum(n) over (partition by source), 4) as percent from c")
def label_shares(spark: SparkSession, d: str) -> DataFrame:
    return stats.shares(stats.labelled(_tokens(spark, d)).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n")), "n", ["source"])


@query(f"with {_T} select source, split, count(*) as n, cast(grouping(source, split) as bigint) as level from t group by rollup(source, split)")
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_tokens(spark, d), "source", "split")


def _read(strict: str, label: str, text: str) -> str:
    return f"""with l as (select file, line_id as ln, {text} as t from raw_lines),
        b as (select *, sum(case when t = '' then 1 else 0 end) over (partition by file order by ln rows between unbounded preceding and current row) as block, string_split(t, chr(9)) as p from l),
        k as (select * from b where t <> '' and len(p) {strict}),
        f as (select file, block, row_number() over (partition by file order by block) as sent_id from (select distinct file, block from k))
        select k.file, sent_id, row_number() over (partition by k.file, k.block order by ln) as tok_id, p[1] as token, {label} as label from k join f on k.file = f.file and k.block = f.block"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_lines").select("file", F.col("line_id").alias("ln"), "line")


@query(_read(">= 2", "p[len(p)]", strip("line")))
def conll_read_last(spark: SparkSession, d: str) -> DataFrame:
    return conll.sentence_ids(conll.parse_conll(_raw(spark, d), "last"))


@query(_read(">= 2", "p[2]", "line"))
def conll_read_second(spark: SparkSession, d: str) -> DataFrame:
    return conll.sentence_ids(conll.parse_conll(_raw(spark, d), "second"))


_TWO = r"regexp_replace(line, '^([^\t]*)\t[^\t]*\t([^\t]*)\t', '\1 \2' || chr(9))"


@query(_read("= 2", "p[2]", strip(_TWO)))
def conll_read_strict(spark: SparkSession, d: str) -> DataFrame:
    two = F.regexp_replace("line", r"^([^\t]*)\t[^\t]*\t([^\t]*)\t", "$1 $2\t")
    return conll.sentence_ids(conll.parse_conll(_raw(spark, d).withColumn("line", two), "strict"))


@query(f"""with l as (select file, line_id as ln, {strip('line')} as t from raw_lines),
    b as (select *, sum(case when t = '' then 1 else 0 end) over (partition by file order by ln rows between unbounded preceding and current row) as block from l)
    select file, cast(block as bigint) as block, string_agg(string_split(t, chr(9))[1], ' ' order by ln) as text from b where t <> '' group by file, block""")
def running_text(spark: SparkSession, d: str) -> DataFrame:
    return conll.running_text(_raw(spark, d))


_SENT = f"{_T}, s as (select sent_id, any_value(split) as split, any_value(source) as source, string_agg(coalesce(token, '') || chr(9) || coalesce(label, ''), '|||' order by tok_id) as sentence from t group by sent_id)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return conll.sentence_strings(_tokens(spark, d), ["sent_id", "split"], "|||", ("token", "label"))


@query(f"with {_SENT} select sent_id, split, sentence from s")
def sentence_strings(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


@query(f"with {_SENT} select sent_id, split, sentence from s where split = 'train' and sentence not in (select sentence from s where split <> 'train')")
def leak_anti_join(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return leakage.without_overlap(s.where("split = 'train'"), s.where("split <> 'train'"))


@query(f"with {_SENT} select sentence from s where split = 'train' intersect select sentence from s where split <> 'train'")
def leak_intersect(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return leakage.overlap(s.where("split = 'train'"), s.where("split <> 'train'"))


_FACTORS = {
    "sC": "1 + k", "sCR": "1 + ceil(sqrt(rc))", "sCRD": "1 + ceil(rc / sqrt(n))", "nsCRD": "1 + ceil(rs / sqrt(n))",
}
_PARTS = f"""{_STATS}, c as (select sent_id, case when regexp_matches(label, '^[BI]-') then substr(label, 3) end as type, count(*) as c from t group by 1, 2),
    p as (select sent_id, cast(sum(c.c) as bigint) as n, sum(case when c.type is not null then c.c end) as k, sum(case when c.type is not null then coalesce(rareness, 1) * c.c end) as rc,
        sum(case when c.type is not null then coalesce(rareness, 1) * sqrt(c.c) end) as rs from c left join stats on c.type = stats.type group by sent_id)"""


def _factor(method: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        t = _tokens(spark, d)
        return splits.factors(t, stats.corpus_stats(t), ["sent_id"], method)

    f.__name__ = f"factor_{method.lower()}"
    return query(f"with {_PARTS} select sent_id, n, cast(coalesce({_FACTORS[method]}, 1) as bigint) as factor from p")(f)


for _m in splits.METHODS:
    _factor(_m)


@query(f"with {_PARTS}, f as (select coalesce({_FACTORS['sCR']}, 1) as factor from p) select cast(factor as bigint) as factor, count(*) as sentences from f group by 1")
def factor_histogram(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["factor_scr"](spark, d).groupBy("factor").agg(F.count(F.lit(1)).alias("sentences"))


@query(f"with {_PARTS}, f as (select sent_id, cast(coalesce({_FACTORS['sCR']}, 1) as bigint) as factor from p) select sent_id, unnest(range(1, factor + 1)) as copy from f")
def resample_rows(spark: SparkSession, d: str) -> DataFrame:
    f = QUERIES["factor_scr"](spark, d)
    return splits.replicate(f.select("sent_id"), f, ["sent_id"])


_KEYED = f"{_T}, k as (select sent_id, any_value(source) as source, coalesce(bool_or(label like '_-Person'), false) as has_person, coalesce(bool_or(label like '_-Location'), false) as has_location, md5('42|' || sent_id) as h from t group by sent_id)"
_CUT = "case when r < {a} then '{x}' when r < {a} + {b} then '{y}' else 'train' end"


def _sents(spark: SparkSession, d: str) -> DataFrame:
    has = lambda x: F.coalesce(F.bool_or(F.col("label").rlike(f"^.-{x}$")), F.lit(False))
    return _tokens(spark, d).groupBy("sent_id").agg(F.min("source").alias("source"), has("Person").alias("has_person"), has("Location").alias("has_location"))


@query(f"with {_KEYED}, r as (select *, row_number() over (order by h, sent_id) - 1 as r, count(*) over () as n from k) select sent_id, {_CUT.format(a='floor(n * 0.1)', b='floor(n * 0.1)', x='test', y='dev')} as split from r")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(_sents(spark, d).select("sent_id"), ["sent_id"]).select("sent_id", "split")


@query(f"with {_KEYED}, r as (select *, row_number() over (order by h, sent_id) - 1 as r, count(*) over () as n from k) select sent_id, {_CUT.format(a='floor(n * 0.15)', b='floor(n * 0.15)', x='dev', y='test')} as split from r")
def split_three_way(spark: SparkSession, d: str) -> DataFrame:
    return splits.ratio_split(_sents(spark, d).select("sent_id"), ["sent_id"]).select("sent_id", "split")


_STRATA = f"""{_KEYED}, s as (select *, case when has_person and has_location then 'both' when has_location then 'location' when has_person then 'person' else 'neither' end as stratum from k),
    r as (select *, row_number() over (partition by stratum order by h, sent_id) - 1 as r, count(*) over (partition by stratum) as n from s),
    m as (select *, case when has_location then floor(floor(n * 0.5) / 2) else floor(n * 0.15) end as nd, case when has_location then floor(n * 0.5) - floor(floor(n * 0.5) / 2) else floor(n * 0.15) end as nt from r),
    z as (select sent_id, has_location, stratum, {_CUT.format(a='nd', b='nt', x='dev', y='test')} as split from m)"""


@query(f"with {_STRATA} select sent_id, stratum, split from z")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(_sents(spark, d), ["sent_id"]).select("sent_id", "stratum", "split")


@query(f"with {_STRATA} select split, count(*) as sentences, round(100 * avg(case when has_location then 1.0 else 0.0 end), 4) as location_percent from z group by split")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_balance(splits.stratified_split(_sents(spark, d), ["sent_id"]))


@query(f"with {_KEYED} select sent_id, row_number() over (partition by source order by h, sent_id) - 1 as rank from k")
def shuffled_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = _tokens(spark, d).groupBy("sent_id").agg(F.min("source").alias("source"))
    return splits.seeded_rank(s, ["source"], ["sent_id"]).select("sent_id", "rank")


def _experiment_sizes(spark: SparkSession, d: str, experiments: dict[str, tuple[str, ...]]) -> DataFrame:
    """Sentences and tokens of every part of every experiment. Sentences are counted once per part, with and without their
    factor, and the few sums are given to the experiments; nothing is replicated to be counted."""
    w = table(spark, d, "works").select("source", "text_rep_level").dropDuplicates(["source"])
    t = _tokens(spark, d)
    part = F.when(F.col("text_rep_level") == "dipl", "diplo").when(F.col("text_rep_level") == "norm", "norm").otherwise("mim")
    s = t.where("split = 'train'").groupBy("sent_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("tokens")).join(w, "source", "left").withColumn("p", part)
    f = splits.factors(t, stats.corpus_stats(t), ["sent_id"]).select("sent_id", "factor")
    one, rep = F.lit(1).cast("long"), F.col("factor")
    sums = s.join(f, "sent_id").groupBy("p").agg(F.sum(one).alias("s"), F.sum("tokens").alias("t"), F.sum(rep).alias("sr"), F.sum(F.col("tokens") * rep).alias("tr"))
    both = sums.select("p", F.explode(F.array(F.struct(F.lit("").alias("r"), F.col("s").alias("sentences"), F.col("t").alias("tokens")), F.struct(F.lit("_r").alias("r"), F.col("sr").alias("sentences"), F.col("tr").alias("tokens")))).alias("x"))
    names = both.select(F.explode(F.when(F.col("p") == "norm", F.array(F.lit("norm"), F.lit("old"))).otherwise(F.array("p"))).alias("q"), "x.*").select(F.concat("q", "r").alias("part"), "sentences", "tokens")
    uses = spark.createDataFrame([(e, p) for e, ps in experiments.items() for p in ps], "experiment string, part string")
    return uses.join(names, "part").select("experiment", "part", "sentences", "tokens")


_EXPERIMENT = f"""with {_PARTS}, w as (select source, min(text_rep_level) as lev from works group by source),
    f as (select sent_id, cast(coalesce({_FACTORS['sCR']}, 1) as bigint) as factor from p),
    sx as (select t.sent_id, count(*) as tokens, case any_value(lev) when 'dipl' then 'diplo' when 'norm' then 'norm' else 'mim' end as p from t left join w on t.source = w.source where split = 'train' group by t.sent_id),
    x as (select p as part, count(*) as sentences, cast(sum(tokens) as bigint) as tokens from sx group by p
        union all select p || '_r', cast(sum(factor) as bigint), cast(sum(tokens * factor) as bigint) from sx join f on sx.sent_id = f.sent_id group by p),
    y as (select * from x union all select replace(part, 'norm', 'old'), sentences, tokens from x where part like 'norm%'),
    u as (select * from (values {{values}}) as v(experiment, part))
    select u.experiment, u.part, sentences, tokens from u join y on u.part = y.part"""


def _values(t: dict) -> str:
    return ", ".join(f"('{k}', '{p}')" for k, ps in t.items() for p in ps)


@query(_EXPERIMENT.format(values=_values(splits.DIPLOMATIC)))
def experiment_matrix_diplomatic(spark: SparkSession, d: str) -> DataFrame:
    return _experiment_sizes(spark, d, splits.DIPLOMATIC)


@query(_EXPERIMENT.format(values=_values(splits.NORMALISED)))
def experiment_matrix_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _experiment_sizes(spark, d, splits.NORMALISED)


def _part_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their types and part; a sentence is in one part, that of its least source. Tokens move once, by sentence."""
    w = table(spark, d, "works").groupBy("source").agg(F.min("text_rep_level").alias("lev"))
    t = table(spark, d, "conll_tokens").where("sent_id is not null").select("sent_id", "tok_id", "label", "source").repartition("sent_id")
    t = t.groupBy("sent_id", "tok_id").agg(F.min("label").alias("label"), F.min("source").alias("source"))  # each place once
    part = F.when(F.col("lev") == "dipl", "diplo").when(F.col("lev") == "norm", "norm").otherwise("mim")
    return splits.sentence_types(t, ["sent_id"], "source").join(w, "source", "left").withColumn("part", part)


# The two above keep the sizes of their SQL (given splits, rareness of all tokens); these make the sets of R9 and R10.
@query()
def experiment_sets_diplomatic(spark: SparkSession, d: str) -> DataFrame:
    return splits.sentence_sets(_part_sentences(spark, d), "diplo", ["norm", "mim"], splits.DIPLOMATIC)


@query()
def experiment_sets_normalised(spark: SparkSession, d: str) -> DataFrame:
    return splits.sentence_sets(_part_sentences(spark, d), "norm", ["mim"], splits.NORMALISED_SETS, "old")


_KEY = strip(f"regexp_replace(lower(text), '{WS}+', ' ', 'g')")


@query(f"""with d as (select doc_id, {_KEY} as t from documents), s as (select review_id, {_KEY} as p from abuse_review)
    select doc_id, review_id from d join s on contains(t, p) where p <> '' and len(string_split(p, ' ')) >= 5""")
def contam_pairs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contained_pairs(table(spark, d, "documents"), table(spark, d, "abuse_review"), "doc_id", "review_id")


_GONE = "regexp_replace(acc.t, '(?i)' || e.p, '', 'g')"
_SQUEEZED = strip(f"regexp_replace(regexp_replace(x.t, '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{WS}*' || chr(10), chr(10) || chr(10), 'g')")


@query(f"""with d as (select doc_id, text, {_KEY} as t from documents), s as (select review_id, text as raw, {_KEY} as p from abuse_review),
    hits as (select doc_id, list(array_to_string(list_transform(list_filter(string_split_regex(raw, '{WS}+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '{WS}+') order by review_id) as ps
        from d join s on contains(t, p) where p <> '' and len(string_split(p, ' ')) >= 5 group by doc_id),
    done as (select d.doc_id, list_reduce(list_prepend({{'t': text, 'p': '', 'n': 0}}, list_transform(ps, lambda p: {{'t': '', 'p': p, 'n': 0}})), lambda acc, e: {{'t': {_GONE}, 'p': '', 'n': acc.n + cast({_GONE} <> acc.t as integer)}}) as x
        from d join hits on d.doc_id = hits.doc_id)
    select doc_id, {_SQUEEZED} as text, x.n as removed from done
    union all select doc_id, text, 0 from documents where doc_id not in (select doc_id from hits)""")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    docs, sents = table(spark, d, "documents"), table(spark, d, "abuse_review")
    return leakage.remove_sentences(docs, sents, leakage.contained_pairs(docs, sents, "doc_id", "review_id"), "doc_id", "review_id")

