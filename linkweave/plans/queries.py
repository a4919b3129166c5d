"""The registered queries of the entity resolution operators, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, sampling
from ..functions import text as X
from ..operators import blocking as B
from ..operators import features as FT
from ..operators import labels, metrics, model, postproc, validate
from ..sources import entities as E
from ..sources import results as R
from ..sources.scratch import forget, materialize, settle
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return E.from_documents(spark, sf)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return E.queries_and_pool(_entities(spark, sf))


def _truth(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Silver truth: equal texts."""
    return s1.select(F.col("entity_id").alias("s1_id"), "text").join(pool.select(F.col("entity_id").alias("cand_id"), "text"), "text").select("s1_id", "cand_id")


NEGATIVES, SEED = 300, 17


def _eval_pairs(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, cand_id, y): all true pairs, and NEGATIVES same-country pairs but the true ones."""
    truth = _truth(s1, pool)
    negatives = labels.same_country_negatives(s1, pool, NEGATIVES, SEED).join(truth, ["s1_id", "cand_id"], "left_anti")
    return truth.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))


def _scored(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score): pairs that share a rare name token, scored by the names' Jaccard."""
    query_, rest = B.prepare(s1), B.prepare(pool)
    mine, theirs = (B.tokens(p).where("kind = 'N'") for p in (query_, rest))
    rare = B.frequencies(theirs, mine).where("df <= 20")
    hits = theirs.join(rare, ["kind", "token"]).select("token", F.col("entity_id").alias("cand_id"))
    common = mine.select("token", F.col("entity_id").alias("s1_id")).join(hits, "token").select("s1_id", "cand_id").distinct()
    left = query_.select(F.col("entity_id").alias("s1_id"), F.array_distinct("tn").alias("x"))
    right = rest.select(F.col("entity_id").alias("cand_id"), F.array_distinct("tn").alias("y"))
    return common.join(left, "s1_id").join(right, "cand_id").select("s1_id", "cand_id", X.jaccard(F.col("x"), F.col("y")).alias("score"))


def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---------------------------------------------------------------- text


@query(f"with {S.ENTITIES}, b as (select entity_id, name, {S.norm('name')} as n, {S.norm('name', ' ')} as n_space from ent) "
       f"select entity_id, n, n_space, {S.ascii_norm('name')} as n_ascii, {S.strip('n', X.LEGAL_FORMS)} as n_strip, {S.strip('n_space', X.LEGAL_FORMS_SHORT)} as n_strip_short from b")  # fmt: skip
def norm_text(spark, sf):
    """Normalized names, their variants and suffix-stripped forms."""
    e = _entities(spark, sf).withColumn("n", X.norm(F.col("name"))).withColumn("n_space", X.norm_space(F.col("name")))
    return e.select("entity_id", "n", "n_space", X.norm_ascii(F.col("name")).alias("n_ascii"), X.strip_suffix(F.col("n")).alias("n_strip"), X.strip_suffix_short(F.col("n_space")).alias("n_strip_short"))


@query(f"with {S.PREPARED} select entity_id, list_sort(tn) as words, list_sort(tm) as numbers, fk from prep")
def token_lists(spark, sf):
    """Distinct words, numbers and the folded key of every entity."""
    p = B.prepare(_entities(spark, sf))
    return p.select("entity_id", F.sort_array(F.array_distinct("tn")).alias("words"), F.sort_array(F.array_distinct("tm")).alias("numbers"), "fk")


@query(rf"with {S.ENTITIES} select country, {S.script('name')} as script, count(*) as n, "
       rf"avg(regexp_matches(name, '[^\x00-\x7F]')::int::double) as not_ascii, avg(regexp_matches(name, '[\x{{0900}}-\x{{0D7F}}]')::int::double) as indic, "
       rf"sum(case when not regexp_matches(name, '[^\x00-\x7F]') then 0 when regexp_matches(name, '[^\x00-\x7F{X.latin_named()}]') then 2 else 1 end)::bigint as class_sum from ent group by all")  # fmt: skip
def script_mix(spark, sf):
    """Scripts of names by country."""
    e = _entities(spark, sf)
    return e.groupBy("country", X.script(F.col("name")).alias("script")).agg(F.count("*").alias("n"), F.avg(X.not_ascii(F.col("name")).cast("double")).alias("not_ascii"), F.avg(X.is_indic(F.col("name")).cast("double")).alias("indic"), F.sum(X.script_class(F.col("name")).cast("long")).alias("class_sum"))


FORMS = ("SAS", "SARL", "SA", "LLC", "INC", "CO")


@query(f"with {S.ENTITIES} select country, src, count(*) as n, "
       r"avg(regexp_matches(address, '\d')::int::double) as any_digit, avg(regexp_matches(address, '^\s*\d')::int::double) as leading_number, "
       r"avg(regexp_matches(address, '\b\d{5}\b')::int::double) as five_digits, avg(regexp_matches(address, '\b\d{6}\b')::int::double) as six_digits, "
       r"avg(contains(upper(address), 'CEDEX')::int::double) as cedex, avg(regexp_matches(name, '\d')::int::double) as name_digit from ent group by all")  # fmt: skip
def address_profile(spark, sf):
    """Probes of addresses by country and source."""
    probes = X.address_probes(F.col("address")) | {"name_digit": F.col("name").rlike(r"\d")}
    return _entities(spark, sf).groupBy("country", "src").agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in probes.items()])


@query(f"with {S.ENTITIES}, c as (select unnest(string_split(name, '')) as ch from ent) select ch, count(*) as n from c where ch <> '' and not regexp_matches(ch, '[A-Za-z0-9 ]') group by ch order by n desc, ch limit 20")
def top_characters(spark, sf):
    """The twenty most frequent characters of names besides ASCII letters, digits and spaces."""
    chars = _entities(spark, sf).select(F.explode(F.split("name", "")).alias("ch"))
    return chars.where("ch <> '' and not ch rlike '[A-Za-z0-9 ]'").groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(20)


# ---------------------------------------------------------------- blocking


@query(f"with {S.TOKENS} select kind, token, df from freq")
def token_df(spark, sf):
    """How many pool records have each token that a query entity has."""
    s1, pool = _sides(spark, sf)
    return B.frequencies(B.tokens(B.prepare(pool)), B.tokens(B.prepare(s1)))


@query(f"with {S.PREPARED}, bag as (select src, 'N' as kind, unnest(regexp_extract_all(n, '{S.WORD}')) as token from prep union all select src, 'A', unnest(regexp_extract_all(a, '{S.WORD}')) from prep "
       r"union all select src, 'M', unnest(regexp_extract_all(a, '\d{2,}')) from prep union all select src, 'X', fk from prep) "
       "select kind, token, count(*) as df from bag where src <> 'S1' and (kind, token) in (select (kind, token) from bag where src = 'S1') group by all")  # fmt: skip
def token_df_bag(spark, sf):
    """The same with repeated tokens counted as often as they occur."""
    s1, pool = _sides(spark, sf)
    return B.frequencies(B.tokens(B.prepare(pool), bag=True), B.tokens(B.prepare(s1)))


@query(f"with {S.TOKENS} select t.kind, t.token, f.df, list_sort(list(t.entity_id)) as pids from tok t join freq f on t.kind = f.kind and t.token = f.token and f.df <= 50 where t.src <> 'S1' group by all")
def postings(spark, sf):
    """Posting lists of the tokens with at most fifty records."""
    s1, pool = _sides(spark, sf)
    return B.postings(B.tokens(B.prepare(pool)), B.tokens(B.prepare(s1)), 50)


@query(f"with {S.PREPARED}, k as (select fk, count(*) filter (src = 'S1') as n_query, count(*) filter (src <> 'S1') as n_pool from prep group by fk) select case when n_pool = 0 then '0' when n_pool = 1 then '1' when n_pool <= 5 then '2-5' when n_pool <= 50 then '6-50' else '>50' end as bucket, count(*) as keys, sum(n_query)::bigint as n_query, sum(n_pool)::bigint as n_pool from k group by 1")
def exact_buckets(spark, sf):
    """Sizes of the exact keys' buckets, as a histogram."""
    p = B.prepare(_entities(spark, sf))
    k = p.groupBy("fk").agg(F.count_if(F.col("src") == "S1").alias("n_query"), F.count_if(F.col("src") != "S1").alias("n_pool"))
    n = F.col("n_pool")
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 50, "6-50").otherwise(">50")
    return k.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n_query").alias("n_query"), F.sum("n_pool").alias("n_pool"))


@query(f"with {S.evidence(100, 100)} select k1, t1, k2, t2, df from pair_freq")
def pair_key_df(spark, sf):
    """Pair keys of query entities with at most a hundred pool records."""
    s1, pool = _sides(spark, sf)
    return B.pair_frequencies(B.prepare(pool), B.prepare(s1), 100)


def _hits(spark, sf, by_country):
    s1, pool = _sides(spark, sf)
    found = B.evidence(B.prepare(s1), B.prepare(pool), B.Blocking(budget=30, by_country=by_country))
    return found.groupBy("s1_id", "is_solo").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("hits"), F.sum("df").alias("df_sum"))


_HITS = "select s1_id, is_solo, count(distinct key) as keys, count(*) as hits, sum(df)::bigint as df_sum from ev group by all"


@query(f"with {S.evidence(30, 200)} {_HITS}")
def evidence_hits(spark, sf):
    """Admissible keys and hits of each query entity."""
    return _hits(spark, sf, False)


@query(f"with {S.evidence(30, 200, by_country=True)} {_HITS}")
def evidence_hits_by_country(spark, sf):
    """The same with hits of the query's country only; frequencies stay global."""
    return _hits(spark, sf, True)


@query(f"with {S.evidence(100, 200)}, g as (select s1_id, {S.greedy('list(pids order by df, key)', '100')} as c from keyed group by s1_id) select s1_id, unnest(c) as cand_id from g")
def greedy_candidates(spark, sf):
    """Candidates of every query entity within a budget of a hundred."""
    s1, pool = _sides(spark, sf)
    return B.candidates(s1, pool)


@query(f"with {S.evidence(100, 200, by_country=True)}, g as (select s1_id, {S.greedy('list(pids order by df, key)', '100')} as c from keyed group by s1_id) select s1_id, unnest(c) as cand_id from g")
def greedy_candidates_by_country(spark, sf):
    """The same within the query's country."""
    s1, pool = _sides(spark, sf)
    return B.candidates(s1, pool, B.Blocking(by_country=True))


BUDGETS = (10, 25, 50, 100)


def _recall_of(grid: DataFrame, truth: DataFrame) -> DataFrame:
    hit = grid.select("s1_id", "budget", "max_pair", F.explode("cands").alias("cand_id")).join(truth, ["s1_id", "cand_id"]).groupBy("budget", "max_pair").agg(F.count("*").alias("found"))
    sizes = grid.groupBy("budget", "max_pair").agg(F.count("*").alias("entities"), F.sum(F.size("cands").cast("long")).alias("cands"), F.max(F.size("cands").cast("long")).alias("most"))
    return sizes.join(hit, ["budget", "max_pair"], "left").fillna(0, ["found"])


def _grid_sql(budgets, pairs, solo=False):
    top = max(budgets)
    values = ", ".join(f"({b}, {m})" for b in budgets for m in pairs)
    return f"""with {S.evidence(top, max(pairs))}, {S.TRUTH}, grid(budget, max_pair) as (values {values}),
g as (select s1_id, budget, max_pair, list(pids order by df, key) filter ({'is_solo and df <= budget' if solo else 'df <= budget and (is_solo or df <= max_pair)'}) as lists from keyed, grid group by all),
c as (select s1_id, budget, max_pair, case when lists is null then [] else {S.greedy('lists', 'budget')} end as cands from g)
select c.budget::int as budget, c.max_pair::int as max_pair, count(*) as entities, sum(len(cands))::bigint as cands, max(len(cands))::bigint as most,
    coalesce(sum((select count(*) from truth t where t.s1_id = c.s1_id and list_contains(c.cands, t.cand_id))), 0)::bigint as found
from c group by c.budget, c.max_pair"""


@query(_grid_sql(BUDGETS, (200,)))
def budget_recall(spark, sf):
    """E-13: entities, candidates and true pairs found under each budget."""
    s1, pool = _sides(spark, sf)
    return _recall_of(B.candidates_by(s1, pool, BUDGETS), _truth(s1, pool))


@query(_grid_sql((50,), (200,), solo=True))
def budget_recall_solo(spark, sf):
    """E-13's ablation: single tokens and exact keys only; entities that have but pair keys count, without candidates."""
    s1, pool = _sides(spark, sf)
    return _recall_of(B.candidates_by(s1, pool, (50,), solo_only=True), _truth(s1, pool))


@query(_grid_sql((25, 50), (10, 50, 200)))
def pair_limit_grid(spark, sf):
    """E-15: pair-key limits by budgets; a limit from the budget on changes nothing."""
    s1, pool = _sides(spark, sf)
    return _recall_of(B.candidates_by(s1, pool, (25, 50), (10, 50, 200)), _truth(s1, pool))


@query(f"""with {S.evidence(50, 200)}, {S.TRUTH}, g as (select s1_id, {S.greedy('list(pids order by df, key)', '50')} as c from keyed group by s1_id),
s as (select t.s1_id, t.cand_id, bool_or(x.kind <> 'X') as single, bool_or(x.kind = 'X') as exact from truth t join tok x on x.entity_id = t.s1_id join tok y on y.entity_id = t.cand_id and x.kind = y.kind and x.token = y.token group by all)
select t.s1_id, t.cand_id, case when list_contains(g.c, t.cand_id) then 'covered' when exists (select 1 from ev where ev.s1_id = t.s1_id and ev.pid = t.cand_id) then 'capacity'
    when s.single then 'big_single' when s.exact then 'exact_big' else 'no_shared' end as reason
from truth t left join g on g.s1_id = t.s1_id left join s on s.s1_id = t.s1_id and s.cand_id = t.cand_id""")
def miss_autopsy(spark, sf):
    """E-14: why each true pair is, or is not, among fifty candidates."""
    s1, pool = _sides(spark, sf)
    return B.autopsy(s1, pool, _truth(s1, pool))


@query(f"""with {S.evidence(25, 200)}, {S.TRUTH}, g as (select s1_id, {S.greedy('list(pids order by df, key)', '25')} as c from keyed group by s1_id),
r as (select e.country, coalesce(len(g.c), 0) as n, (select count(*) from truth t where t.s1_id = e.entity_id) as t,
    (select count(*) from truth t where t.s1_id = e.entity_id and list_contains(g.c, t.cand_id)) as h from ent e left join g on g.s1_id = e.entity_id where e.src = 'S1')
select case when grouping(country) = 1 then 'ALL' else country end as country, count(*) as entities, sum(t)::bigint as true_pairs, sum(h)::bigint as found_pairs,
    round(sum(h)::double / nullif(sum(t), 0), 6) as recall, round(avg(n), 6) as mean_cands, quantile_cont(n, 0.5) as median_cands, round(quantile_cont(n, 0.99), 6) as p99_cands, max(n)::int as max_cands,
    round(avg((n = 0)::int), 6) as zero_share
from r group by rollup (country)""")
def blocking_recall(spark, sf):
    """E-13 by country: recall, and how many candidates entities have."""
    s1, pool = _sides(spark, sf)
    got = metrics.recall(B.candidates(s1, pool, B.Blocking(budget=25)), _truth(s1, pool), s1)
    return got.withColumns({c: _r(c) for c in ("recall", "mean_cands", "p99_cands", "zero_share")}).withColumn("max_cands", F.col("max_cands").cast("int"))


@query(f"""with {S.evidence(50, 200, by_country=True)}, g as (select s1_id, len({S.greedy('list(pids order by df, key)', '50')}) as n from keyed group by s1_id),
sampled as (select entity_id, country from ent where src = 'S1' qualify row_number() over (partition by country order by {S.rank('entity_id', 5)}) <= 20),
m as (select s.country, avg(coalesce(g.n, 0)) as mean_cands from sampled s left join g on g.s1_id = s.entity_id group by 1),
n as (select country, count(*) as entities from ent where src = 'S1' group by 1)
select m.country, round(mean_cands, 6) as mean_cands, entities, round(mean_cands * entities, 4) as projected from m join n on m.country = n.country
union all select 'ALL', null, sum(entities)::bigint, round(sum(mean_cands * entities), 4) from m join n on m.country = n.country""")
def pool_projection(spark, sf):
    """E-16: candidates of all entities, projected from a stratified sample."""
    s1, pool = _sides(spark, sf)
    sampled = sampling.stratified_sample(s1, "country", "entity_id", 20, 5)
    n = B.candidates(sampled, pool, B.Blocking(budget=50, by_country=True)).groupBy("s1_id").agg(F.count("*").alias("n"))
    mean = sampled.select(F.col("entity_id").alias("s1_id"), "country").join(n, "s1_id", "left").groupBy("country").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_cands"))
    both = mean.join(s1.groupBy("country").agg(F.count("*").alias("entities")), "country")
    total = both.agg(F.sum("entities").alias("entities"), F.sum(F.col("mean_cands") * F.col("entities")).alias("projected"))
    each = both.select("country", _r("mean_cands").alias("mean_cands"), "entities", _r(F.col("mean_cands") * F.col("entities"), 4).alias("projected"))
    return each.unionByName(total.select(F.lit("ALL").alias("country"), F.lit(None).cast("double").alias("mean_cands"), "entities", _r("projected", 4).alias("projected")))


# ---------------------------------------------------------------- features


def _sim(a, b):
    return S.jaccard(a, b)


_STRIPPED = S.strip("{0}.n", X.LEGAL_FORMS)
_FEATURE_SQL = {
    "nexact": "(x.n <> '' and x.n = y.n)::int::double",
    "nexact_suf": f"({_STRIPPED.format('x')} <> '' and {_STRIPPED.format('x')} = {_STRIPPED.format('y')})::int::double",
    "nexact_fold": "(x.n <> '' and x.fk = y.fk)::int::double",
    "pref4_eq": "(length(x.n) >= 4 and length(y.n) >= 4 and x.n[1:4] = y.n[1:4])::int::double",
    "tok_cont": "coalesce(len(list_intersect(x.nt, y.nt))::double / nullif(len(x.nt), 0), 0)",
    "tok_jacc": _sim("x.nt", "y.nt"),
    "acont": "coalesce(len(list_intersect(x.at, y.at))::double / nullif(least(len(x.at), len(y.at)), 0), 0)",
    "ajacc": _sim("x.at", "y.at"),
    "addr_exact": "(x.a <> '' and x.a = y.a)::int::double",
    "addr_missing": "(x.a = '' or y.a = '')::int::double",
    "shared_num2": "list_has_any(x.tm, y.tm)::int::double",
    "shared_num3": r"list_has_any(regexp_extract_all(x.a, '\d{3,}'), regexp_extract_all(y.a, '\d{3,}'))::int::double",
    "both_num": "(len(x.tm) > 0 and len(y.tm) > 0)::int::double",
    "sc_A": S.script_class("x.n"),
    "sc_B": S.script_class("y.n"),
    "sc_diff": f"({S.script_class('x.n')} <> {S.script_class('y.n')})::int::double",
    "lendiff": "abs(length(x.n) - length(y.n))::double / (length(x.n) + length(y.n) + 1)",
    "country_eq": "(coalesce(x.country, '') = coalesce(y.country, ''))::int::double",
    "n_char2_jacc": _sim(S.grams("x.n", 2), S.grams("y.n", 2)),
    "n_char3_jacc": _sim(S.grams("x.n", 3), S.grams("y.n", 3)),
    "first_tok_eq": "(x.n <> '' and string_split(x.n, ' ')[1] = string_split(y.n, ' ')[1])::int::double",
    "addr_pref2_eq": "(length(x.a) >= 2 and length(y.a) >= 2 and x.a[1:2] = y.a[1:2])::int::double",
    "addr_pref5_eq": "(length(x.a) >= 5 and length(y.a) >= 5 and x.a[1:5] = y.a[1:5])::int::double",
    "lognum_sim": "case when len(x.tm) = 0 or len(y.tm) = 0 then 0 else least({0}, {1}) / greatest({0}, {1}) end".format(
        *(rf"ln(1 + regexp_extract_all({k}.a, '\d{{2,}}')[1]::double)" for k in "xy")
    ),
    "a_lendiff": "abs(length(x.a) - length(y.a))::double / (length(x.a) + length(y.a) + 1)",
}
_LISTS = "wide as (select *, list_filter(list_distinct(string_split(n, ' ')), lambda w: w <> '') as nt, list_filter(list_distinct(string_split(a, ' ')), lambda w: w <> '') as at from prep)"


@query(f"with {S.PREPARED}, {_LISTS}, {S.eval_pairs(NEGATIVES, SEED)} select s1_id, cand_id, ep.y, "
       + ", ".join(f"round(({e})::float::double, 5) as {k}" for k, e in _FEATURE_SQL.items())
       + " from ep join wide x on x.entity_id = s1_id join wide y on y.entity_id = cand_id")
def features_native(spark, sf):
    """The pair features that are plain expressions, on true and drawn pairs."""
    s1, pool = _sides(spark, sf)
    got = FT.featurize(_eval_pairs(s1, pool), s1, pool, tuple(k for k in FT.NATIVE if k in _FEATURE_SQL))
    return got.select("s1_id", "cand_id", "y", *[F.round(F.col(k).cast("double"), 5).alias(k) for k in _FEATURE_SQL])


@query(f"""with {S.PREPARED}, {S.eval_pairs(NEGATIVES, SEED)}, given as (
    select s1_id, cand_id from ep where y = 0 union all select s1_id, cand_id || '-gone' from ep where y = 0
    union all select s1_id || '-gone', cand_id from ep where y = 1
), sided as (select 'cand_id' as side, cand_id as entity_id from given union all select 's1_id', s1_id from given)
select side, count(*) as n_pairs, count(*) filter (where p.entity_id is null) as n_absent, count(*) filter (where p.n = '' and p.a = '') as n_blank
from sided left join prep p using (entity_id) group by side""")
def absent_texts(spark, sf):
    """J-04: pairs whose side has no text, over drawn pairs, the same with unknown candidates, and true pairs with unknown query entities."""
    s1, pool = _sides(spark, sf)
    ep = _eval_pairs(s1, pool)
    drawn, true, gone = ep.where("y = 0"), ep.where("y = 1"), F.lit("-gone")
    given = [drawn.select("s1_id", "cand_id"), drawn.select("s1_id", F.concat("cand_id", gone).alias("cand_id")), true.select(F.concat("s1_id", gone).alias("s1_id"), "cand_id")]
    return FT.absent(reduce(DataFrame.unionByName, given), s1, pool)


@query()
def features_all(spark, sf):
    """All 36 features on true and drawn pairs."""
    s1, pool = _sides(spark, sf)
    return FT.featurize(_eval_pairs(s1, pool), s1, pool)


@query(f"with {S.PREPARED}, {S.eval_pairs(NEGATIVES, SEED)} select s1_id, cand_id, round(jaro_winkler_similarity(x.fk, y.fk), 6) as jw from ep join prep x on x.entity_id = s1_id join prep y on y.entity_id = cand_id")
def name_jaro_winkler(spark, sf):
    """Jaro-Winkler similarity of folded names, on true and drawn pairs."""
    s1, pool = _sides(spark, sf)
    j = FT.attach(_eval_pairs(s1, pool), s1, pool)
    return j.select("s1_id", "cand_id", _r(fuzzy.jaro_winkler_column(F.col("s1_side.nf"), F.col("cand_side.nf"))).alias("jw"))


# ---------------------------------------------------------------- labels and samples


@query(f"with {S.ENTITIES}, {S.TRUTH}, l as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from truth group by 1) select e.entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids, coalesce(len(string_split(ids, ',')), 0)::int as n_matches from ent e left join l on l.s1_id = e.entity_id where e.src = 'S1'")
def truth_lists(spark, sf):
    """Ground truth as comma-joined lists, empty ones included, with their lengths."""
    s1, pool = _sides(spark, sf)
    lists = R.assemble(s1, _truth(s1, pool))
    return lists.withColumn("n_matches", R.n_matches(F.col("matched_entity_ids")))


@query(f"with {S.ENTITIES}, {S.TRUTH} select distinct s1_id, cand_id from truth")
def truth_pairs(spark, sf):
    """Lists exploded back into pairs."""
    s1, pool = _sides(spark, sf)
    return R.explode_lists(R.assemble(s1, _truth(s1, pool)))


@query(f"with {S.ENTITIES}, {S.TRUTH}, l as (select string_agg(cand_id, ',') as ids from truth group by s1_id) select case when count(*) filter (contains(ids, ',')) >= 0 then ',' end as separator, count(*) filter (contains(ids, ',')) as n_rows from l")
def list_separator(spark, sf):
    """Which separator the lists use."""
    s1, pool = _sides(spark, sf)
    return R.separator(R.assemble(s1, _truth(s1, pool)), "matched_entity_ids")


@query(f"with {S.SCORED} select s.s1_id, s.cand_id, (t.s1_id is not null)::tinyint as y from scored s left join (select distinct s1_id, cand_id from truth) t on t.s1_id = s.s1_id and t.cand_id = s.cand_id")
def label_pairs(spark, sf):
    """Candidate pairs labelled from the truth."""
    s1, pool = _sides(spark, sf)
    return labels.label(_scored(s1, pool).select("s1_id", "cand_id"), _truth(s1, pool))


@query(f"with {S.PREPARED}, {S.eval_pairs(NEGATIVES, SEED)} select s1_id, cand_id, y from ep")
def training_pairs(spark, sf):
    """True pairs and same-country negatives."""
    s1, pool = _sides(spark, sf)
    return _eval_pairs(s1, pool)


@query(f"with {S.ENTITIES} select entity_id, country from ent order by {S.rank('entity_id', 3)} limit 50")
def hash_sample(spark, sf):
    """Fifty entities without replacement."""
    return sampling.sample(_entities(spark, sf), "entity_id", 50, 3).select("entity_id", "country")


@query(f"with {S.ENTITIES}, {S.TRUTH}, w as (select s1_id, count(*) as n from truth group by 1) select s1_id, n from w order by -ln({S.unit('s1_id', 4)}) / n, s1_id limit 15")
def weighted_sample(spark, sf):
    """Fifteen matched entities, drawn in proportion to their matches."""
    s1, pool = _sides(spark, sf)
    n = _truth(s1, pool).groupBy("s1_id").agg(F.count("*").alias("n"))
    return sampling.weighted_sample(n, "s1_id", "n", 15, 4)


@query(f"with {S.ENTITIES} select entity_id, country from ent qualify row_number() over (partition by country order by {S.rank('entity_id', 5)}) <= 10")
def stratified_sample(spark, sf):
    """Ten entities of each country."""
    return sampling.stratified_sample(_entities(spark, sf), "country", "entity_id", 10, 5).select("entity_id", "country")


@query(f"with {S.ENTITIES} select entity_id as s1_id, {S.unit('entity_id', 0)} < 0.8 as is_train from ent where src = 'S1'")
def group_split(spark, sf):
    """Query entities split for training and validation."""
    s1, _ = _sides(spark, sf)
    return sampling.split(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", 0.8, 0)


# ---------------------------------------------------------------- metrics and models


def _swept(spark, sf, restrict=False):
    s1, pool = _sides(spark, sf)
    grid = metrics.thresholds(0, 100, 5, 100)
    spine = s1.select(F.col("entity_id").alias("s1_id"))
    return metrics.per_entity(_scored(s1, pool), _truth(s1, pool).distinct(), spine, grid, restrict)


def _per_entity_sql(restrict):
    full = "(select s1_id, count(*) as known from tt group by 1)"
    restricted = "(select s.s1_id, count(*) as known from scored s join tt on tt.s1_id = s.s1_id and tt.cand_id = s.cand_id group by 1)"
    return f"""with {S.SCORED}, tt as (select distinct s1_id, cand_id from truth), grid as (select i / 100.0::double as thr from range(0, 101, 5) r(i)),
em as (select thr, s.s1_id, count(*) as predicted, count(tt.cand_id) as tp from grid join scored s on s.score >= thr left join tt on tt.s1_id = s.s1_id and tt.cand_id = s.cand_id group by all),
pe as (select grid.thr, e.entity_id as s1_id, coalesce(predicted, 0) as predicted, coalesce(tp, 0) as tp, coalesce(known, 0) as truth
    from ent e cross join grid left join em on em.thr = grid.thr and em.s1_id = e.entity_id left join {restricted if restrict else full} k on k.s1_id = e.entity_id where e.src = 'S1'),
f as (select *, case when truth = 0 then (predicted = 0)::int::double when tp = 0 then 0.0
    else 1.25 * (tp / predicted::double) * (tp / truth::double) / (0.25 * (tp / predicted::double) + tp / truth::double) end as f from pe)"""


@query(_per_entity_sql(False) + " select thr, s1_id, predicted, tp, truth, round(f, 6) as f from f")
def f05_per_entity(spark, sf):
    """F0.5 of every query entity under every threshold."""
    return _swept(spark, sf).withColumn("f", _r("f"))


_SWEEP = """select thr, round(avg(f), 6) as macro_all, round(avg(f) filter (truth > 0), 6) as macro_matched,
    round(coalesce(sum(tp)::double / nullif(sum(predicted), 0), 1), 6) as micro_p, round(coalesce(sum(tp)::double / nullif(sum(truth), 0), 0), 6) as micro_r,
    count(*) filter (truth = 0 and predicted > 0) as empty_emitting, count(*) filter (truth > 0 and tp = 0) as all_missed,
    round(0.9442 * avg(f) filter (truth > 0) + (1 - 0.9442) * (1 - coalesce(avg((predicted > 0)::int) filter (truth = 0), 0)), 6) as weighted from f group by thr"""


def _rounded(swept):
    return swept.select("thr", *[_r(c).alias(c) for c in ("macro_all", "macro_matched", "micro_p", "micro_r")], "empty_emitting", "all_missed", _r("weighted").alias("weighted"))


@query(_per_entity_sql(False) + " " + _SWEEP)
def f05_sweep(spark, sf):
    """Figures under every threshold, against the full truth."""
    return _rounded(metrics.sweep(_swept(spark, sf)))


@query(_per_entity_sql(True) + " " + _SWEEP)
def f05_sweep_candidates(spark, sf):
    """The same against the truth among the candidates, which flatters recall."""
    return _rounded(metrics.sweep(_swept(spark, sf, restrict=True)))


@query(_per_entity_sql(False) + f", s as ({_SWEEP}) select thr, macro_all from s order by macro_all desc, thr limit 1")
def best_threshold(spark, sf):
    """The threshold with the best macro figure."""
    return metrics.best(_rounded(metrics.sweep(_swept(spark, sf)))).select("thr", "macro_all")


def _written_candidates(s1: DataFrame, pool: DataFrame, b: B.Blocking) -> DataFrame:
    """Candidates by way of written tables, which are gone in the end but for the candidates'."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        return made[-1]

    try:
        query_, rest = (keep(B.prepare(e).select(*B.PREPARED), "prepared") for e in (s1, pool))
        return materialize(B.candidates_of(query_, rest, b, keep), "candidates")
    finally:
        for table in made:
            forget(table)


def _true_of(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Those of the pairs whose texts are equal: no more rows than pairs, however many copies there are."""
    left, right = (e.select(F.col("entity_id").alias(k), F.sha2("text", 256).alias(h)) for e, k, h in ((s1, "s1_id", "x"), (pool, "cand_id", "y")))
    return pairs.join(left, "s1_id").join(right, "cand_id").where("x = y").select("s1_id", "cand_id")


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all query entities with their features, labels and split, written once: learners go
    through them many times."""
    s1, pool = _sides(spark, sf)
    pairs = _written_candidates(s1, pool, B.Blocking(budget=25))
    labelled = settle(labels.label(pairs, _true_of(pairs, s1, pool)), "labelled", pairs)
    return settle(sampling.split(FT.featurize(labelled, s1, pool), "s1_id", 0.8, 0), "features", labelled)


@query()
def model_scores(spark, sf):
    """An ensemble fitted on the training entities' candidates, scoring all of them."""
    made = labelled_features(spark, sf)  # stays, as the result reads it
    rows = labels.class_weight(made)
    fitted = [(model.fit(rows, "gbt", rounds=8), 0.6), (model.fit(rows, "forest", rounds=8), 0.4)]
    return model.score(made.select("s1_id", "cand_id", "y", "is_train", *FT.FEATURES), fitted).select("s1_id", "cand_id", "y", "is_train", "score")


@query()
def score_separation(spark, sf):
    """How far scores of true and other pairs are apart."""
    return model.separation(model_scores(spark, sf))


@query()
def feature_importance(spark, sf):
    """The features' part in a forest, with an alarm for one that decides alone."""
    made = labelled_features(spark, sf)
    try:
        found = model.importances(model.fit(labels.class_weight(made), "forest", rounds=8), FT.FEATURES)
    finally:
        forget(made)
    return spark.createDataFrame(found, "feature string, importance double, alarm boolean")


# ---------------------------------------------------------------- results


@query(f"with {S.SCORED} select s.s1_id, s.cand_id, round(score, 6) as score from scored s join ent x on x.entity_id = s.s1_id join ent y on y.entity_id = s.cand_id where x.country = y.country and score >= 0.1")
def country_filter(spark, sf):
    """Emitted pairs of one country."""
    s1, pool = _sides(spark, sf)
    return postproc.same_country(postproc.emit(_scored(s1, pool), 0.1), s1, pool).select("s1_id", "cand_id", _r("score").alias("score"))


@query(f"with {S.SCORED} select s1_id, cand_id, round(score, 6) as score from scored qualify row_number() over (partition by cand_id order by score desc, s1_id) = 1")
def one_to_one(spark, sf):
    """Each pool entity with its best query entity."""
    s1, pool = _sides(spark, sf)
    return postproc.one_to_one(_scored(s1, pool)).select("s1_id", "cand_id", _r("score").alias("score"))


@query(f"with {S.SCORED}, o as (select s1_id, cand_id from scored where score >= 0.3), l as (select s1_id, string_agg(cand_id, ',' order by cand_id) as ids from o group by 1) select e.entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from ent e left join l on l.s1_id = e.entity_id where e.src = 'S1'")
def assemble_lists(spark, sf):
    """Result lists, empty ones included."""
    s1, pool = _sides(spark, sf)
    return R.assemble(s1, postproc.emit(_scored(s1, pool), 0.3))


@query(f"""with {S.ENTITIES}, rows as (
    select entity_id as key, case when {S.unit('entity_id', 9)} < 0.15 then null when {S.unit('entity_id', 9)} < 0.35 then 'S1-0,S2-x,S2-x,Q9' else 'S2-1' end as ids from ent where src = 'S1'
    union all select min(entity_id), '' from ent where src = 'S1' union all select 'S1-new', ''
), ex as (select key, unnest(string_split(ids, ',')) as id from rows where ids is not null and ids <> ''), known as (select entity_id as id from ent where src <> 'S1'),
f as (
    select 'malformed_row' as rule, key as v from rows where ids is null
    union all select 'duplicate_key', key from rows where ids is not null group by key having count(*) > 1
    union all select 'duplicate_id_in_list', key from (select key, id from ex group by all having count(*) > 1)
    union all select 'self_match', id from ex where starts_with(id, 'S1-')
    union all select 'wrong_prefix', id from ex where not regexp_matches(id, '^S[123]-')
    union all select distinct 'unknown_id', id from ex where regexp_matches(id, '^S[23]-') and id not in (select id from known)
    union all select distinct 'missing_key', entity_id from ent where src = 'S1' and entity_id not in (select key from rows where ids is not null)
    union all select distinct 'unexpected_key', key from rows where ids is not null and key not in (select entity_id from ent where src = 'S1')
) select rule, 'error' as severity, count(*) as n, list_sort(list(distinct v))[1:5] as examples from f group by rule""")
def validate_results(spark, sf):
    """Findings on a result table with every kind of fault."""
    s1, pool = _sides(spark, sf)
    u = sampling.unit(F.col("entity_id"), 9)
    made = s1.select(F.col("entity_id").alias("key"), F.when(u < 0.15, F.lit(None)).when(u < 0.35, "S1-0,S2-x,S2-x,Q9").otherwise("S2-1").alias("ids"))
    made = made.unionByName(s1.agg(F.min("entity_id").alias("key")).withColumn("ids", F.lit(""))).unionByName(spark.createDataFrame([("S1-new", "")], "key string, ids string"))
    return validate.lists(made, pool.select(F.col("entity_id").alias("id")), s1.select(F.col("entity_id").alias("id")))


@query(f"with {S.SCORED}, m as (select distinct s1_id, cand_id from scored), k as (select distinct s1_id, cand_id from scored where score >= 0.2), o as (select s1_id || ' -> ' || cand_id as v from m anti join k on k.s1_id = m.s1_id and k.cand_id = m.cand_id) select 'match_not_candidate' as rule, 'warning' as severity, count(*) as n, list_sort(list(v))[1:5] as examples from o having count(*) > 0")
def matches_outside_candidates(spark, sf):
    """Pairs among the matches that were no candidates."""
    s1, pool = _sides(spark, sf)
    every = _scored(s1, pool)
    return validate.subset(every, every.where("score >= 0.2"))


# ---------------------------------------------------------------- profiles


_SIGNALS = f"""with {S.PREPARED}, {_LISTS}, {S.eval_pairs(NEGATIVES, SEED)},
sig as (select ep.s1_id, ep.cand_id, ep.y, x.country, {S.script('x.name')} as sx, {S.script('y.name')} as sy, x.n = y.n as name_exact, {_sim('x.nt', 'y.nt')} as name_jacc,
    len(x.at) = 0 or len(y.at) = 0 as addr_miss, {_sim('x.at', 'y.at')} as addr_jacc, {_FEATURE_SQL['acont']} as addr_cont, x.a = y.a as addr_exact,
    list_has_any(regexp_extract_all(x.a, '\\d+'), regexp_extract_all(y.a, '\\d+')) as any_num, list_has_any(regexp_extract_all(x.a, '\\d{{4,}}'), regexp_extract_all(y.a, '\\d{{4,}}')) as num4,
    {S.strip('x.n', X.LEGAL_FORMS)} = {S.strip('y.n', X.LEGAL_FORMS)} as strip_exact,
    length(x.n) > 0 and x.n[1:4] = y.n[1:4] as pref4, list_has_any(list_filter(x.nt, lambda w: length(w) >= 3), list_filter(y.nt, lambda w: length(w) >= 3)) as token,
    list_has_any(x.tm, y.tm) as num2
from ep join wide x on x.entity_id = ep.s1_id join wide y on y.entity_id = ep.cand_id)"""


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    s1, pool = _sides(spark, sf)
    names = _entities(spark, sf).select(F.col("entity_id").alias("id"), X.script(F.col("name")).alias("s"))
    j = FT.attach(_eval_pairs(s1, pool), s1, pool)
    j = j.join(names.select(F.col("id").alias("s1_id"), F.col("s").alias("sx")), "s1_id").join(names.select(F.col("id").alias("cand_id"), F.col("s").alias("sy")), "cand_id")
    x, y = (lambda k: F.col("s1_side").getField(k)), (lambda k: F.col("cand_side").getField(k))

    def long(c):
        return F.filter(c, lambda w: F.char_length(w) >= 3)

    return j.select(
        "s1_id", "cand_id", "y", x("country").alias("country"), "sx", "sy",
        (x("n") == y("n")).alias("name_exact"), X.jaccard(x("nt"), y("nt")).alias("name_jacc"),
        ((F.size(x("at")) == 0) | (F.size(y("at")) == 0)).alias("addr_miss"), X.jaccard(x("at"), y("at")).alias("addr_jacc"),
        X.containment(x("at"), y("at")).alias("addr_cont"), (x("a") == y("a")).alias("addr_exact"),
        F.arrays_overlap(X.numbers(x("a"), 1), X.numbers(y("a"), 1)).alias("any_num"), F.arrays_overlap(X.numbers(x("a"), 4), X.numbers(y("a"), 4)).alias("num4"),
        (x("ns") == y("ns")).alias("strip_exact"), ((F.char_length(x("n")) > 0) & (F.left(x("n"), F.lit(4)) == F.left(y("n"), F.lit(4)))).alias("pref4"),
        F.arrays_overlap(long(x("nt")), long(y("nt"))).alias("token"), F.arrays_overlap(x("a2"), y("a2")).alias("num2"),
    )


def _share(c):
    return _r(F.avg(F.col(c).cast("double") if isinstance(c, str) else c.cast("double")))


def _avg(c: str) -> str:
    return f"round(avg(({c})::int::double), 6)"


@query(_SIGNALS + f""" select y, count(*) as n, {_avg('name_exact')} as name_exact, {_avg('addr_miss')} as addr_missing, {_avg('addr_exact')} as addr_exact,
    round(quantile_cont(name_jacc, 0.05), 6) as jacc_05, round(quantile_cont(name_jacc, 0.5), 6) as jacc_50, round(quantile_cont(name_jacc, 0.95), 6) as jacc_95,
    {_avg('name_jacc >= 0.6 and addr_jacc >= 0.5')} as both_high, {_avg('name_jacc >= 0.6 and addr_jacc < 0.5 and not addr_miss')} as name_high,
    {_avg('name_jacc < 0.6 and addr_jacc >= 0.5')} as addr_high, {_avg('name_jacc < 0.6 and addr_jacc < 0.5 and not addr_miss')} as both_low from sig group by y""")
def e01_signal_quadrants(spark, sf):
    """E-01: name and address signals of true and other pairs, their quantiles and quadrants."""
    s = _signals(spark, sf)
    nh, ah, present = F.col("name_jacc") >= 0.6, F.col("addr_jacc") >= 0.5, ~F.col("addr_miss")
    q = [_r(F.percentile("name_jacc", p)).alias(f"jacc_{k}") for p, k in ((0.05, "05"), (0.5, "50"), (0.95, "95"))]
    return s.groupBy("y").agg(F.count("*").alias("n"), _share("name_exact").alias("name_exact"), _share("addr_miss").alias("addr_missing"), _share("addr_exact").alias("addr_exact"), *q, _share(nh & ah).alias("both_high"), _share(nh & ~ah & present).alias("name_high"), _share(~nh & ah).alias("addr_high"), _share(~nh & ~ah & present).alias("both_low"))


@query(_SIGNALS + """, b as (select *, case when y = 1 and name_jacc < 0.4 and not addr_miss and addr_jacc < 0.4 then 'A' when y = 1 and name_jacc < 0.4 and addr_jacc >= 0.6 then 'B'
    when y = 0 and name_jacc >= 0.6 then 'C' when y = 1 and name_jacc < 0.1 and addr_miss then 'D' else 'rest' end as bucket from sig)
select y, bucket, count(*) as n, round(avg(num4::int), 6) as share_num4, round(avg(any_num::int), 6) as share_any_num from b group by all""")
def e02_hard_core(spark, sf):
    """E-02: pairs that names or addresses get wrong, and how often a number would save them."""
    y, nj, aj, miss = F.col("y"), F.col("name_jacc"), F.col("addr_jacc"), F.col("addr_miss")
    bucket = F.when((y == 1) & (nj < 0.4) & ~miss & (aj < 0.4), "A").when((y == 1) & (nj < 0.4) & (aj >= 0.6), "B").when((y == 0) & (nj >= 0.6), "C").when((y == 1) & (nj < 0.1) & miss, "D").otherwise("rest")
    return _signals(spark, sf).groupBy("y", bucket.alias("bucket")).agg(F.count("*").alias("n"), _share("num4").alias("share_num4"), _share("any_num").alias("share_any_num"))


@query(_SIGNALS + f""" select y, country, {_avg('sx <> sy')} as cross_script, {_avg('addr_cont >= 0.9')} as cont_90, {_avg('addr_cont = 1')} as cont_1,
    round(quantile_cont(addr_cont, 0.5), 6) as cont_50, round(quantile_cont(addr_jacc, 0.5), 6) as jacc_50, {_avg('strip_exact and not name_exact')} as strip_gain, {_avg('any_num')} as any_num from sig group by all""")
def e03_scripts_and_containment(spark, sf):
    """E-03: scripts across pairs, address containment beside Jaccard, what stripping adds."""
    return _signals(spark, sf).groupBy("y", "country").agg(
        _share(F.col("sx") != F.col("sy")).alias("cross_script"), _share(F.col("addr_cont") >= 0.9).alias("cont_90"), _share(F.col("addr_cont") == 1).alias("cont_1"),
        _r(F.percentile("addr_cont", 0.5)).alias("cont_50"), _r(F.percentile("addr_jacc", 0.5)).alias("jacc_50"), _share(F.col("strip_exact") & ~F.col("name_exact")).alias("strip_gain"), _share("any_num").alias("any_num"),
    )


@query(_SIGNALS + f""" select y, {_avg('sx = sy and name_jacc >= 0.6')} as r1, {_avg('addr_cont >= 0.9')} as r2, {_avg('any_num')} as r3,
    {_avg('(sx = sy and name_jacc >= 0.6) or addr_cont >= 0.9')} as u12, {_avg('(sx = sy and name_jacc >= 0.6) or addr_cont >= 0.9 or any_num')} as u123 from sig group by y""")
def e04_rule_coverage(spark, sf):
    """E-04: coverage of a name rule, an address rule and a number rule, and of their unions."""
    r1, r2, r3 = (F.col("sx") == F.col("sy")) & (F.col("name_jacc") >= 0.6), F.col("addr_cont") >= 0.9, F.col("any_num")
    return _signals(spark, sf).groupBy("y").agg(_share(r1).alias("r1"), _share(r2).alias("r2"), _share(r3).alias("r3"), _share(r1 | r2).alias("u12"), _share(r1 | r2 | r3).alias("u123"))


@query(f"""with {S.ENTITIES}, d as (select src, name, address, country, count(*) as n, count(distinct entity_id) as ids from ent group by src, name, address, country)
select src, sum(n)::bigint as rows, sum(n) filter (n > 1)::bigint as in_duplicates, bool_and(n = ids) as unique_ids from d group by src""")
def e05_duplicates(spark, sf):
    """E-05: unique ids and rows in groups of exact copies."""
    d = _entities(spark, sf).groupBy("src", "name", "address", "country").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("ids"))
    return d.groupBy("src").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("in_duplicates"), F.bool_and(F.col("n") == F.col("ids")).alias("unique_ids"))


@query(f"""with {S.PREPARED}, k as (select src, country || '|' || {S.strip('n', X.LEGAL_FORMS)} as key from prep)
select 'S2 in S3' as what, round(avg((key in (select key from k where src = 'S3'))::int), 6) as share from k where src = 'S2' union all
select 'S3 in S2', round(avg((key in (select key from k where src = 'S2'))::int), 6) from k where src = 'S3' union all
select 'S1 in S2 or S3', round(avg((key in (select key from k where src <> 'S1'))::int), 6) from k where src = 'S1'""")
def e05_source_overlap(spark, sf):
    """E-05: keys of one source that another has, too."""
    e = _entities(spark, sf).select("src", F.concat("country", F.lit("|"), X.strip_suffix(X.norm(F.col("name")))).alias("key"))

    def share(what, mine, theirs):
        other = e.where(theirs).select(F.col("key").alias("k")).distinct().withColumn("hit", F.lit(1.0))
        return e.where(mine).join(other, F.col("key") == F.col("k"), "left").agg(_r(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("share")).select(F.lit(what).alias("what"), "share")

    return share("S2 in S3", "src = 'S2'", "src = 'S3'").unionByName(share("S3 in S2", "src = 'S3'", "src = 'S2'")).unionByName(share("S1 in S2 or S3", "src = 'S1'", "src <> 'S1'"))


@query(f"with {S.PREPARED}, {S.TRUTH} select t.s1_id, count(*) as n, count(distinct p.n) as distinct_names, count(*) filter (p.src = 'S2') as n_s2, count(*) filter (p.src = 'S3') as n_s3 from truth t join prep p on p.entity_id = t.cand_id group by 1")
def e05_match_diversity(spark, sf):
    """E-05: how many names and sources the matches of an entity have."""
    s1, pool = _sides(spark, sf)
    names = pool.select(F.col("entity_id").alias("cand_id"), X.norm(F.col("name")).alias("n0"), "src")
    return _truth(s1, pool).join(names, "cand_id").groupBy("s1_id").agg(F.count("*").alias("n"), F.countDistinct("n0").alias("distinct_names"), F.count_if(F.col("src") == "S2").alias("n_s2"), F.count_if(F.col("src") == "S3").alias("n_s3"))


@query(rf"""with {S.PREPARED} select src, country, count(*) as n, {_avg("name is null")} as null_name, {_avg(S.ascii_norm("name") + " = ''")} as old_empty, {_avg("n = ''")} as new_empty,
    {_avg("regexp_matches(name, '[^\x00-\x7F]')")} as not_ascii, """ + ", ".join(_avg(f"list_contains(string_split({S.norm('name', ' ')}, ' '), '{f}')") + f" as has_{f.lower()}" for f in FORMS) + " from prep group by all")
def e06_structure(spark, sf):
    """E-06: countries, nulls, names that a normalization empties, scripts and legal forms."""
    n = F.col("name")
    forms = [_share(F.array_contains(F.split(X.norm_space(n), " "), f)).alias(f"has_{f.lower()}") for f in FORMS]
    return _entities(spark, sf).groupBy("src", "country").agg(F.count("*").alias("n"), _share(n.isNull()).alias("null_name"), _share(X.norm_ascii(n) == "").alias("old_empty"), _share(X.norm(n) == "").alias("new_empty"), _share(X.not_ascii(n)).alias("not_ascii"), *forms)


_KEYS = {"exact": "name_exact", "strip": "strip_exact", "pref4": "pref4", "token": "token", "num1": "any_num", "num2": "num2", "u1": "strip_exact or token or num2", "u2": "name_exact or token or any_num"}


@query(_SIGNALS + " select y, country, count(*) as n, " + ", ".join(f"{_avg(c)} as {k}" for k, c in _KEYS.items()) + " from sig group by all")
def e08_key_scorecard(spark, sf):
    """E-08: how many true and other pairs each blocking key joins, by country."""
    return _signals(spark, sf).groupBy("y", "country").agg(F.count("*").alias("n"), *[_share(F.expr(c)).alias(k) for k, c in _KEYS.items()])


@query(f"""with {S.PREPARED}, keys as (
    select entity_id, src, 'exact' as label, country || '|' || n as k from prep union all
    select entity_id, src, 'strip', country || '|' || {S.strip('n', X.LEGAL_FORMS)} from prep union all
    select entity_id, src, 'pref4', country || '|' || n[1:4] from prep
), sizes as (select label, k, count(*) filter (src <> 'S1') as size from keys group by all), s as (
    select q.label, coalesce(z.size, 0) as size from keys q left join sizes z on z.label = q.label and z.k = q.k where q.src = 'S1'
), big as (select label, coalesce(sum(size) filter (size > 50), 0)::bigint as big_rows from sizes group by 1)
select s.label, {_avg('size > 0')} as present, quantile_cont(size, 0.5) as median, round(quantile_cont(size, 0.9), 6) as p90, round(quantile_cont(size, 0.99), 6) as p99, max(size) as most, sum(size)::bigint as pairs, any_value(big_rows) as big_rows
from s join big on big.label = s.label group by s.label""")
def e09_selectivity(spark, sf):
    """E-09: bucket sizes of exact, stripped and prefix keys, counted over both pool sources at once."""
    n = X.norm(F.col("name"))
    kinds = {"exact": n, "strip": X.strip_suffix(n), "pref4": F.left(n, F.lit(4))}
    keys = _entities(spark, sf).select("src", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.concat("country", F.lit("|"), c).alias("k")) for k, c in kinds.items()])).alias("t")).select("src", "t.label", "t.k")
    sizes = keys.groupBy("label", "k").agg(F.count_if(F.col("src") != "S1").alias("size"))
    big = sizes.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("size") > 50, F.col("size"))), F.lit(0)).alias("big_rows"))
    mine = keys.where("src = 'S1'").join(sizes, ["label", "k"]).groupBy("label").agg(
        _share(F.col("size") > 0).alias("present"), F.percentile("size", 0.5).alias("median"), _r(F.percentile("size", 0.9)).alias("p90"), _r(F.percentile("size", 0.99)).alias("p99"), F.max("size").alias("most"), F.sum("size").alias("pairs"),
    )
    return mine.join(big, "label")


@query(f"with {S.PREPARED}, k as (select n, count(*) as size from prep where src <> 'S1' group by 1) select n, size from k order by size desc, n limit 5")
def topk_buckets(spark, sf):
    """E-09: the largest buckets."""
    _, pool = _sides(spark, sf)
    return pool.groupBy(X.norm(F.col("name")).alias("n")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "n").limit(5)


@query(f"""with {S.TOKENS}, d as (select kind, token, count(*) as df from tok where src <> 'S1' and kind <> 'X' group by all)
select kind, count(*) as vocabulary, max(df) as most, round(quantile_cont(df, 0.99), 6) as p99, count(*) filter (df = 1) as hapax, sum(df)::bigint as postings from d group by kind""")
def e09_vocabulary(spark, sf):
    """E-09: the pool's vocabulary and its frequencies."""
    _, pool = _sides(spark, sf)
    d = B.tokens(B.prepare(pool)).where("kind <> 'X'").groupBy("kind", "token").agg(F.count("*").alias("df"))
    return d.groupBy("kind").agg(F.count("*").alias("vocabulary"), F.max("df").alias("most"), _r(F.percentile("df", 0.99)).alias("p99"), F.count_if(F.col("df") == 1).alias("hapax"), F.sum("df").alias("postings"))


def _token_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation pairs with, for each kind, how many tokens they share and the least frequency of one."""
    s1, pool = _sides(spark, sf)
    pairs = _eval_pairs(s1, pool)
    prepared = B.prepare(_entities(spark, sf))
    tokens = B.tokens(prepared)
    df = B.frequencies(B.tokens(B.prepare(pool)), B.tokens(B.prepare(s1)))
    mine = tokens.select(F.col("entity_id").alias("s1_id"), "kind", "token").join(pairs.select("s1_id", "cand_id"), "s1_id")
    theirs = tokens.select(F.col("entity_id").alias("cand_id"), "kind", "token")
    shared = mine.join(theirs, ["cand_id", "kind", "token"]).join(df, ["kind", "token"])

    def of(kind, f, c):
        return f(F.when(F.col("kind") == kind, c))

    per = shared.groupBy("s1_id", "cand_id").agg(
        *[of(k, F.count, F.col("token")).alias(f"c{k.lower()}") for k in "NAMX"], *[of(k, F.min, F.col("df")).alias(f"m{k.lower()}") for k in "NAM"]
    )
    return pairs.join(per, ["s1_id", "cand_id"], "left").fillna(0, ["cn", "ca", "cm", "cx"]).join(prepared.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")


_TOKEN_SIGNALS = f"""with {S.TOKENS}, {S.eval_pairs(NEGATIVES, SEED)}, sh as (
    select ep.s1_id, ep.cand_id, x.kind, x.token, f.df from ep join tok x on x.entity_id = ep.s1_id join tok z on z.entity_id = ep.cand_id and z.kind = x.kind and z.token = x.token
    join freq f on f.kind = x.kind and f.token = x.token
), per as (select s1_id, cand_id, {", ".join(f"count(*) filter (kind = '{k}') as c{k.lower()}" for k in "NAMX")}, {", ".join(f"min(df) filter (kind = '{k}') as m{k.lower()}" for k in "NAM")} from sh group by all),
ts as (select ep.*, e.country, {", ".join(f"coalesce(c{k}, 0) as c{k}" for k in "namx")}, mn, ma, mm from ep left join per on per.s1_id = ep.s1_id and per.cand_id = ep.cand_id join ent e on e.entity_id = ep.s1_id)"""


def _capped(n: int, a: int, m: int) -> str:
    return f"coalesce(mn <= {n}, false) or coalesce(ma <= {a}, false) or coalesce(mm <= {m}, false) or cx > 0"


_UNIONS = {"u_uncapped": "cn > 0 or ca > 0 or cm > 0 or cx > 0", "u_strict": _capped(30, 30, 10), "u_loose": _capped(100, 100, 100)}


@query(_TOKEN_SIGNALS + " select y, country, count(*) as n, " + ", ".join(f"{_avg(c)} as {k}" for k, c in _UNIONS.items()) + " from ts group by all")
def e10_capped_unions(spark, sf):
    """E-10: pairs that share a token under a cap on its frequency, by country."""
    return _token_signals(spark, sf).groupBy("y", "country").agg(F.count("*").alias("n"), *[_share(F.expr(c)).alias(k) for k, c in _UNIONS.items()])


@query(f"""with {S.PREPARED}, {", ".join(f"{k} as (select w, count(*) as df from (select unnest(w) as w from {src}) group by 1)" for k, src in (("r", "(select tn as w from prep where src <> 'S1')"), ("d", "(select distinct n, list_sort(tn) as w from prep where src <> 'S1')")))}
select count(*) as tokens, sum(r.df)::bigint as record_df, sum(d.df)::bigint as string_df, round(sum(r.df) / sum(d.df)::double, 6) as ratio from r join d on r.w = d.w""")
def e10_df_scopes(spark, sf):
    """E-10: frequencies over records beside those over distinct strings, which are too low."""
    _, pool = _sides(spark, sf)
    p = B.prepare(pool)
    record = p.select(F.explode(F.array_distinct("tn")).alias("w")).groupBy("w").agg(F.count("*").alias("r"))
    string = p.select("sn", F.array_distinct("tn").alias("t")).distinct().select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("d"))
    return record.join(string, "w").agg(F.count("*").alias("tokens"), F.sum("r").alias("record_df"), F.sum("d").alias("string_df"), _r(F.sum("r") / F.sum("d")).alias("ratio"))


CAPS = (1, 3, 10, 30, 100, 300, 1000)


@query(_TOKEN_SIGNALS + f""", caps(cap) as (values {", ".join(f"({c})" for c in CAPS)}), own as (
    select c.cap, q.entity_id, coalesce(sum(f.df) filter (f.df <= c.cap), 0) as cost from caps c cross join (select distinct entity_id from tok where src = 'S1') q
    left join tok t on t.entity_id = q.entity_id and t.kind <> 'X' left join freq f on f.kind = t.kind and f.token = t.token group by all
), cost as (select cap, round(avg(cost), 6) as mean_cost, round(quantile_cont(cost, 0.99), 6) as p99_cost, {_avg('cost = 0')} as zero_share from own group by cap)
select caps.cap, round(avg((coalesce(mn <= caps.cap, false) or coalesce(ma <= caps.cap, false) or coalesce(mm <= caps.cap, false) or cx > 0)::int) filter (y = 1), 6) as pos_recall,
    round(avg((coalesce(mn <= caps.cap, false) or coalesce(ma <= caps.cap, false) or coalesce(mm <= caps.cap, false) or cx > 0)::int) filter (y = 0), 6) as neg_rate,
    any_value(mean_cost) as mean_cost, any_value(p99_cost) as p99_cost, any_value(zero_share) as zero_share from ts cross join caps join cost on cost.cap = caps.cap group by caps.cap""")
def e11_cap_sweep(spark, sf):
    """E-11: recall and cost of frequency caps; the caps are a table beside the pairs."""
    s1, pool = _sides(spark, sf)
    caps = F.explode(F.array(*map(F.lit, CAPS))).alias("cap")
    hit = F.coalesce(F.least("mn", "ma", "mm") <= F.col("cap"), F.lit(False)) | (F.col("cx") > 0)
    rates = _token_signals(spark, sf).select("*", caps).groupBy("cap").agg(_r(F.avg(F.when(F.col("y") == 1, hit.cast("double")))).alias("pos_recall"), _r(F.avg(F.when(F.col("y") == 0, hit.cast("double")))).alias("neg_rate"))
    mine = B.tokens(B.prepare(s1))
    df = B.frequencies(B.tokens(B.prepare(pool)), mine)
    own = s1.select("entity_id", caps).join(mine.where("kind <> 'X'").join(df, ["kind", "token"]).select("entity_id", "df"), "entity_id", "left")
    cost = own.groupBy("cap", "entity_id").agg(F.coalesce(F.sum(F.when(F.col("df") <= F.col("cap"), F.col("df"))), F.lit(0)).alias("cost"))
    return rates.join(cost.groupBy("cap").agg(_r(F.avg("cost")).alias("mean_cost"), _r(F.percentile("cost", 0.99)).alias("p99_cost"), _share(F.col("cost") == 0).alias("zero_share")), "cap")


_FAMILIES = {"n2": "cn >= 2", "a2": "ca >= 2", "m2": "cm >= 2", "na": "cn >= 1 and ca >= 1", "nm": "cn >= 1 and cm >= 1", "am": "ca >= 1 and cm >= 1"}
_FAMILIES["u_pair"] = " or ".join(f"({c})" for c in _FAMILIES.values())
_FAMILIES["u_pair_exact"] = f"{_FAMILIES['u_pair']} or cx > 0"


@query(_TOKEN_SIGNALS + " select y, count(*) as n, round(avg(cn), 6) as mean_names, " + ", ".join(f"{_avg(c)} as {k}" for k, c in _FAMILIES.items()) + " from ts group by y")
def e12_pair_key_ceilings(spark, sf):
    """E-12: the most that pair keys of each family could find."""
    return _token_signals(spark, sf).groupBy("y").agg(F.count("*").alias("n"), _r(F.avg("cn")).alias("mean_names"), *[_share(F.expr(c)).alias(k) for k, c in _FAMILIES.items()])
