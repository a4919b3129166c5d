"""Candidate generation: token postings, pair keys, and a budgeted greedy choice of keys.

An entity has tokens of three kinds: words of its name (N), words of its address (A), numbers of
its address (M); and one exact key, its folded name (X). A key is one token, or two tokens of one
entity. The pool records that have a key are its hits, and their number is the key's frequency.
For each query entity, keys are taken from the rarest on; a key is admitted whole, if the union of
hits stays within the budget, or skipped.

Frequencies are counted before hits are gathered: a key beyond the budget can't be admitted, so
the records of common tokens are never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KINDS = ("N", "A", "M")


@dataclass(frozen=True)
class Blocking:
    """budget: most candidates of a query entity. max_pair: most hits of a pair key. by_country: keep
    hits of the query's country; frequencies stay global. bag: a repeated token counts as often as
    it occurs. solo_only: no pair keys."""

    budget: int = 100
    max_pair: int = 200
    by_country: bool = False
    bag: bool = False
    solo_only: bool = False


#: what blocking needs of a prepared entity
PREPARED = ("entity_id", "country", "fk", "tn", "ta", "tm")


def prepare(e: DataFrame) -> DataFrame:
    """Entities with their normalized name, folded key and token lists."""
    name = X.norm(F.col("name"))
    return e.withColumn("sn", F.when(F.col("name").isNotNull(), name)).withColumns(
        {"fk": X.fold(F.col("sn")), "tn": X.words(F.col("sn")), "ta": X.words(X.norm(F.col("address"))), "tm": X.numbers(X.norm(F.col("address")))}
    )


def tokens(prepared: DataFrame, bag: bool = False) -> DataFrame:
    """(entity_id, country, kind, token), exact keys included as kind X. Distinct within an entity,
    unless bag."""

    def one(kind: str, column: str) -> Column:
        each = F.col(column) if bag else F.array_distinct(column)
        return F.transform(each, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    exact = F.when(F.col("fk").isNotNull(), F.array(F.struct(F.lit("X").alias("kind"), F.col("fk").alias("token")))).otherwise(F.array().cast("array<struct<kind:string,token:string>>"))
    every = F.concat(one("N", "tn"), one("A", "ta"), one("M", "tm"), exact)
    return prepared.select("entity_id", "country", F.explode(every).alias("t")).select("entity_id", "country", "t.kind", "t.token")


def universe(query_tokens: DataFrame) -> DataFrame:
    """The distinct tokens that any query entity has."""
    return query_tokens.select("kind", "token").distinct()


def frequencies(pool_tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """(kind, token, df) of the pool's tokens that a query entity has. The semi-join comes first, so
    the pool's other tokens are dropped before they are grouped."""
    return pool_tokens.join(universe(query_tokens), ["kind", "token"], "left_semi").groupBy("kind", "token").agg(F.count("*").alias("df"))


def postings(pool_tokens: DataFrame, query_tokens: DataFrame, most: int) -> DataFrame:
    """(kind, token, df, pids): sorted records of every token with at most `most` of them."""
    rare = frequencies(pool_tokens, query_tokens).where(F.col("df") <= most)
    return pool_tokens.join(rare, ["kind", "token"]).groupBy("kind", "token", "df").agg(F.sort_array(F.collect_list("entity_id")).alias("pids"))


def token_pairs(prepared: DataFrame) -> DataFrame:
    """(entity_id, country, k1, t1, k2, t2): all pairs of distinct tokens, within a kind or across
    kinds N-A, N-M and A-M, the lesser first."""

    def one(rank: int, kind: str, column: str) -> Column:
        return F.transform(F.array_distinct(column), lambda t: F.struct(F.lit(rank).alias("o"), F.lit(kind).alias("k"), t.alias("t")))

    every = F.concat(*[one(i, k, c) for i, (k, c) in enumerate(zip(KINDS, ("tn", "ta", "tm"), strict=True))])
    one = prepared.select("entity_id", "country", F.array_sort(every).alias("every"))
    first = one.select("entity_id", "country", F.posexplode("every").alias("i", "a"), "every")
    # the rest of the sorted list: each pair once, and none with itself
    rest = F.slice("every", F.col("i") + 2, F.size("every"))
    return first.select("entity_id", "country", "a", F.explode(rest).alias("b")).select("entity_id", "country", F.col("a.k").alias("k1"), F.col("a.t").alias("t1"), F.col("b.k").alias("k2"), F.col("b.t").alias("t2"))


_PAIR = ["k1", "t1", "k2", "t2"]


def pair_frequencies(pool: DataFrame, query: DataFrame, most: int) -> DataFrame:
    """(k1, t1, k2, t2, df) with at most `most` records, for the pairs that a query entity has.

    Pool records are first reduced to tokens that queries have, so pairs are only made of those.
    """
    return _pair_frequencies(_known(pool, query), query, most)


def _pair_frequencies(known: DataFrame, query: DataFrame, most: int) -> DataFrame:
    wanted = token_pairs(query).select(*_PAIR).distinct()
    return token_pairs(known).join(wanted, _PAIR, "left_semi").groupBy(*_PAIR).agg(F.count("*").alias("df")).where(F.col("df") <= most)


def _known(pool: DataFrame, query: DataFrame) -> DataFrame:
    """Pool records with only the tokens that some query entity has."""
    known = tokens(pool).join(universe(tokens(query)), ["kind", "token"], "left_semi")
    sets = [F.collect_set(F.when(F.col("kind") == k, F.col("token"))).alias(c) for k, c in zip(KINDS, ("tn", "ta", "tm"), strict=True)]
    return known.where("kind <> 'X'").groupBy("entity_id", "country").agg(*sets)


#: what takes a table that is read more than once, and its name, and may write it
Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def evidence(query: DataFrame, pool: DataFrame, b: Blocking, keep: Keep = _as_is) -> DataFrame:
    """(s1_id, country, key, is_solo, df, pid, p_country): the records of every admissible key of
    every query entity. query, pool: prepared. Hits of other countries are dropped if b.by_country."""
    most = b.budget
    pool_tokens, query_tokens = tokens(pool, b.bag), tokens(query).select("entity_id", "country", "kind", "token")
    rare = frequencies(pool_tokens, query_tokens).where(F.col("df") <= most)
    hits = pool_tokens.join(rare, ["kind", "token"]).select("kind", "token", "df", F.col("entity_id").alias("pid"), F.col("country").alias("p_country"))
    solo = query_tokens.join(hits, ["kind", "token"]).select(
        F.col("entity_id").alias("s1_id"), "country", F.concat_ws(":", "kind", "token").alias("key"), F.lit(True).alias("is_solo"), "df", "pid", "p_country"
    )
    out = solo
    if not b.solo_only:
        known = keep(_known(pool, query), "known")
        rare_pairs = keep(_pair_frequencies(known, query, min(b.max_pair, most)), "rare-pairs")
        pair_hits = token_pairs(known).join(rare_pairs, _PAIR).select(*_PAIR, "df", F.col("entity_id").alias("pid"), F.col("country").alias("p_country"))
        key = F.concat_ws("+", F.concat_ws(":", "k1", "t1"), F.concat_ws(":", "k2", "t2"))
        pairs = token_pairs(query).join(pair_hits, _PAIR).select(F.col("entity_id").alias("s1_id"), "country", key.alias("key"), F.lit(False).alias("is_solo"), "df", "pid", "p_country")
        out = solo.unionByName(pairs)
    return out.where(F.col("country") == F.col("p_country")) if b.by_country else out


def paired(query: DataFrame, pool: DataFrame, b: Blocking) -> DataFrame:
    """(s1_id): the query entities with an admissible pair key, whose records are not gathered."""
    rare = pair_frequencies(pool, query, min(b.max_pair, b.budget))
    on = _PAIR
    if b.by_country:  # a key counts where it has a record of the entity's country
        rare, on = token_pairs(_known(pool, query)).join(rare, _PAIR).select(*_PAIR, "country").distinct(), [*_PAIR, "country"]
    return token_pairs(query).join(rare, on, "left_semi").select(F.col("entity_id").alias("s1_id")).distinct()


def keyed(found: DataFrame) -> DataFrame:
    """Evidence by key: (s1_id, evidence), an array of (df, key, pids, is_solo) from the rarest on, ties
    by key. A query entity's keys all have at most `budget` records."""
    # dealt by entity at once, so that both groupings take one exchange
    by_key = found.repartition("s1_id").groupBy("s1_id", "df", "key", "is_solo").agg(F.sort_array(F.collect_list("pid")).alias("pids"))
    return by_key.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("df", "key", "pids", "is_solo"))).alias("evidence"))


def greedy(evidence_column: Column, budget: int | Column, most: int | Column | None = None, solo_only: bool = False) -> Column:
    """The candidates of a query entity: keys in order; one that would push the union beyond the
    budget is skipped, and later ones may still fit. With bags, repeated records count as often."""
    limit = budget if most is None else F.least(F.lit(budget) if isinstance(budget, int) else budget, F.lit(most) if isinstance(most, int) else most)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    room = F.lit(budget) if isinstance(budget, int) else budget
    usable = F.filter(evidence_column, lambda e: F.when(e["is_solo"], e["df"] <= room).otherwise(e["df"] <= limit) & (e["is_solo"] | F.lit(not solo_only)))
    lists = F.transform(usable, lambda e: e["pids"])

    def admit(have: Column, more: Column) -> Column:
        fresh = F.filter(more, lambda p: ~F.array_contains(have, p))
        return F.when(F.size(have) + F.size(fresh) <= room, F.concat(have, F.array_distinct(fresh))).otherwise(have)

    return F.aggregate(lists, F.array().cast("array<string>"), admit)


def candidates(s1: DataFrame, pool: DataFrame, b: Blocking = Blocking()) -> DataFrame:
    """(s1_id, cand_id) for entity tables; an entity with no admissible key has no row."""
    return candidates_of(prepare(s1), prepare(pool), b)


def candidates_of(query: DataFrame, rest: DataFrame, b: Blocking = Blocking(), keep: Keep = _as_is) -> DataFrame:
    """The same for prepared tables. Both are gone through several times; on large data write them
    first, so that texts are read and taken apart once. With a `keep` that writes what it is given, no
    more than one step's shuffle files are there at a time."""
    found = keyed(keep(evidence(query, rest, b, keep), "evidence"))
    return found.select("s1_id", F.explode(greedy(F.col("evidence"), b.budget)).alias("cand_id"))


def candidates_by(s1: DataFrame, pool: DataFrame, budgets: tuple[int, ...], pair_limits: tuple[int, ...] = (), b: Blocking = Blocking(), solo_only: bool = False) -> DataFrame:
    """(s1_id, budget, max_pair, cands): evidence is gathered once, for the largest budget, and every
    setting is a greedy run over it. solo_only: only single tokens and exact keys are taken, and an entity
    that has but pair keys has no candidates; under b.solo_only, which knows no pair keys, it has no row."""
    limits = pair_limits or (b.max_pair,)
    query, rest, b = prepare(s1), prepare(pool), replace(b, budget=max(budgets), max_pair=max(limits))
    found = keyed(evidence(query, rest, replace(b, solo_only=b.solo_only or solo_only)))
    if solo_only and not b.solo_only:
        none = F.array().cast(found.schema["evidence"].dataType)
        found = found.join(paired(query, rest, b), "s1_id", "full").withColumn("evidence", F.coalesce("evidence", none))
    grid = F.array(*[F.struct(F.lit(x).alias("budget"), F.lit(m).alias("max_pair")) for x in budgets for m in limits])
    each = found.select("s1_id", "evidence", F.explode(grid).alias("g"))
    return each.select("s1_id", "g.budget", "g.max_pair", greedy(F.col("evidence"), F.col("g.budget"), F.col("g.max_pair"), solo_only).alias("cands"))


def autopsy(s1: DataFrame, pool: DataFrame, truth: DataFrame, b: Blocking = Blocking(budget=50)) -> DataFrame:
    """(s1_id, cand_id, reason) for every true pair: covered; capacity (an admissible key has it, but
    did not fit); big_single (they share a token that is too frequent); exact_big (they share the
    exact key, too frequent); no_shared."""
    query, rest = prepare(s1), prepare(pool)
    found = evidence(query, rest, b)
    chosen = keyed(found).select("s1_id", F.explode(greedy(F.col("evidence"), b.budget)).alias("cand_id")).withColumn("covered", F.lit(True))
    reached = found.select("s1_id", F.col("pid").alias("cand_id")).distinct().withColumn("reached", F.lit(True))
    # only tokens of true pairs are compared, however frequent they are
    mine = tokens(query).select(F.col("entity_id").alias("s1_id"), "kind", "token").join(truth, "s1_id")
    theirs = tokens(rest).select(F.col("entity_id").alias("cand_id"), "kind", "token")
    shared = mine.join(theirs, ["cand_id", "kind", "token"]).groupBy("s1_id", "cand_id").agg(F.bool_or(F.col("kind") != "X").alias("single"), F.bool_or(F.col("kind") == "X").alias("exact"))
    on = ["s1_id", "cand_id"]
    joined = truth.join(chosen, on, "left").join(reached, on, "left").join(shared, on, "left")
    reason = F.when(F.col("covered"), "covered").when(F.col("reached"), "capacity").when(F.col("single"), "big_single").when(F.col("exact"), "exact_big").otherwise("no_shared")
    return joined.select("s1_id", "cand_id", reason.alias("reason"))
