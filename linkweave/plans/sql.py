"""Building blocks of the DuckDB statements that check the queries."""

from __future__ import annotations

from ..functions import text as X

WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def norm(c: str, mark: str = "") -> str:
    """DuckDB's upper keeps a capital sharp s, Spark's gives two letters."""
    return rf"trim(regexp_replace(regexp_replace(upper(replace(coalesce({c}, ''), 'ß', 'ss')), '[!-/:-@\[-`{{-~]', '{mark}', 'g'), '\s+', ' ', 'g'))"


def ascii_norm(c: str) -> str:
    return rf"trim(regexp_replace(upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9 ]', ' ', 'g')), '\s+', ' ', 'g'))"


def strip(n: str, forms: str) -> str:
    return f"array_to_string(list_filter(string_split({n}, ' '), lambda w: not regexp_full_match(w, '({forms})')), ' ')"


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def grams(c: str, n: int) -> str:
    return f"case when length({c}) >= {n} then list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substring({c}, i, {n}))) else [] end"


def unit(c: str, seed: int) -> str:
    return f"((('0x' || left(md5({c} || '#{seed}'), 12))::bigint::double + 0.5) / 281474976710656.0)"


def rank(c: str, seed: int) -> str:
    return f"md5({c} || '#{seed}'), {c}"


SCRIPT = "case " + " ".join(f"when regexp_matches({{c}}, '{p}') then '{n}'" for n, p in [(n, p.replace("\\u", "\\x{").replace("-", "}-").replace("]", "}]")) for n, p in X.SCRIPTS]) + " when regexp_matches({c}, '[A-Za-z]') then 'Latn' else 'None' end"


def script(c: str) -> str:
    return SCRIPT.replace("{c}", c)


def script_class(c: str) -> str:
    far = r"[^\x00-\x7F"
    return f"case when not regexp_matches({c}, '{far}]') then 0 when regexp_matches({c}, '{far}{X.latin_named()}]') then 2 else 1 end"


ENTITIES = r"""
ent as (
    select 'S' || (s + 1) || '-' || doc_id as entity_id, array_to_string(t[1:6], ' ') as name,
        array_to_string(t[7:18], ' ') || ' ' || n_chars as address, lang as country, 'S' || (s + 1) as src, text
    from (select doc_id, lang, text, n_chars, substr(source, 4)::int % 3 as s, regexp_extract_all(text, '\S+') as t from documents)
)"""

PREPARED = f"""{ENTITIES},
normed as (
    select *, {norm("name")} as n, {norm("address")} as a from ent
), prep as (
    select *, strip_accents(n) as fk, list_distinct(regexp_extract_all(n, '{WORD}')) as tn,
        list_distinct(regexp_extract_all(a, '{WORD}')) as ta, list_distinct(regexp_extract_all(a, '\\d{{2,}}')) as tm
    from normed
)"""

TOKENS = f"""{PREPARED},
tok as (
    select entity_id, src, country, 'N' as kind, 0 as o, unnest(tn) as token from prep union all
    select entity_id, src, country, 'A', 1, unnest(ta) from prep union all
    select entity_id, src, country, 'M', 2, unnest(tm) from prep union all
    select entity_id, src, country, 'X', 3, fk from prep
), freq as (
    select kind, token, count(*) as df from tok
    where src <> 'S1' and (kind, token) in (select (kind, token) from tok where src = 'S1') group by all
)"""


def evidence(budget: int, pairs: int, by_country: bool = False) -> str:
    """ev(s1_id, df, key, is_solo, pid)."""
    same = "and q.country = p.country" if by_country else ""
    return f"""{TOKENS},
pairs as (
    select x.entity_id, x.src, x.country, x.kind as k1, x.token as t1, y.kind as k2, y.token as t2
    from tok x join tok y on x.entity_id = y.entity_id and x.o < 3 and y.o < 3 and (x.o, x.token) < (y.o, y.token)
), pair_freq as (
    select k1, t1, k2, t2, count(*) as df from pairs
    where src <> 'S1' and (k1, t1, k2, t2) in (select (k1, t1, k2, t2) from pairs where src = 'S1')
    group by all having count(*) <= {min(pairs, budget)}
), ev as (
    select q.entity_id as s1_id, q.country, f.df, q.kind || ':' || q.token as key, true as is_solo, p.entity_id as pid
    from tok q join freq f on q.kind = f.kind and q.token = f.token and f.df <= {budget}
    join tok p on p.kind = q.kind and p.token = q.token and p.src <> 'S1' {same}
    where q.src = 'S1'
    union all
    select q.entity_id, q.country, f.df, q.k1 || ':' || q.t1 || '+' || q.k2 || ':' || q.t2, false, p.entity_id
    from pairs q join pair_freq f on q.k1 = f.k1 and q.t1 = f.t1 and q.k2 = f.k2 and q.t2 = f.t2
    join pairs p on p.k1 = q.k1 and p.t1 = q.t1 and p.k2 = q.k2 and p.t2 = q.t2 and p.src <> 'S1' {same}
    where q.src = 'S1'
), keyed as (
    select s1_id, df, key, is_solo, list(pid order by pid) as pids from ev group by all
)"""


def greedy(lists: str, budget: str) -> str:
    return f"""list_reduce({lists}, lambda acc, x: case when len(list_distinct(list_concat(acc, x))) <= {budget}
        then list_distinct(list_concat(acc, x)) else acc end, []::varchar[])"""


TRUTH = "truth as (select x.entity_id as s1_id, y.entity_id as cand_id, x.country from ent x join ent y on x.text = y.text and x.src = 'S1' and y.src <> 'S1')"


def eval_pairs(n: int, seed: int) -> str:
    """ep(s1_id, cand_id, y): the true pairs, and same-country pairs that are not true."""
    return f"""{TRUTH}, drawn as (
    select entity_id, country from ent where src = 'S1' and country is not null order by {rank("entity_id", seed)} limit {n}
), lhs as (
    select entity_id, country, row_number() over (partition by country order by {rank("entity_id", seed)}) - 1 as i from drawn
), rhs as (
    select entity_id, country, row_number() over (partition by country order by {rank("entity_id", seed + 1)}) - 1 as slot,
        count(*) over (partition by country) as size
    from ent where src <> 'S1' and country is not null
), negs as (
    select l.entity_id as s1_id, r.entity_id as cand_id from lhs l join rhs r on l.country = r.country and l.i % r.size = r.slot
), ep as (
    select s1_id, cand_id, 1 as y from truth union all
    select s1_id, cand_id, 0 from negs where (s1_id, cand_id) not in (select (s1_id, cand_id) from truth)
)"""


SCORED = f"""{TOKENS}, {TRUTH}, common as (
    select x.entity_id as s1_id, y.entity_id as cand_id
    from tok x join freq f on x.kind = 'N' and f.kind = 'N' and x.token = f.token and f.df <= 20 and x.src = 'S1'
    join tok y on y.kind = 'N' and y.token = x.token and y.src <> 'S1' group by all
), scored as (
    select c.s1_id, c.cand_id, {jaccard("x.tn", "y.tn")} as score
    from common c join prep x on x.entity_id = c.s1_id join prep y on y.entity_id = c.cand_id
)"""
