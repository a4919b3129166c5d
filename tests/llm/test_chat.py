"""Role repair: costs against exhaustive search, chunked against whole, rendering."""

import itertools
import random
import re
from collections import Counter

from linkweave.llm import chat
from linkweave.llm.chat import ROLES, Settings


def legal(roles):
    body = roles[1:] if roles and roles[0] == 1 else roles
    return bool(body) and len(body) % 2 == 0 and all(r == 2 + i % 2 for i, r in enumerate(body))


def exhaustive(roles, s):
    """Least cost over all partitions into turns, labels, and empty turns put anywhere."""
    best = None
    for merges in itertools.product([False, True], repeat=len(roles) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(merges) if not m], len(roles)]
        parts = [roles[a:b] for a, b in zip(cuts, cuts[1:])]
        for labels in itertools.product((1, 2, 3), repeat=len(parts)):
            cost = sum(s.merge * (len(p) - 1) + sum(0 if r == label else s.relabel if r else s.unknown for r in p) for p, label in zip(parts, labels))
            # the shortest legal sequence that has the labels as a subsequence, extra turns being user or assistant
            need, state = 0, 0
            for want in labels:
                if want == 1:
                    if state != 0:
                        need = None
                        break
                    state = 1
                    continue
                while want not in chat.FOLLOWS[state]:
                    state = 2 if state != 2 else 3
                    need += 1
                state = want
            if need is None:
                continue
            while state != 3:
                state = 2 if state != 2 else 3
                need += 1
            total = cost + s.insert * need
            best = total if best is None else min(best, total)
    return best


def test_costs_match_exhaustive_search():
    for s in (Settings(), Settings(relabel=1, merge=5, insert=2, unknown=0)):
        for n in (1, 2, 3, 4):
            for roles in itertools.product(range(4), repeat=n):
                cost, taken, state = chat.repair(list(roles), chat.START, None, s)
                end, extra = chat.ending(state, s)
                assert cost + end == exhaustive(list(roles), s), roles
                out = []
                for _, _, inserted, merged, role in taken:
                    out += [*inserted, *([] if merged else [role])]
                assert legal([*out, *extra])
                if legal(list(roles)):
                    assert cost + end == 0 and out == list(roles)


def parse(text):
    roles, bodies = [], []
    for m in re.finditer(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>\n", text, re.S):
        roles.append(ROLES.index(m[1]) + 1)
        bodies.append(m[2].replace("<\\|", "<|").replace("<\\\\", "<\\"))
    return roles, bodies


def test_chunks_make_no_difference(spark):
    rnd = random.Random(4)
    rows = []
    for conv in range(12):
        for turn in range(rnd.choice([1, 2, 9, 40, 130])):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "User ", "tool", None]), f"t{turn} <|end|> <\\x"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = {r.conv_id: r for r in chat.repaired(turns).collect()}
    cut = {}
    for r in sorted(chat.repaired(turns, Settings(chunk_turns=4, fan=3)).collect(), key=lambda r: (r.conv_id, r.segment)):
        cut.setdefault(r.conv_id, []).append(r)
    assert set(cut) == set(whole) == set(range(12)) and len(whole) == 12
    for conv, r in whole.items():
        assert sum(x.cost for x in cut[conv]) == r.cost
        for text in (r.rendered, "".join(x.rendered for x in cut[conv])):
            roles, bodies = parse(text)
            assert legal(roles) and "\n".join(b for b in bodies if b).count("<|end|>") == r.n_turns
        assert len(parse(r.rendered)[0]) == r.n_out == r.n_turns - r.merges + r.inserts
        assert sum(x.n_out for x in cut[conv]) == len(parse("".join(x.rendered for x in cut[conv]))[0])


def test_edges(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", None), (5, None, None, None), (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (7, 0, "user", "x" * 200000), (7, 1, "assistant", "")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.repaired(turns).collect()}
    assert got[None].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\n\n<|end|>\n" and got[None].cost == 0
    assert legal(parse(got[5].rendered)[0]) and parse(got[6].rendered) == ([2, 3], ["same", "same"]) and got[6].cost == 4
    assert len(got[7].rendered) > 200000 and got[7].cost == 0
    assert chat.repaired(turns.limit(0)).collect() == []


def test_turn_numbers_do_not_matter(spark):
    """A short conversation is one row whatever its numbers; very many rows at one number are cut."""
    rows = [(1, t, r, "x") for t, r in zip(range(510, 514), ["user", "assistant"] * 2)]
    rows += [(2, 10**12 * t, r, "y") for t, r in zip(range(4), ["user", "assistant"] * 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.repaired(turns).collect()}
    assert set(got) == {1, 2} and got[1].n_turns == got[2].n_turns == 4 and got[1].cost == 0
    many = spark.range(20000).selectExpr("cast(null as long) as conv_id", "cast(null as long) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'t' as text")
    one = spark.range(20000).selectExpr("3L as conv_id", "7L as turn", "'user' as role", "cast(id % 3 as string) as text")
    got = chat.repaired(turns.unionByName(many).unionByName(one)).collect()
    assert max(r.n_turns for r in got) <= 512
    assert Counter({k: sum(r.n_turns for r in got if r.conv_id == k) for k in (None, 1, 2, 3)}) == Counter({None: 20000, 1: 4, 2: 4, 3: 20000})
    for k in (None, 3):
        own = sorted((r for r in got if r.conv_id == k), key=lambda r: r.segment)
        assert len({r.segment for r in own}) == len(own) >= 40
        whole = "".join(r.rendered for r in own)
        roles, bodies = parse(whole)
        assert legal(roles) and len(roles) == sum(r.n_out for r in own)
        order = [2] * 20000 if k else [3] * 10000 + [2] * 10000  # assistant before user
        cost, _, state = chat.repair(order, chat.START, None, Settings())
        assert sum(r.cost for r in own) == cost + chat.ending(state, Settings())[0]
