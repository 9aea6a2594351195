import itertools
import random
from collections import Counter, defaultdict

import pytest
from factmark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, action string, part int"
LEGAL = {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"),
         ("assistant", "user")}


def cheapest(roles, c=chat.Costs()):
    """Every role for every turn, merged or not, with an empty turn before it or not."""
    best = float("inf")
    for named in itertools.product(chat.ROLES, repeat=len(roles)):
        change = sum(0 if a == b else c.relabel if b else c.unknown
                     for a, b in zip(named, roles, strict=True))
        states = {None: change}
        for role in named:
            after = {}
            for last, cost in states.items():
                ways = [(cost + c.merge, role)] if last == role else []
                if (last, role) in LEGAL:
                    ways.append((cost, role))
                if any((last, x) in LEGAL and (x, role) in LEGAL for x in chat.ROLES):
                    ways.append((cost + c.insert, role))
                for w, r in ways:
                    after[r] = min(after.get(r, w), w)
            states = after
        best = min([best, *states.values()])
    return best


def repaired(spark, conversations, **options):
    rows = [(i, t, r, f"{i}.{t}", "x", 1) for i, roles in enumerate(conversations)
            for t, r in enumerate(roles)]
    random.Random(0).shuffle(rows)
    out = defaultdict(list)
    for r in chat.repair_roles(spark.createDataFrame(rows, SCHEMA), **options).collect():
        out[r["conv_id"]].append(r)
    return {i: sorted(x, key=lambda r: (r["out_turn"], r["part"])) for i, x in out.items()}


@pytest.mark.parametrize("stretch", [2, 512])
def test_legal_at_the_least_cost(spark, stretch):
    r, c = random.Random(4), chat.Costs()
    conversations = [[r.choice([*chat.ROLES, None]) for _ in range(r.randint(1, 6))] for _ in range(60)]
    out = repaired(spark, conversations, stretch=stretch)
    for i, roles in enumerate(conversations):
        own, cost, last, at = out[i], 0, None, -1
        assert [x["turn"] for x in own if x["turn"] is not None] == list(range(len(roles)))
        for x in own:
            if x["action"] == "insert":
                cost += c.insert
                assert x["text"] == "" and x["turn"] is None
            else:
                had = roles[x["turn"]]
                cost += 0 if had == x["role"] else c.relabel if had else c.unknown
            if x["action"] == "merge":
                cost += c.merge
                assert x["role"] == last and x["out_turn"] == at and x["rendered"] == x["text"]
            else:
                assert (last, x["role"]) in LEGAL and x["out_turn"] == at + 1 and x["part"] == 0
                assert x["rendered"] == f"<|{x['role']}|>\n{x['text']}"
                last, at = x["role"], at + 1
        assert cost == cheapest(roles), roles


def test_names_nulls_ties_and_one_long_conversation(spark):
    rows = [(1, 0, " Human ", "hi", "", 0), (1, 1, "GPT", None, "", 0), (None, None, "user", "a", "", 0),
            (None, 3, "user", "b", "", 0), (2, 0, "user", "same", "", 0), (2, 0, "user", "same", "", 0)]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", "x", "", 0) for t in range(3000)]
    out = chat.repair_roles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["out_turn"], r["part"])):
        by[r["conv_id"]].append((r["role"], r["action"], r["text"]))
    assert by[1] == [("user", "keep", "hi"), ("assistant", "keep", "")]
    assert by[None] == [("user", "keep", "b"), ("user", "merge", "a")]
    assert by[2] == [("user", "keep", "same"), ("user", "merge", "same")]
    assert {a for _, a, _ in by[3]} == {"keep"}


def test_empty_table(spark):
    assert chat.repair_roles(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_stretch_is_longer_than_it_should_be(spark):
    """A third of all rows under a null conversation, with null, equal and low turn numbers."""
    rows = [(None, None if i % 3 else i % 2, "user", f"{i % 7}", "", 0) for i in range(1500)]
    rows += [(i, t, "user" if t % 2 == 0 else "assistant", "x", "", 0) for i in range(750) for t in range(4)]
    out = chat.repair_roles(spark.createDataFrame(rows, SCHEMA), stretch=100).collect()
    assert len(out) == len(rows)
    own = [r for r in out if r["conv_id"] is None]
    assert {r["out_turn"] for r in own} == {0} and len({r["part"] for r in own}) == 1500
    assert max(Counter(r["part"] >> 20 for r in own).values()) == 100
    texts = [(r["turn"] is None, r["turn"] or 0, r["text"]) for r in sorted(own, key=lambda r: r["part"])]
    assert {t[:2] for t in texts} == {(False, 0), (False, 1), (True, 0)} and texts == sorted(
        texts, key=lambda t: t[:2])
    by_text = [[t[2] for t in texts if t[:2] == k] for k in ((False, 0), (False, 1), (True, 0))]
    assert all(len([1 for a, b in zip(x, x[1:]) if a != b]) == 6 for x in by_text)


def test_blocks_of_stretches_cost_what_the_whole_does(spark):
    r, c = random.Random(9), chat.Costs()
    conversations = [[r.choice([*chat.ROLES, None]) for _ in range(n)] for n in (9, 10, 40, 200)]
    for i, own in repaired(spark, conversations, stretch=3).items():
        cost, roles = 0, conversations[i]
        assert [x["turn"] for x in own if x["turn"] is not None] == list(range(len(roles)))
        for x in own:
            had = roles[x["turn"]] if x["turn"] is not None else x["role"]
            cost += {"merge": c.merge, "insert": c.insert}.get(x["action"], 0)
            cost += 0 if had == x["role"] else c.relabel if had else c.unknown
        assert cost == min(x[0] for x in chat._forward(tuple(roles), chat.START, c)[-1])
