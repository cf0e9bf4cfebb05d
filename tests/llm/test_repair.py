"""Operator 11 against a search of all edits, and its edge cases."""

import hashlib
import itertools
import random
import zlib

import pytest

from demandlens.llm import repair
from demandlens.llm.registry import queries

SCHEMA = "conv_id long, turn long, role string, text string, kind int, sig string"
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    """Rows (turn, role, text) in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        face = text.strip(BLANKS)
        fault = "blank" if not face else "duplicate" if (role, text) in seen else "truncated" if face[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def legal(kinds):
    body = kinds.removeprefix("s")
    return kinds == "" or (body != "" and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def search(rows):
    """Cheapest edits by trying every choice for every row, with up to two insertions between rows."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for (_, _, _, f), e in zip(rows, edits, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, kinds, audit, texts = 0, "", "", []
            next_role = lambda k: "assistant" if k[-1:] == "u" else "user"
            for i in range(len(rows) + 1):
                for _ in range(gaps[i]):
                    role = next_role(kinds)
                    cost, kinds, audit = cost + 2, kinds + role[0], audit + "I"
                    texts.append(role + ":")
                if i == len(rows):
                    break
                _, role, text, fault = rows[i]
                audit += edits[i]
                if edits[i] == "D":
                    cost += 3
                    continue
                if edits[i] == "R":
                    role, cost = next_role(kinds), cost + 2
                cost += fault == "truncated"
                kinds += role[:1] or "-"
                texts.append(f"{role}:{text}")
            if legal(kinds) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return best


def wanted(rows):
    rows = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = [r[1][:1] for r in rows]
    count = lambda f: sum(r[3] == f for r in rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, *search(rows))


def chats(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No", "", " \t", "Why? ", "Well!\n", "a.b", "Yes."]
    return [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts), 7, "x") for c in range(conversations) for _ in range(rng.randint(1, most))]


def found(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


def test_equals_a_search_of_all_edits(spark):
    rows = chats(3, 60, 4)
    got = found(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    for c in {r[0] for r in rows}:
        assert got[c] == wanted([r[1:4] for r in rows if r[0] == c]), c


@pytest.mark.parametrize("block", [1, 3])
def test_stretches_compose(spark, monkeypatch, block):
    rows = chats(5, 25, 60)
    whole = found(repair.repair(spark.createDataFrame(rows, SCHEMA)))
    monkeypatch.setattr(repair, "BLOCK", block)
    faces = repair.faces(repair._prepared(spark.createDataFrame(rows, SCHEMA)))
    assert max(len(r["sig"]) for r in repair.stretches(faces).select("sig").collect()) <= 1025
    stack, best = [], {}
    for c, letters in ((r["conv_id"], r["sig"]) for r in repair.stretches(faces).collect()):
        pieces = [letters[1 + i : 1 + i + block] for i in range(0, len(letters) - 1, block)]
        paths = best.get(c, {repair.START: (0, "")})
        for piece in pieces:
            ends = [x.get(s, (None, None)) for x in repair.layers("*" + piece, stack) for s in range(4)]
            paths = repair.joined(paths, {"costs": [e[0] for e in ends], "audits": [e[1] for e in ends]})
        best[c] = paths
    for c, paths in best.items():
        every = repair.inserted(paths)
        assert min(every[s] for s in repair.ENDS if s in every) == whole[c][5:7], c


def test_layers_are_shared_and_answers_do_not_depend_on_the_stack():
    signatures = sorted("^" + "".join(s) for s in itertools.product("suaU04", repeat=4))
    stack: list = []
    assert [repair.layers(s, stack) for s in signatures] == [repair.layers(s, []) for s in signatures]
    before = [id(layer) for _, layer in stack]
    repair.layers(signatures[-1][:-1] + "x", stack)
    assert [id(layer) for _, layer in stack][:-1] == before[:-1]


def test_edges(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, None, None), (2, None, "user", "Hi."), (2, None, "user", "Hi."), (3, 5, "assistant", "x " * 50_000), (4, 1, "user", "Hi.")]
    ids = spark.createDataFrame([(None,), (4,), (9,)], "conv_id long")
    got = found(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ids))
    assert got[None] == wanted([(1, "user", "Hi."), (2, " ", " ")])
    assert got[2] == wanted([(None, "user", "Hi.")] * 2) and got[2][2] == 1
    assert got[3] == wanted([(5, "assistant", "x " * 50_000)])
    assert got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    messages = repair.repaired_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 4").collect()
    assert [tuple(m) for m in messages] == [(4, 1, "K", 1, "user", "Hi."), (4, 2, "I", None, "assistant", "")]


def test_damage_follows_the_rule(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}-{t}?") for c in range(30) for t in range(4)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if hit == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if hit == 2 else text
        want += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_query_reports_every_conversation(spark):
    data = "/root/testdata/sf0.001"
    out = queries()["op11_repair_conversations"](spark, data)
    assert out.count() == spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()
