import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from docspark.llm import conversation_repair as cr
from docspark.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, key int, kind string, audit int, place string, present string"
EXTRA = ("x", 1, "k", 2, "p", "q")


def cheapest(letters):
    """From the end: the least (cost, edits) of what is left; letters as (role initial, must go, truncated)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(letters) and state in (0, 3):
            found.append((0, ""))
        if inserted < 2:
            cost, rest = best(i, after[state], inserted + 1)
            found.append((cost + 5, "I" + rest))
        if i < len(letters):
            role, gone, cut = letters[i]
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 2, "D" + rest))
            if not gone:
                cost, rest = best(i + 1, after[state], 0)
                found.append((cost + 1 + 5 * cut, "R" + rest))
                keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
                if (role, state) in keeps:
                    cost, rest = best(i + 1, keeps[role, state], 0)
                    found.append((cost + 5 * cut, "K" + rest))
        return min(found) if found else (1 << 40, "")

    return best(0, 0, 0)


def as_letter(role, gone, cut):
    kind = role if role in ("s", "u", "a") else "o"
    return "x" if gone else kind.upper() if cut else kind


def brute(rows):
    """conv_id: the contract's columns, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for r in rows:
            if r[0] != conv:
                continue
            turn, role, text = r[1], *(" " if x is None else x for x in r[2:4])
            what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            role = "user" if what == 4 else role
            mine += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        faults, seen = [], set()
        for r in mine:
            bare = r[2].rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if r[1:] in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add(r[1:])
        cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults, strict=True)))
        said, at, state, names = [], 0, 0, {2: "user", 3: "assistant"}
        for e in audit:
            role, text = (None, "") if e == "I" else mine[at][1:]
            at += e != "I"
            if e == "D":
                continue
            state = 1 if e == "K" and role[0] == "s" else 3 if state == 2 else 2
            said.append(f"{role if e == 'K' else names[state]}:{text}")
        turns = {r[0] for r in mine} - {None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    found = cr.digests(cr.damage(df)).collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: tuple(r[1:]) for r in found}


def made(rng, conv, n):
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "What?", "end. \n", "x" * 3]
    return [(conv, t, rng.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), rng.choice([*texts, f"Own {conv} {t}.", f"Own {t}"])) for t in range(n)]


def test_trie_gives_the_cheapest_edits():
    rng, trie, wanted = random.Random(1), cr.Trie(), {}
    for _ in range(1500):
        letters = tuple((rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9)))
        wanted["".join(as_letter(*x) for x in letters)] = cheapest(letters)
    for signature in sorted(wanted):
        assert cr.joined([list(trie.walk("^" + signature))]) == wanted[signature], signature


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_pieces_join_to_the_same_edits(size):
    rng = random.Random(size)
    for _ in range(150):
        letters = tuple((rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 15)))
        whole = "".join(as_letter(*x) for x in letters)
        parts = [whole[i : i + size] for i in range(0, len(whole), size)] or [""]
        answers = [list(cr.Trie().walk("-^"[not k] + p)) for k, p in enumerate(parts)]
        assert cr.joined(answers) == cheapest(letters), whole


def test_layers_are_shared(monkeypatch):
    trie, steps, plain = cr.Trie(), [], cr.step
    monkeypatch.setattr(cr, "step", lambda *a: steps.append(1) or plain(*a))
    for s in ("^suaua", "^suauaS", "^suauax", "^ua"):
        list(trie.walk(s))
    assert len(steps) == 5 + 1 + 1 + 2


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [r for conv in range(120) for r in made(rng, conv, rng.randint(1, 9))]
    rows += [(None, t, "user", f"No id {t}.") for t in range(5)] + [(500, None, "user", "No turn."), (500, None, "assistant", "No turn either."), (500, 4, "assistant", "Yes.")]
    rows += [(501, 1, "user", "Twice."), (501, 1, "user", "Twice."), (501, 1, "assistant", "Tie."), (502, 0, "", "No role."), (503, None, None, None)]
    rows += [(504, 0, "user", "w " * 200_000), (505, 0, "nobody", "日本語。\U0001f600."), (505, -3, "user", "Before zero.")]
    assert got(spark, rows) == brute(rows)


def test_a_long_conversation_is_spread_and_repaired(spark):
    rng = random.Random(6)
    rows = made(rng, 1, 5000) + made(rng, 2, 3)
    want = brute([r for r in rows if r[0] == 2])
    found = got(spark, rows)
    assert found[2] == want[2]
    letters_of = cr._letters(cr.damage(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)).filter("id = 1"), 100)
    ordered = sorted(letters_of.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.key or b""))
    signature = "".join(("x" if k or r.letter in "bd" else r.letter) for r in ordered if r.present for k in range(r.again + 1))
    layer = {0: (0, "")}  # forward over whole strings
    for letter in signature:
        nxt = {}
        for p, q, cost, edits in cr.WAYS[letter]:
            if p in layer:
                nxt.setdefault(q, []).append((layer[p][0] + cost, layer[p][1] + edits))
        layer = {q: min(v) for q, v in nxt.items()}
    assert (found[1][5], found[1][6]) == min((c + 5 * cr.FINISH[s], e + "I" * cr.FINISH[s]) for s, (c, e) in layer.items())


def test_empty_and_all_dropped(spark):
    assert got(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "Gone.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows_hash_to_the_digest(spark):
    rng = random.Random(8)
    rows = [r for conv in range(30) for r in made(rng, conv, 6)]
    damaged = cr.damage(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA))
    said = {}
    for r in sorted(cr.repaired(damaged).collect(), key=lambda r: (r.id, r.place)):
        said.setdefault(r.id, []).append(f"{r.role}:{r.text}")
    for conv, want in brute(rows).items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == want[-1]


def test_query_and_its_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for conv in range(60) for r in made(rng, conv, rng.randint(1, 8))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_repair(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.OP11_SQL)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute(rows)
