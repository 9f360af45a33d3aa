"""Conversation repair against a plain dynamic programme over rows, and ropes and grammars by themselves."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import queries, repair

WHITE = " \t\n\x0b\x0c\r"


def brute(convs):
    """Rows of op11 from (conv_id, turn, role, text) rows, by whole strings."""
    out = {}
    for c, turn, role, text in convs:
        rows = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    found = []
    for c, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in rows:
            end = text.strip(WHITE)[-1:]
            kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest([r[1][:1] for r in rows], kinds)
        found.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(written(rows, audit).encode()).hexdigest()))
    return sorted(found, key=repr)


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(initials, kinds):
    """Forward over rows: the least (cost, edits) for each last role."""
    best = {"": (0, "")}

    def more(best):
        for _ in range(3):
            for s, (c, e) in list(best.items()):
                for r in "ua":
                    if (s, r) in NEXT:
                        x = (c + 3, e + "I")
                        best[NEXT[s, r]] = min(best.get(NEXT[s, r], x), x)
        return best

    for role, kind in zip(initials, kinds, strict=True):
        new = {}

        def put(s, x, new=new):
            new[s] = min(new.get(s, x), x)

        for s, (c, e) in more(best).items():
            put(s, (c + 4, e + "D"))
            if kind not in ("blank", "duplicate"):
                cut = 3 * (kind == "truncated")
                for r in "sua":
                    if (s, r) in NEXT:
                        if r == role:
                            put(NEXT[s, r], (c + cut, e + "K"))
                        if r != "s":
                            put(NEXT[s, r], (c + cut + 3, e + "R"))
        best = new
    return min(x for s, x in more(best).items() if s in ("", "a"))


def written(rows, audit):
    rows, last, out = iter(rows), "", []
    for e in audit:
        _, role, text = (None, "", "") if e == "I" else next(rows)
        if e != "D":
            role = role if e == "K" else {"u": "assistant"}.get(last, "user")
            last = role[:1]
            out.append(f"{role}:{text}")
    return "\n".join(out)


ODD = [
    (1, None, None, None), (1, 0, "user", "A."), (1, 0, "user", "A."), (1, 1, "tool", "x"), (1, 2, "", "b!"), (None, 3, "user", "n?"), (None, None, "system", "  \n"), (7, 5, "System", "q."),
    (7, 9, "assistant", "é漢.\x0b "), (8, 1, "user", " \t\n\x0b\x0c\r"), (8, 2, "user", "　"), (9, 4, "assistant", "w" * 50_000 + "."), (10, 1, "assistant", "a."), (10, 2, "assistant", "a."),
]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_agrees_with_brute_force(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op11_repair(spark, sf_dir)) == brute(rows)
    rng = random.Random(4)
    made = [(1000 + i, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", "Why?", "", None, f"{i} {t}."])) for i in range(300) for t in range(rng.choice([1, 2, 3, 9, 40]))]
    rows = ODD + made
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gone int, symbol string").repartition(5)
    assert as_rows(repair.report(repair.damage(df), gone="gone")) == brute(rows)
    assert as_rows(repair.report(repair.damage(df), gone="gone", rules=())) == brute(rows)  # rules only share work
    assert repair.report(repair.damage(df.limit(0)), gone="gone").count() == 0


def test_sql_gives_the_same_rows(sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert sorted(con.execute(queries.SQL["op11_repair"]).fetchall(), key=repr) == brute(rows)


def test_long_conversations_in_blocks_and_files(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "two", f"{t}!"])) for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute(rows)
    assert as_rows(repair.report(repair.damage(df), gone="gone")) == want
    waiting = repair.Waiting()
    monkeypatch.setattr(repair, "SPOOL", 1000)
    for i in range(500):
        waiting.add("user", str(i))
    assert waiting.file and list(waiting) == [("user", str(i)) for i in range(500)]
    fixed = repair.repaired(repair.damage(df), gone="gone").orderBy("pos").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in fixed).encode()).hexdigest() == want[0][-1]


def test_rules_are_learned_and_shared(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(50) for t in range(16)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rules = repair.learn(df)
    g = repair.Grammar(rules)
    assert rules[0] == (repair.SYMBOLS.index("u"), repair.SYMBOLS.index("a")) and len(g.compressed("ua" * 8)) == 1
    expand = lambda s: [s] if s < len(repair.SYMBOLS) else [y for x in rules[s - len(repair.SYMBOLS)] for y in expand(x)]
    assert [repair.SYMBOLS[x] for s in g.compressed("uauaSaa") for x in expand(s)] == list("uauaSaa")
    assert {tuple(r)[1:8] for r in repair.report(df, rules=rules).collect()} == {(0, 0, 0, 0, 0, 0, "K" * 16)}


@pytest.mark.parametrize("seed", range(3))
def test_ropes_compare_as_strings(seed):
    rng = random.Random(seed)

    def rope(s):
        if len(s) < 2 or rng.random() < 0.2:
            return s
        k = rng.randrange(len(s) + 1)
        return rope(s[:k]), rope(s[k:])

    words = ["".join(rng.choice("DK") for _ in range(rng.randrange(8))) for _ in range(60)]
    assert all(repair.less(rope(a), rope(b)) == (a < b) for a in words for b in words)
