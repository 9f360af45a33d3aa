"""Prefix tries against plain dictionaries of prefixes and against the query's SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import queries, trie

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return len([w for w in text.translate({ord(c): " " for c in WHITE}).split(" ") if w])


def brute(rows, change=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: (v[:2], hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).digest()))] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if change else 0
        built[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    members, ends = {}, {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
        ends.setdefault(tuple(x), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        own_saved = (len(m) - 1) * words(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_saved
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()], key=repr)


def as_rows(df):
    return sorted(map(tuple, df.select(*trie.RESULT).collect()), key=repr)


def test_query_agrees_with_brute_force_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = as_rows(queries.op13_trie(spark, sf_dir))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    found = con.execute(f"select {', '.join(trie.RESULT)} from ({queries.SQL['op13_trie']})").fetchall()
    assert sorted(found, key=repr) == got


ODD = [
    (None, 1, "user", "lost"), (20, None, None, None), (20, 0, "user", ""), (21, 3, "user", "a b　c"), (22, 3, "user", "a b　c"), (22, 3, "user", "a b　c"), (22, 3, "assistant", "x" * 60_000),
    (45, 1, "user", " \t\n\x0b\x0c\r"), (46, 1, "us", "erhi"), (47, 1, "user", "hi"), (60, 1, "user", "one"), (61, 1, "user", "one"), (62, 1, "user", "one"), (63, 9, "user", "one"),
]


@pytest.mark.parametrize(("turns_each", "parts"), [(1, 7), (5, 3), (40, 1), (100_000, 4)])
def test_ranges_and_tasks_merge(spark, turns_each, parts):
    """Equal conversations, common prefixes and empty conversations over ranges of every size."""
    rng = random.Random(turns_each)
    made = [(100 + c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d e f"])) for c in range(150) for t in range(rng.choice([1, 2, 3, 6]))]
    same = [(1000 + c, t, "user", f"turn {t}") for c in range(60) for t in range(3)]
    rows = ODD + made + same + [(3000, t, "user", "deep") for t in range(300)]
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "conv_id long, turn long, role string, text string, key binary, part int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert as_rows(trie.trie(trie.rebuilt(df), turns_each)) == brute(rows)
        assert as_rows(trie.trie(trie.sequences(df), turns_each)) == brute(rows, change=False)
        assert trie.trie(trie.rebuilt(df.limit(0)), turns_each).count() == 0
        assert as_rows(trie.trie(trie.sequences(df.where("conv_id = 60")), turns_each)) == brute([(60, 1, "user", "one")], change=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tree_is_balanced_by_the_middle_first():
    tree, n = trie.Tree(), 1023
    for i in trie.middle_first(n):
        tree.insert([i, 0], [i])
    assert [tree.symbol[x] for x in tree.siblings(tree.first)] == list(range(n))

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.first) == 10
