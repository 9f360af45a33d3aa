"""Conversation structure repair by a grammar-compressed min-plus dynamic programme.

Method: each row of a conversation is one of nine symbols, its role's initial (s, u, a or another) with its first fault
(to be deleted, cut off, none).  Re-Pair learns a grammar from all conversations: in each round Spark counts the adjacent
symbols of the distinct sequences, weighted by the conversations that have them, and the most frequent pairs become rules.
Edits are steps of an automaton for the legal roles ``(s?(ua)+)?``, so a symbol is a min-plus matrix over its four states,
whose entries are the least cost and, as a rope, the edits that reach it, the ASCII-least of equal cost.  Rules get
their matrix from their two parts, bottom-up, once in each worker, and all conversations share them; a sequence that has been
solved is looked up.  Of two edit strings of equal cost for the same rows neither begins the other (each insertion costs), so the
least strings of parts give the least string of the whole.

How rows flow: the learning pass shuffles a hash and a symbol for each row, never a text.  The pass that repairs shuffles
rows once by conversation, sorts them in Spark and streams them through; a conversation's rows wait for its edits
in memory up to ``SPOOL`` bytes and in a temporary file of the task beyond.  Audit and digest are one value for a whole
conversation, whose rows are therefore read in order by one task; what it holds is a symbol for each row, in blocks of ``BLOCK``.
The number of rules is bounded (``rounds`` times ``pairs``), which changes only what is shared, never a result.

Defined results: a null role or text is one space (blank, so deleted); rows go by turn, nulls first, then by role and
text; repeated rows are duplicates; a null id is a conversation like any other; a conversation of which no row is left
has zeros, an empty audit and the digest of the empty string; columns beside the four named are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, arrow_stream, materialize

#: Costs of edits, and what an undeleted row that is cut off adds.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Symbols of rows: role initials of sound rows, of rows that are cut off, and d for rows that must be deleted.
SYMBOLS = "suaxSUAXd"
BLOCK, SPOOL, REMEMBERED = 1024, 8 << 20, 50_000
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing yet, after system, after user, after assistant; roles that lead on; states where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)

Entry = tuple[int, object] | None  # a cost and the rope of its edits: a string, or a pair of ropes


def pieces(*ropes) -> Iterator[str]:
    stack = list(reversed(ropes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += (x[1], x[0])


def less(a, b) -> bool:
    """Whether rope ``a`` spells a smaller string than ``b``; parts that both share at one place are passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if not isinstance(x, str):
            left += (x[1], x[0])
            right.append(y)
        elif not isinstance(y, str):
            left.append(x)
            right += (y[1], y[0])
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
    return not any(pieces(*left)) and any(pieces(*right))


def better(x: Entry, y: Entry) -> Entry:
    if x is None or y is None or x[0] != y[0]:
        return x if y is None or (x is not None and x[0] < y[0]) else y
    return x if less(x[1], y[1]) else y


def joined(x, y):
    return y if x == "" else x if y == "" else (x, y)


def times(a: list, b: list) -> list:
    """Min-plus product of two matrices of 4 x 4 entries."""
    out = []
    for row in a:
        new: list[Entry] = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and (new[j] is None or x[0] + y[0] <= new[j][0]):
                        new[j] = better((x[0] + y[0], joined(x[1], y[1])), new[j])
        out.append(new)
    return out


def inserts() -> list:
    """Any number of insertions: the cheapest way between states by adding rows of users and assistants."""
    step = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for (i, role), j in STEPS.items():
        if role in "ua":
            step[i][j] = (INSERT, "I")
    return times(step, step)  # a third row would lead back


ADDED = inserts()
DONE = [better(*(ADDED[i][j] for j in ENDS)) for i in range(4)]


def row_matrix(symbol: str) -> list:
    """Insertions, then one row of this symbol."""
    out: list[list[Entry]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if symbol != "d":
        cut = CUT if symbol.isupper() else 0
        for (i, role), j in STEPS.items():
            if role == symbol.lower():
                out[i][j] = better(out[i][j], (cut, "K"))
            if role in "ua":
                out[i][j] = better(out[i][j], (REROLE + cut, "R"))
    return times(ADDED, out)


class Grammar:
    """Re-Pair rules, numbered after the symbols, and the matrices of all."""

    def __init__(self, rules: tuple[tuple[int, int], ...]):
        self.ranks = {pair: len(SYMBOLS) + i for i, pair in enumerate(rules)}
        self.matrices = [row_matrix(s) for s in SYMBOLS]
        for a, b in rules:
            self.matrices.append(times(self.matrices[a], self.matrices[b]))
        self.solved: dict[str, tuple[int, str]] = {}

    def compressed(self, block: str) -> list[int]:
        """A block's symbols by the rules, the oldest first and each from left to right."""
        x = [SYMBOLS.index(c) for c in block]
        while len(x) > 1:
            rule = min((r for r in map(self.ranks.get, zip(x, x[1:])) if r is not None), default=None)
            if rule is None:
                break
            out, i = [], 0
            while i < len(x):
                if i + 1 < len(x) and self.ranks.get((x[i], x[i + 1])) == rule:
                    out.append(rule)
                    i += 2
                else:
                    out.append(x[i])
                    i += 1
            x = out
        return x

    def solve(self, blocks: list[str]) -> tuple[int, str]:
        """Least cost and ASCII-least edits of a sequence in blocks, from its end to its start."""
        known = self.solved.get(blocks[0]) if len(blocks) == 1 else None
        if known:
            return known
        v = DONE
        for block in reversed(blocks):
            for s in reversed(self.compressed(block)):
                v = [functools.reduce(better, [(x[0] + y[0], joined(x[1], y[1])) for x, y in zip(row, v, strict=True) if x is not None and y is not None], None) for row in self.matrices[s]]
        cost, rope = v[START]
        found = cost, "".join(pieces(rope))
        if len(blocks) == 1:
            if len(self.solved) >= REMEMBERED:
                self.solved.clear()
            self.solved[blocks[0]] = found
        return found


@functools.lru_cache(maxsize=2)
def grammar(rules: tuple[tuple[int, int], ...]) -> Grammar:
    return Grammar(rules)


def damage(convs: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: the rows with faults put in by a checksum of conversation and turn.

    Of 20 rows one is dropped (its row stays with ``gone`` set, for its conversation), one loses its text, one its marks of
    ends, one is there twice and one is the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    body = F.when(k <= 1, F.lit("")).when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), body.alias("text"), (k == 0).alias("gone"), F.explode(rows).alias("__copy")).drop("__copy")


def _symbols(dup: Column) -> Column:
    """A row's symbol from ``initial``, ``end`` (its last character but white space) and whether it is a duplicate."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    return F.when((F.col("end") == "") | dup, F.lit("d")).when(F.col("end").isin(".", "!", "?"), letter).otherwise(F.upper(letter))


def _read(rows: DataFrame, gone: str | None) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    return x.withColumn("initial", F.substring("role", 1, 1)).withColumn("end", F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1))


def learn(rows: DataFrame, gone: str | None = None, rounds: int = 10, pairs: int = 64) -> tuple[tuple[int, int], ...]:
    """Re-Pair rules over all conversations; ``rounds`` of at most ``pairs`` rules each, those of a round by falling counts.

    Sequences are cut into blocks, and blocks that are equal are counted before they are shuffled and compressed once."""
    x = _read(rows, gone).where("not gone").select("conv_id", "turn", "initial", "end", F.xxhash64("role", "text").alias("h")).repartition("conv_id")
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "h").orderBy(F.col("turn").asc_nulls_first())))
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h")) - 1)
    x = x.select("conv_id", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", _symbols(F.col("n") > 1).alias("s"))
    blocks = x.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("all"))
    distinct = materialize(blocks.select(F.array_join(F.col("all.s"), "").alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("n")))
    rules: tuple[tuple[int, int], ...] = ()
    for _ in range(rounds):
        now = rules

        def adjacent(cols, now=now):
            g, seen = grammar(now), Counter()
            for seq, n in zip(cols["seq"], cols["n"], strict=True):
                ids = g.compressed(seq)
                for p in zip(ids, ids[1:]):
                    seen[p] += n
            return {"a": [a for a, _ in seen], "b": [b for _, b in seen], "n": list(seen.values())}

        found = arrow_map(distinct, adjacent, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        best = [(r["a"], r["b"]) for r in found.orderBy(F.desc("n"), "a", "b").limit(pairs).collect()]
        rules += tuple(p for p in best if p not in rules)
        if len(rules) == len(now):
            break
    return rules


class Waiting:
    """Rows in order, in memory up to a size and in a file of the task beyond."""

    def __init__(self):
        self.rows, self.size, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 100
        if self.size > SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
            self.file = None
        yield from self.rows


def edited(rows, audit: str) -> Iterator[tuple[str, str]]:
    """The rows after the edits."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = STEPS[state, role[0]]
        yield role, text


class Conversation:
    """What the rows of one conversation add up to."""

    def __init__(self, conv_id):
        self.conv_id, self.rows = conv_id, Waiting()
        self.blocks, self.symbols = [], []
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role: str, text: str, symbol: str, end: str) -> None:
        self.rows.add(role, text)
        self.symbols.append(symbol)
        if len(self.symbols) == BLOCK:
            self.blocks.append("".join(self.symbols))
            self.symbols = []
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.blank += end == ""
        self.duplicate += symbol == "d" and end != ""
        self.truncated += symbol.isupper()
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial

    def result(self, g: Grammar) -> tuple:
        blocks = [*self.blocks, "".join(self.symbols)] if self.symbols else self.blocks
        cost, audit = g.solve(blocks) if blocks else (0, "")
        digest, between = hashlib.sha256(), b""
        for role, text in edited(self.rows, audit):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _marked(rows: DataFrame, gone: str | None) -> DataFrame:
    """Rows with their symbols, those of a conversation together and in order."""
    x = _read(rows, gone).repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(turn)))
    return x.select("conv_id", "turn", "role", "text", "gone", "end", _symbols(F.col("n") > 1).alias("symbol"), "n").sortWithinPartitions("conv_id", turn, "role", "text", "n")


def _conversations(pieces_: Iterator, g: Grammar, give) -> Iterator:
    """Streams rows and gives ``give(conversation)`` for each as it ends."""
    now = None
    for cols in pieces_:
        for conv_id, turn, role, text, gone, end, symbol in zip(*(cols[c] for c in ("conv_id", "turn", "role", "text", "gone", "end", "symbol")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield give(now, g)
                now = Conversation(conv_id)
            if not gone:
                now.add(turn, role, text, symbol, end)
    if now is not None:
        yield give(now, g)


def _batched(rows: Iterator[tuple], names: tuple[str, ...], n: int = 512) -> Iterator[dict[str, list]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield dict(zip(names, zip(*held, strict=True), strict=True))
            held = []
    if held:
        yield dict(zip(names, zip(*held, strict=True), strict=True))


def report(rows: DataFrame, gone: str | None = None, rules: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """One row a conversation: faults found, the cheapest edits and the digest of the repaired rows."""
    rules = learn(rows, gone) if rules is None else rules

    def run(batches):
        yield from _batched(_conversations(batches, grammar(rules), Conversation.result), RESULT)

    kind = dict(rows.dtypes)["conv_id"]
    return arrow_stream(_marked(rows, gone), run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, gone: str | None = None, rules: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """The repaired rows: ``(conv_id, pos, role, text)``."""
    rules = learn(rows, gone) if rules is None else rules
    names = ("conv_id", "pos", "role", "text")

    def give(c, g):
        blocks = [*c.blocks, "".join(c.symbols)] if c.symbols else c.blocks
        return ((c.conv_id, i, *r) for i, r in enumerate(edited(c.rows, g.solve(blocks)[1] if blocks else "")))

    def run(batches):
        yield from _batched((r for rows_ in _conversations(batches, grammar(rules), give) for r in rows_), names)

    return arrow_stream(_marked(rows, gone), run, f"conv_id {dict(rows.dtypes)['conv_id']}, pos long, role string, text string")
