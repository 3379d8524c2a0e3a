"""Conversation structure repair: cheapest edits by a dynamic program over grammar-compressed turn sequences.

Turns are put in order over all conversations at once (a range partitioning, so that one very long conversation is many
tasks) and become one symbol each: the initial of their role and their first fault. Symbols are joined to blocks of at
most BLOCK turns, and Re-Pair replaces frequent pairs of symbols by rules. Every round counts pairs over the
distinct blocks and replaces the most frequent ones that share no symbol with each other; rules are few (ROUNDS x PAIRS
at most), and what stays unreplaced does not change the result. Each rule has one matrix: for two states of the target
pattern the least cost and, of the cheapest edits, the least audit as a rope that shares its parts. Matrices are made
bottom-up from those of the rule's two halves and are used by all conversations, which multiply those of their symbols.

Least audits compose: a part's audits for the same two states at the same cost never are prefixes of each other (they
edit the same turns, so the longer one would have more insertions and cost more).

The order of a conversation's edits and the digest of its repaired text need its turns one after the other: they pass a
task as a stream, of which only the symbols and the audit (a letter a turn) are held. A conversation with a third of all
turns is one such stream, as SHA-256 can only be computed in sequence.

Defined results: null roles and texts count as one space; turns are ordered by turn (null first), role, the text's first
32 characters, its SHA-256; rows that repeat a turn whole are duplicates; a null conv_id is one conversation; a
conversation without turns has no gaps, no cost and an empty audit; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, spool

#: White space of the contract.
SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Bits of the length of a block.
BLOCK_BITS = 12
ROUNDS, PAIRS = 8, 64
#: Characters of the first rules.
FIRST_RULE = 0x4E00
#: Places in ``(s?(ua)+)?``: before it, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Rope:
    """A text that shares its parts; equal lengths and hashes count as equal."""

    __slots__ = ("hash", "left", "length", "power", "right", "text")
    PRIME, BASE, LEAF = (1 << 61) - 1, 911_382_323_912_345_677, 64

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.length, self.power = len(text), pow(self.BASE, len(text), self.PRIME)
            self.hash = reduce(lambda h, c: (h * self.BASE + ord(c)) % self.PRIME, text, 0)
        else:
            self.length, self.power = left.length + right.length, left.power * right.power % self.PRIME
            self.hash = (left.hash * right.power + right.hash) % self.PRIME

    def __add__(self, other: Rope) -> Rope:
        if not other.length:
            return self
        if not self.length:
            return other
        if self.length + other.length <= self.LEAF:
            return Rope(self.text + other.text)
        return Rope("", self, other)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def leaves(self) -> Iterator[str]:
        open_ = [self]
        while open_:
            x = open_.pop()
            if x.left is None:
                yield x.text
            else:
                open_ += [x.right, x.left]

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or x.length == y.length and x.hash == y.hash:
                continue
            if x.left is None and y.left is None:
                n = min(x.length, y.length)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.length > n:
                    a.append(Rope(x.text[n:]))
                elif y.length > n:
                    b.append(Rope(y.text[n:]))
            elif y.left is None or x.left is not None and x.length >= y.length:
                a += [x.right, x.left]
                b.append(y)
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b)


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]
INSERTIONS = ((0, None, 1, 2), (None, 0, 1, 2), (None, None, 0, 1), (None, None, 1, 0))
INSERTED: Matrix = [[None if n is None else (n * INSERT, Rope("I" * n)) for n in row] for row in INSERTIONS]


def better(x: Entry, y: Entry) -> Entry:
    if x is None or y is None:
        return y if x is None else x
    return y if y[0] < x[0] or y[0] == x[0] and y[1] < x[1] else x


def times_vector(v: list[Entry], m: Matrix) -> list[Entry]:
    out: list[Entry] = [None] * 4
    for p in range(4):
        if v[p] is not None:
            for q in range(4):
                if m[p][q] is not None and (out[q] is None or v[p][0] + m[p][q][0] <= out[q][0]):
                    out[q] = better(out[q], (v[p][0] + m[p][q][0], v[p][1] + m[p][q][1]))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [times_vector(row, b) for row in a]


def turn_matrix(symbol: str) -> Matrix:
    """Insertions before a turn, then its edit. ``symbol``: b or d of a turn that must go, else the initial of its role (o
    for others), upper case if it is truncated."""
    edits: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        edits[p][p] = (DELETE, Rope("D"))
    if symbol not in "bd":
        more = TRUNCATED if symbol.isupper() else 0
        role = symbol.lower()
        for p, q, own in ((START, SYSTEM, "s"), (START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")):
            if role == own:
                edits[p][q] = (KEEP + more, Rope("K"))
            elif q in ROLES:
                edits[p][q] = (REROLE + more, Rope("R"))
    return times(INSERTED, edits)


def rule_matrices(rules: list[str]) -> dict[str, Matrix]:
    """By symbol. The n-th rule is a pair of earlier symbols."""
    out = {c: turn_matrix(c) for c in "bdsuaoSUAO"}
    for n, (left, right) in enumerate(rules):
        out[chr(FIRST_RULE + n)] = times(out[left], out[right])
    return out


def cheapest(symbols: Iterator[str], matrices: dict[str, Matrix]) -> tuple[int, str]:
    """Cost and audit of a sequence of symbols."""
    v: list[Entry] = [(0, Rope()), None, None, None]
    for c in symbols:
        v = times_vector(v, matrices[c])
    v = times_vector(v, INSERTED)
    cost, audit = better(v[START], v[ASSISTANT])
    return cost, str(audit)


class Repaired:
    """Replays an audit over turns as they come and hashes what it leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "replace"))
        self.first = False

    def _next(self) -> None:
        self.place = ASSISTANT if self.place == USER else USER

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._next()
            self._put(ROLES[self.place], "")

    def turn(self, role: str, text: str) -> None:
        self.insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.place = SYSTEM
        else:
            self._next()
        self._put(ROLES[self.place] if edit == "R" else role, text)

    def digest(self) -> str:
        self.insertions()
        return self.sha.hexdigest()


class Conversation:
    """What is held of the conversation that streams by: blocks come before turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.raw, self.symbols, self.repaired = conv_id, [], [], None
        self.n, self.illegal, self.before, self.turns, self.least, self.last = 0, 0, None, 0, None, None

    def block(self, raw: str, symbols: str) -> None:
        self.raw.append(raw)
        self.symbols.append(symbols)

    def solve(self, matrices: dict[str, Matrix]) -> None:
        self.raw = "".join(self.raw)
        self.cost, audit = cheapest((c for s in self.symbols for c in s), matrices)
        self.symbols, self.repaired = [], Repaired(audit)

    def turn(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        self.illegal += self.n > 0 and self.before + initial not in ("su", "ua", "au")
        self.n, self.before = self.n + 1, initial
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.repaired.turn(role, text)

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        faults = (self.raw.count("b"), self.raw.count("d"), sum(map(self.raw.count, "SUAO")))
        return self.conv_id, gaps, *faults, self.illegal, self.cost, self.repaired.audit, self.repaired.digest()


def _trimmed() -> Column:
    return F.rtrim(F.col("text"), F.lit(SPACE))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, which grows by conversation and turn, and ``sha``, written once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)
    rows = rows.withColumns({"head": F.left("text", F.lit(32)), "sha": F.sha2("text", 256), "n": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "head", "sha", "n"]  # the last one deals out rows that are repeated very often
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return spool(rows.drop("head", "n"), "turns")


def symbol_blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, raw``: symbols of at most BLOCK turns in order."""
    first = turns.groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("h"), "first")
    initial = F.left("role", F.lit(1))
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = F.right(_trimmed(), F.lit(1)).isin(".", "!", "?")
    kind = F.when(_trimmed() == "", "b").otherwise(F.when(whole, own).otherwise(F.upper(own)))
    marks = turns.select("conv_id", "role", "sha", "pos", kind.alias("kind"))
    same = marks.conv_id.eqNullSafe(first.c) & (marks.role == first.r) & (marks.sha == first.h)
    symbol = F.when((F.col("kind") != "b") & (F.col("pos") > F.col("first")), "d").otherwise(F.col("kind"))
    marks = marks.join(first, same, "left").select("conv_id", "pos", symbol.alias("x"))
    blocks = marks.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("t"))
    return blocks.select("conv_id", F.col("t")[0]["pos"].alias("pos"), F.array_join(F.transform("t", lambda t: t["x"]), "").alias("raw"))


def _replaced(text: Column, rules: list[str]) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[1]), F.lit(chr(FIRST_RULE + r[0]))), enumerate(rules), text)


def grammar(blocks: DataFrame, rounds: int = ROUNDS) -> list[str]:
    """Re-Pair rules, each a pair of symbols, over the distinct blocks by how often they occur."""
    distinct = spool(blocks.groupBy("raw").agg(F.count("*").alias("n")), "sequences")
    rules: list[str] = []
    for _ in range(rounds):
        c = F.split(_replaced(F.col("raw"), rules), "")
        now = distinct.select(c.alias("c"), "n").where("size(c) > 1")
        pairs = now.select("n", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> c[i - 1] || c[i])")).alias("pair"))
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        used: set[str] = set()
        for r in counts.orderBy(F.desc("n"), "pair").limit(PAIRS).collect():
            if not used & set(r.pair):
                rules.append(r.pair)
                used |= set(r.pair)
        if not used:
            break
    return rules


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Gaps, faults, cheapest edits and the digest of the repaired text of each conversation of ``turns`` (conv_id, turn, role,
    text), and of each other conv_id in ``conversations``."""
    rows = in_order(turns)
    blocks = spool(symbol_blocks(rows), "blocks")
    rules = grammar(blocks)
    matrices = rule_matrices(rules)

    def run(batches):
        hold()
        now = None
        for batch in batches:
            done = []
            for conv_id, kind, turn, role, text, raw, symbols in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "raw", "symbols"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(_finished(now, matrices))
                    now = Conversation(conv_id)
                if kind == 1:
                    now.block(raw, symbols)
                elif kind == 2:
                    if now.repaired is None:
                        now.solve(matrices)
                    now.turn(turn, role, text)
            if done:
                yield _batch(done)
        if now is not None:
            yield _batch([_finished(now, matrices)])

    ids = (conversations if conversations is not None else turns).select(F.col("conv_id").cast("long")).distinct()
    names = ["conv_id", "kind", "pos", "turn", "role", "text", "raw", "symbols"]
    none = {"pos": F.lit(None).cast("long"), "turn": F.lit(None).cast("long")} | {c: F.lit(None).cast("string") for c in ("role", "text", "raw", "symbols")}

    def part(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumns({c: x for c, x in none.items() if c not in df.columns}).withColumn("kind", F.lit(kind)).select(*names)

    parts = [part(ids, 0), part(blocks.withColumn("symbols", _replaced(F.col("raw"), rules)), 1), part(rows, 2)]
    stream = reduce(DataFrame.unionByName, parts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "pos")
    return stream.select([c for c in names if c != "pos"]).mapInArrow(run, OUT)


def _finished(now: Conversation, matrices: dict[str, Matrix]) -> tuple:
    if now.repaired is None:
        now.solve(matrices)
    return now.row()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with one in four damaged by the CRC-32 of ``conv_id:turn``."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def report(turns: DataFrame) -> DataFrame:
    return repair(damage(turns), turns)


def _sql() -> str:
    """The same turn by turn, with cost, audit and repaired text in one struct for each place of the pattern."""

    def put(v: str, cost: str, letter: str, text: str) -> str:
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {v}.r || {text}}}"

    def insert(v: str, *roles: str) -> str:
        return put(v, str(INSERT * len(roles)), "I" * len(roles), "'" + "".join(f"{r}:' || chr(10) || '" for r in roles) + "'")

    def to(v: str, role: str) -> str:
        own = f"x = '{role[0]}'"
        cost = f"CASE WHEN must THEN 1000000000 WHEN {own} THEN 0 ELSE 1 END + CASE WHEN cut THEN {TRUNCATED} ELSE 0 END"
        line = f"CASE WHEN {own} THEN role ELSE '{role}' END || ':' || text || chr(10)"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || CASE WHEN {own} THEN 'K' ELSE 'R' END, 'r': {v}.r || {line}}}"

    def delete(v: str) -> str:
        return put(v, str(DELETE), "D", "''")

    system = put("i0", f"CASE WHEN must OR x <> 's' THEN 1000000000 ELSE 0 END + CASE WHEN cut THEN {TRUNCATED} ELSE 0 END", "K", "role || ':' || text || chr(10)")
    before = f"""v0 AS i0, v1 AS i1,
         least(v2, {insert('v0', 'user')}, {insert('v1', 'user')}, {insert('v3', 'user')}) AS i2,
         least(v3, {insert('v2', 'assistant')}, {insert('v0', 'user', 'assistant')}, {insert('v1', 'user', 'assistant')}) AS i3"""
    never = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    return f"""
WITH RECURSIVE
crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda b: ascii(b)::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS how
  FROM conversations, crcs),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS n
  FROM raw WHERE how <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), sha256(text), n) AS i FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS x, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open_,
         left(role, 1) || lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS two
  FROM numbered),
faults AS (SELECT *, blank OR again AS must, open_ AND NOT blank AND NOT again AS cut FROM marked),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS v0, {never} AS v1, {never} AS v2, {never} AS v3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {delete('i0')}, least({delete('i1')}, {system}),
         least({delete('i2')}, {to('i0', 'user')}, {to('i1', 'user')}, {to('i3', 'user')}), least({delete('i3')}, {to('i2', 'assistant')})
  FROM (SELECT f.conv_id, f.i, f.x, f.role, f.text, f.must, f.cut, {before}
        FROM steps s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)),
ends AS (
  SELECT conv_id, least(i0, i3) AS best
  FROM (SELECT conv_id, {before} FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('us', 'au', 'ua')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(CASE WHEN best.r = '' THEN '' ELSE left(best.r, length(best.r) - 1) END) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = _sql()
