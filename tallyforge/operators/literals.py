"""Which of many literals a text contains: one automaton over all of them, tried once for each distinct text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ascii_lower(text: str) -> str:
    return "".join([c.lower() if "A" <= c <= "Z" else c for c in text])


def containing(texts: DataFrame, literals: Iterable[tuple[str, int]], fold: bool = False) -> DataFrame:
    """``text, id`` of every literal that each row of ``texts`` (one string column) contains; an empty literal is in every text.

    ``literals``: (literal, id), a settings table that fits a broadcast; several ids may share a literal. ``fold``: A-Z are
    compared without case. An automaton (Aho-Corasick) is made once a task, so the time follows the texts and the hits,
    not the number of literals.
    """
    by: dict[str, list[int]] = {}
    for literal, number in literals:
        by.setdefault(ascii_lower(literal) if fold else literal, []).append(number)
    shared = texts.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        import ahocorasick

        always = shared.value.get("", [])
        automaton = ahocorasick.Automaton()
        for literal, numbers in shared.value.items():
            if literal:
                automaton.add_word(literal, numbers)
        automaton.make_automaton()
        for batch in batches:
            found: dict[int, list[int]] = {}  # rows by id, so that what is done next with an id is done once a batch
            for i, text in enumerate(batch.column(0).to_pylist()):
                hits = set(always)
                if len(automaton):
                    hits.update(n for _, numbers in automaton.iter(ascii_lower(text) if fold else text) for n in numbers)
                for n in hits:
                    found.setdefault(n, []).append(i)
            rows = pa.array([i for some in found.values() for i in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([n for n, some in found.items() for _ in some], pa.int64())], names=["text", "id"])

    name = texts.columns[0]
    return texts.where(F.col(name).isNotNull()).mapInArrow(run, "text string, id long")


def first_contained(texts: DataFrame, literals: list[tuple[str, str, str]]) -> DataFrame:
    """``texts`` (two string columns: group and text) with ``value`` of the first of ``literals`` of the row's group that the
    text contains; rows without one are left out.

    ``literals``: (group, literal, value) in their order, a settings table that fits a broadcast. The hits of a text are
    weighed where they are found, so one row leaves the task however many there are.
    """
    by: dict[str, dict[str, int]] = {}
    for place, (group, literal, _) in enumerate(literals):
        by.setdefault(literal, {}).setdefault(group, place)
    shared = texts.sparkSession.sparkContext.broadcast((by, [value for _, _, value in literals]))

    def run(batches):
        import ahocorasick

        by, values = shared.value
        always = by.get("", {})
        automaton = ahocorasick.Automaton()
        for literal, places in by.items():
            if literal:
                automaton.add_word(literal, places)
        automaton.make_automaton()
        none = len(values)
        for batch in batches:
            rows, found = [], []
            for i, (group, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                first = always.get(group, none)
                if len(automaton):
                    first = min([first, *(places.get(group, none) for _, places in automaton.iter(text))])
                if first < none:
                    rows.append(i)
                    found.append(values[first])
            some = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(found, pa.string())], names=[*names, "value"])

    names = texts.columns
    both = F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()
    return texts.where(both).mapInArrow(run, f"`{names[0]}` string, `{names[1]}` string, value string")


#: What ends a literal run of a pattern; and how a group without flags or a look around begins.
SPECIAL = set("\\^$.|?*+()[]{}")
GROUP = re.compile(r"\((?:\?:|\?<[A-Za-z][A-Za-z0-9]*>)?(?!\?)")
BREAK = ["", ""]


def _joined(a: list[str], b: list[str]) -> list[str]:
    return [*a[:-1], a[-1] + b[0], *b[1:]]


def required_literal(pattern: str) -> str:
    """The longest text that every match of ``pattern`` must contain, as far as it can be told; else empty. Alternatives count
    for nothing, and neither does what may be absent."""
    if "\\Q" in pattern:
        return ""
    # literal runs, cut where anything else may stand between; and those of the groups around, with whether they have alternatives
    runs, choice, around, i = [""], False, [], 0
    while i < len(pattern):
        c, step, piece = pattern[i], 1, BREAK
        if c == "\\":
            step, literal = 2, pattern[i + 1 : i + 2]
            if pattern.startswith("\\k<", i):
                step = max(3, pattern.find(">", i) - i + 1)
            elif not literal.isalnum():
                piece = [literal]
            elif literal not in "dDwWsSbBAzZ":  # classes and borders end a run, what is written by number or name gives up
                return ""
        elif c == "[":
            # a closing bracket that comes first is a member; a set is skipped as a whole, nested ones give up
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0 or "[" in pattern[i + 1 : end] or "\\" in pattern[i + 1 : end] or "&&" in pattern[i + 1 : end]:
                return ""
            step = end - i + 1
        elif c == "{":
            step = max(1, pattern.find("}", i) - i + 1)
        elif c == "(":
            if not (begin := GROUP.match(pattern, i)):
                return ""
            around.append((runs, choice))
            runs, choice, i = [""], False, begin.end()
            continue
        elif c == "|":
            choice = True
        elif c == ")":
            if not around:
                return ""
            piece = BREAK if choice else runs
            runs, choice = around.pop()
        elif c not in SPECIAL:
            piece = [c]
        i += step
        runs = _joined(runs, BREAK if pattern[i : i + 1] in ("?", "*", "{") else piece)
    return "" if around or choice else max(runs, key=len)


def pieces_of(texts: DataFrame, lengths: list[int], fold: bool = False, rows_each: int = 1 << 16) -> DataFrame:
    """``text, piece``: the distinct runs of code points of the given lengths in each row of ``texts`` (one string column)."""

    def run(batches):
        for batch in batches:
            found, pieces = [], []
            for text in batch.column(0).to_pylist():
                folded = ascii_lower(text) if fold else text
                some = {folded[i : i + n] for n in lengths for i in range(len(folded) - n + 1)}
                found += [text] * len(some)
                pieces += some
                if len(found) >= rows_each:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(pieces, pa.string())], names=["text", "piece"])
                    found, pieces = [], []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(pieces, pa.string())], names=["text", "piece"])

    name = texts.columns[0]
    return texts.where(F.col(name).isNotNull()).mapInArrow(run, "text string, piece string")
