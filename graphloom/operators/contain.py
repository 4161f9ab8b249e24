"""Which texts hold which patterns: all patterns in one pass over a text.

Patterns are cut into parts of bounded size. A part is an Aho-Corasick automaton in every task, which a text runs through
once, so the cost follows the texts and their hits, not texts times patterns; no text is shuffled or cut into pieces.
For regexes the automaton looks for the strings that a match can't do without, as an and/or plan read from the parsed
regex, and only patterns whose plan holds are searched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES, REMEMBERED, ALTERNATIVES = 1 << 20, 1 << 23, 16
Plan = str | tuple | bool  # a string; ("and", plans); ("or", plans); True: nothing is known


@lru_cache(4096)
def compiled(pattern: str) -> re.Pattern | None:
    """None where the pattern is no regex; it then stands for itself."""
    try:
        return re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None


def _all(plans: Iterable[Plan]) -> Plan:
    own = tuple(dict.fromkeys(p for p in plans if p is not True))
    return True if not own else own[0] if len(own) == 1 else ("and", own)


def _any(plans: Iterable[Plan]) -> Plan:
    own = tuple(dict.fromkeys(plans))
    return True if True in own or not own else own[0] if len(own) == 1 else ("or", own)


def _plan(items, flags: int) -> Plan:
    """What a sequence of a parsed regex needs: its runs of fixed characters, and what its groups need."""
    c, needs, run = re._constants, [], {""}

    def flush() -> None:
        nonlocal run
        needs.append(_any(sorted(run)) if "" not in run else True)
        run = {""}

    def fixed(code: int) -> bool:
        """A letter that is met in either case is no fixed character."""
        return not flags & re.IGNORECASE or (code < 128 and not chr(code).isalpha())

    for op, value in items:
        if op is c.LITERAL and fixed(value):
            run = {r + chr(value) for r in run}
        elif op is c.IN and all(o is c.LITERAL and fixed(v) for o, v in value) and len(value) * len(run) <= ALTERNATIVES:
            run = {r + chr(v) for r in run for _, v in value}
        elif op is c.AT:
            continue
        else:
            flush()
            if op is c.BRANCH:
                needs.append(_any(_plan(x, flags) for x in value[1]))
            elif op is c.SUBPATTERN:
                needs.append(_plan(value[3], (flags | value[1]) & ~value[2]))
            elif op is c.ATOMIC_GROUP:
                needs.append(_plan(value, flags))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
                needs.append(_plan(value[2], flags))
            elif op is c.ASSERT:
                needs.append(_plan(value[1], flags))
            elif op is c.GROUPREF_EXISTS:
                needs.append(_any([_plan(value[1], flags), _plan(value[2] or [], flags)]))
    flush()
    return _all(needs)


@lru_cache(4096)
def plan(pattern: str) -> Plan:
    """The plan of a regex; a pattern that is none needs itself."""
    if compiled(pattern) is None:
        return pattern
    parsed = re._parser.parse(pattern)
    return _plan(parsed, parsed.state.flags)


def strings(needs: Plan) -> set[str]:
    return {needs} if isinstance(needs, str) else set() if needs is True else set().union(*map(strings, needs[1]))


def holds(needs: Plan, found: set[str]) -> bool:
    if needs is True or isinstance(needs, str):
        return needs is True or needs in found
    return (all if needs[0] == "and" else any)(holds(p, found) for p in needs[1])


class Matcher:
    """The patterns that a text holds, for one part of the patterns; texts seen lately are remembered."""

    def __init__(self, patterns: list[str], regex: bool):
        import ahocorasick

        self.regex, self.memo, self.held = regex, {}, 0
        self.plans = {p: plan(p) for p in patterns} if regex else {}
        self.loose = [p for p, needs in self.plans.items() if needs is True]
        self.of: dict[str, list[str]] = {}
        for p in patterns:
            for s in strings(self.plans[p]) if regex else (p,):
                self.of.setdefault(s, []).append(p)
        self.automaton = ahocorasick.Automaton()
        for s in self.of:
            self.automaton.add_word(s, s)
        if self.of:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[str]:
        if text not in self.memo:
            if self.held > REMEMBERED:
                self.memo, self.held = {}, 0
            self.memo[text] = self._find(text)
            self.held += len(text) + 64 + 8 * len(self.memo[text])
        return self.memo[text]

    def _find(self, text: str) -> list[str]:
        found = {s for _, s in self.automaton.iter(text)} if self.of else set()
        if not self.regex:
            return sorted(found)
        may = {p for s in found for p in self.of[s] if holds(self.plans[p], found)}
        return sorted(p for p in [*may, *self.loose] if (p in text if (r := compiled(p)) is None else r.search(text)))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, patterns: Callable[[], list[str]], regex: bool) -> Matcher:
    """A worker's automaton of a part; a few are held at a time."""
    if name not in _matchers:
        if len(_matchers) > 2:
            _matchers.clear()
        _matchers[name] = Matcher(patterns(), regex)
    return _matchers[name]


def with_patterns(rows: DataFrame, text: str, patterns: DataFrame, regex: bool = False) -> DataFrame:
    """The rows with `held`: the distinct patterns(pattern) that column `text` holds. Empty patterns match nothing.

    Only one part of the patterns at a time passes through the driver; the rows are gone through once for each part.
    """
    spark = rows.sparkSession
    own = patterns.select("pattern").where("pattern <> ''").distinct()
    size = own.agg(F.sum(F.octet_length("pattern") + 32).alias("size")).first()["size"] or 0
    parts = max(1, -(-size // PART_BYTES))
    out = rows.withColumn("held", F.array().cast("array<string>"))
    schema = T.StructType([*rows.schema.fields, T.StructField("held", T.ArrayType(T.StringType()))])
    for part in range(parts):
        some = own if parts == 1 else own.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(sorted(r["pattern"] for r in some.collect()))
        out = out.mapInArrow(_pass(uuid.uuid4().hex, shared, regex, text), schema)
    return out


def _pass(name: str, shared, regex: bool, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(name, lambda: shared.value, regex)
        for b in batches:
            at = b.schema.get_field_index("held")
            texts, before = b.column(b.schema.get_field_index(text)).to_pylist(), b.column(at).to_pylist()
            held = [x + find(t) if t else x for t, x in zip(texts, before, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(held, b.schema.field(at).type))

    return run


def loose_patterns(patterns: DataFrame) -> DataFrame:
    """Regexes that can match without any fixed character, such as `\\d+` or the empty match: searched in every text."""

    @F.pandas_udf("boolean")
    def loose(ps):
        return ps.map(lambda p: plan(p) is True)

    return patterns.select("pattern").distinct().where(loose(F.col("pattern")))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (text, pattern) of texts(text) that contain a pattern of patterns(pattern)."""
    own = texts.select("text").where("text <> ''").distinct()
    return with_patterns(own, "text", patterns).select("text", F.explode("held").alias("pattern"))
