"""Static-analysis rules as data: the YAML form of pattern rules, run over statements of lexed source.

A pattern becomes a regular expression over a statement's code. `$NAME` is an expression, and the same text wherever it stands again, in
other parts of the rule too; `...` is anything within the brackets around it; strings are equal whatever their quotes; white space may be
missing. Every match is a row with its place and bindings, those within other matches too; comments and strings are no code. A rule's parts
are joined: by equal bindings, and by containment of places.

`pattern-inside` and `pattern-not-inside` hold for what lies within a match. A line of `...` stands for any statements of the function
around, or of the file outside functions; `for (...) { ... }` and the like are blocks, with what they have to hold.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import path_regex
from . import rules, source
from .modules import ARGUMENT, NAME
from .source import HIDDEN, LINE, MARK

#: A comparison of a captured value with a number.
COMPARISON = re.compile(r"^\s*(?:int\()?\$(\w+)\)?\s*(<=|>=|==|!=|<|>)\s*(-?[0-9.]+)\s*$")
_TOKEN = re.compile(r"""\.\.\.|\$\.\.\.[A-Z_0-9]+|\$[A-Z_][A-Z0-9_]*|"[^"]*"|'[^']*'|`[^`]*`|=>|[=!]==?|[<>]=|&&|\|\||\?\?|\w+|\s+|.""", re.S)
_BLOCK = re.compile(r"^\s*(for|while|if|switch|try)\s*(\(\s*\.\.\.\s*\))?\s*\{(.*?)\}\s*(?:catch\s*(?:\(.*?\))?\s*\{\s*\.\.\.\s*\}\s*)?$", re.S)


def load_rules(folder: str) -> list[dict]:
    """The rules of all YAML files of a folder, by name of file."""
    import yaml

    return [rule for path in sorted(Path(folder).glob("*.yaml")) for rule in (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("rules") or []]


class Pattern(NamedTuple):
    """A regular expression over code, to be put into one group, and the group of each place of a metavariable.

    items: where a metavariable begins an item anywhere in a list, the group of the list, the pattern of an item, and whether it has to be the last; each item that fits is a match."""

    regex: str
    places: tuple[tuple[str, int], ...]
    items: tuple[int, Pattern, bool] | None = None

    @property
    def names(self) -> set[str]:
        return {name for name, _ in self.places} | (self.items[1].names if self.items else set())


class _Builder:
    """Writes a pattern's regular expression. Repeats are possessive or go by whole items, as long texts need it; group 1 is the whole match."""

    def __init__(self, groups: int = 1) -> None:
        self.groups, self.places, self.items = groups, [], None

    def _group(self) -> int:
        self.groups += 1
        return self.groups

    def _pair(self) -> str:
        g = self._group()
        return rf"[(\[{{]({MARK})[\s\S]*?[)\]}}]\{g}"

    def parts(self, but: str, repeat: str) -> str:
        """Text and whole brackets, without these characters outside of them."""
        return rf"(?:[^()\[\]{{}}{but}]++|{self._pair()}){repeat}"

    def captured(self, name: str, regex) -> str:
        self.places.append((name, self._group()))
        return f"({regex()})"

    def expression(self) -> str:
        """Names, literals, calls and members in a chain, perhaps behind an operator."""
        first = rf"(?:{NAME}|\d[\w.]*|[\"']{HIDDEN}*+[\"']|`[^`]*+`|{self._pair()})"
        return rf"(?:(?:new|await|typeof)\s+|[!~-]\s*)?{first}(?:\s*\??\.\s*{NAME}|{self._pair()})*"

    def template(self, text: str) -> str:
        out = "`"
        for token in re.findall(r"\.\.\.|\$\{|\}|\$[A-Z_][A-Z0-9_]*|[^.$}]+|.", text):
            if token == "...":
                out += "[^`]*?"
            elif token.startswith("$") and len(token) > 1 and token != "${":
                inner = lambda: self.captured(token[1:], self.expression)  # noqa: B023, E731
                out += rf"\s*{inner()}\s*" if out.endswith(f"{MARK}") else rf"\$\{{{MARK}\s*{inner()}\s*\}}{MARK}"
            elif token in ("${", "}"):
                out += ("\\$\\{" if token == "${" else "\\}") + MARK
            elif token.strip():
                out += re.escape(source.hidden(token.strip()))
        return out + "`"

    def build(self, pattern: str, item: bool = False) -> Pattern:
        """item: the pattern is an item of a list."""
        tokens = [t for t in _TOKEN.findall(pattern.strip()) if not t.isspace()]
        out, opened, i, edge = "", [], 0, "," if item else ""
        while i < len(tokens):
            t = tokens[i]
            before, after = tokens[i - 1] if i else edge, tokens[i + 1] if i + 1 < len(tokens) else edge
            if t == "..." or t.startswith("$..."):
                if after == "," and opened and re.match(r"\$[A-Z_]", tokens[i + 2]):
                    if self.items:
                        raise ValueError(f"two lists with a metavariable anywhere: {pattern}")
                    end = _item_end(tokens, i + 2)
                    last = tokens[end] != ","
                    self.items = (self._group(), _Builder(0).build(" ".join(tokens[i + 2:end]), True), last)
                    out += f"({self.parts('', '*+')})"
                    i = end - 1 if last else end + 1  # on to what closes the list
                elif after == ",":
                    out, i = out + rf"(?:{self.parts(',', '*+')},)*?\s*", i + 1
                elif opened:
                    out += self.parts("", "*+")
                else:  # the rest of a statement
                    out += self.parts(";", "*+")
            elif t == "," and after == "..." and i + 2 < len(tokens) and tokens[i + 2] in ")]}":
                out, i = out + rf"\s*(?:,{self.parts(',', '*+')})*+", i + 1
            elif t.startswith("$") and len(t) > 1:
                if before == ".":
                    out += self.captured(t[1:], lambda: NAME)
                elif before and before in "([,:" or before == "..." or (before == "{" and after in (",", "}")):
                    whole = after and after in ",)]}"
                    out += r"\s*" + self.captured(t[1:], lambda: self.parts(",;", "++") if whole else self.expression())  # noqa: B023
                else:
                    out += ("" if out else r"(?<![\w$.])") + self.captured(t[1:], self.expression)
                if after and (after[0].isalnum() or after[0] == "$"):
                    out += r"\s+"
            elif t[0] in "\"'" and len(t) > 1:
                inner = t[1:-1]
                if inner == "...":
                    out += rf"[\"'`]{HIDDEN}*+[\"'`]"
                elif re.fullmatch(r"\$[A-Z_][A-Z0-9_]*", inner):
                    out += rf"[\"'`]{self.captured(inner[1:], lambda: HIDDEN + '*+')}[\"'`]"
                else:
                    out += rf"[\"'`]{re.escape(source.hidden(inner))}[\"'`]"
            elif t[0] == "`" and len(t) > 1:
                out += self.template(t[1:-1])
            elif t in "([{":
                opened.append(self._group())
                out += rf"\s*\{t}({MARK})\s*"
            elif t in ")]}" and opened:
                out += rf"\s*,?\s*\{t}\{opened.pop()}"
            elif t in ")]}" or t == "{":
                out += rf"\s*\{t}{MARK}"
            elif t == "=":
                # What is declared may have a type.
                out += r"(?:\s*:[^=;(){}]+)?\s*(?<![=!<>])=(?![=>])\s*"
            elif re.match(r"\w", t):
                out += rf"(?<![\w${'' if out else '.'}]){t}(?![\w$])" + (r"\s*+" if after and re.match(r"[\w$\"'`]", after) else "")
            elif t == ";":
                out += r"\s*;?"
            else:
                guard = r"(?<![=!<>])" if t[0] in "=!<>" else ""
                out += rf"\s*{guard}{re.escape(t)}" + ("(?![=>])" if t[0] in "=!<>" else "") + r"\s*"
            i += 1
        return Pattern(out, tuple(self.places), self.items)


def required(pattern: str) -> set[str]:
    """Words and strings that the code of every match contains."""
    tokens = [t for t in _TOKEN.findall(pattern) if not t.isspace()]
    strings = {source.hidden(t[1:-1]) for t in tokens if t[0] in "\"'" and len(t) > 2 and t[1:-1] != "..." and "$" not in t}
    return strings | {t for t in tokens if re.fullmatch(r"[A-Za-z_]\w*", t)}


def _item_end(tokens: list[str], start: int) -> int:
    """Where the item that starts here ends: at a comma or what closes the list."""
    depth = 0
    for i in range(start, len(tokens)):
        if not depth and tokens[i] in (",", ")", "]", "}"):
            return i
        depth += (tokens[i] in ("(", "[", "{")) - (tokens[i] in (")", "]", "}"))
    raise ValueError(f"a list without an end: {' '.join(tokens)}")


def compiled(pattern: str) -> Pattern:
    return _Builder().build(pattern)


def _place(line_no: Column, text: Column) -> Column:
    """The place behind so much of a statement's code."""
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (line_no + lines).cast("long") * LINE + F.char_length(F.substring_index(text, "\n", -1))


def matches(stated: DataFrame, pattern: str, raw: bool = False) -> DataFrame:
    """(file, first, last, values): each match of the pattern in a statement, with its first and last place and its bindings; those that begin within others too.

    raw: a regular expression over lines as they are, whose matches are whole statements."""
    if raw:
        hit = stated.where(F.col("line").rlike(pattern))
        return hit.select("file", (F.col("line_no").cast("long") * LINE).alias("first"), ((F.col("last").cast("long") + 1) * LINE - 1).alias("last"), F.create_map().cast("map<string,string>").alias("values"))
    made = compiled(pattern)
    # Words and strings that every match has are sought first, which is much cheaper than trying the pattern at every place.
    for word in sorted(required(pattern), key=len, reverse=True):
        stated = stated.where(F.contains("code", F.lit(word)))
    ahead = f"(?=({made.regex}))"
    groups = list(dict.fromkeys([g for _, g in made.places] + ([made.items[0]] if made.items else [])))
    # One pass puts what matches, and its groups, before each place where it matches; between them stands the text itself.
    pieces = F.split(F.regexp_replace("code", ahead, source.FREE + "".join(f"${g}{source.FREE}" for g in [1, *groups])), source.FREE, -1)
    step = len(groups) + 2
    cut = stated.select("file", "line_no", pieces.alias("_pieces")).withColumn("_n", (F.size("_pieces") - 1) / step).where("_n > 0")
    each = F.transform(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), lambda i: F.struct(
        F.array_join(F.transform(F.sequence(F.lit(0), i), lambda j: F.get("_pieces", j * step)), "").alias("before"),
        *(F.get("_pieces", i * step + 1 + k).alias(name) for k, name in enumerate(["whole", *(f"g{g}" for g in groups)])),
    ))
    found = cut.select("file", "line_no", F.explode(each).alias("_m")).withColumn("_before", F.col("_m.before"))
    value = lambda g: F.trim(F.regexp_replace(source.plain(F.col(f"_m.g{g}")), r"\s+", " "))
    first = dict(reversed(made.places))
    for name, g in made.places:  # the same text wherever a name stands
        if g != first[name]:
            found = found.where(value(g) == value(first[name]))
    bound = [(name, value(g)) for name, g in first.items()]
    if made.items:
        group, item, last = made.items
        listed = F.regexp_extract_all(F.col(f"_m.g{group}"), F.lit(ARGUMENT), F.lit(0))
        found = found.withColumn("_item", F.explode(F.slice(listed, -1, 1) if last else listed)).where(F.col("_item").rlike(rf"^\s*{item.regex}\s*$"))
        for name, g in item.places:
            more = F.trim(F.regexp_replace(source.plain(F.regexp_extract("_item", rf"^\s*{item.regex}\s*$", g)), r"\s+", " "))
            known = dict(bound).get(name)
            if known is None:
                bound.append((name, more))
            else:
                found = found.where(more == known)
    values = F.create_map(*(c for name, v in bound for c in (F.lit(name), v))) if bound else F.create_map().cast("map<string,string>")
    return found.select("file", _place(F.col("line_no"), F.col("_before")).alias("first"), (_place(F.col("line_no"), F.concat("_before", "_m.whole")) - 1).alias("last"), values.alias("values"))


class _Rows(NamedTuple):
    """Matches and the names that all of them bind."""

    rows: DataFrame
    names: frozenset


class _Run:
    """One run of rules: the statements, and the nested spans of functions and of blocks. A pattern's matches are sought once, and kept."""

    def __init__(self, stated: DataFrame, owned: DataFrame, blocks: DataFrame | None, keep=lambda hits: hits):
        self.stated, self.blocks, self.keep, self.known = stated, blocks, keep, {}
        self.functions = owned.select("file", "depth", (F.col("start_line").cast("long") * LINE).alias("first"), ((F.col("end_line").cast("long") + 1) * LINE - 1).alias("last")).dropDuplicates(["file", "depth", "first"])

    def within(self, globs: list[str]) -> _Run:
        """The run over files that one of the globs fits."""
        out = object.__new__(_Run)
        out.keep, out.known = self.keep, {}
        out.stated, out.blocks, out.functions = self.stated.where(F.col("file").rlike("|".join(path_regex(g, recursive=True) for g in globs))), self.blocks, self.functions
        return out

    def hits(self, pattern: str, raw: bool = False) -> DataFrame:
        """`matches` of a pattern, the same table for all rules that have it."""
        if (pattern, raw) not in self.known:
            self.known[pattern, raw] = self.keep(matches(self.stated, pattern, raw))
        return self.known[pattern, raw]

    def _own(self, rows: DataFrame) -> DataFrame:
        """rows with the function around each, or the whole file, as _from and _to."""
        spans = self.functions.select("file", "depth", "first", "last", F.col("first").alias("_from"), F.col("last").alias("_to"))
        found = source.innermost(rows.withColumn("at", F.col("first")).withColumnsRenamed({"first": "_first", "last": "_last"}), spans)
        named = found.drop("at", "first", "last", "depth").withColumnsRenamed({"_first": "first", "_last": "last"})
        return named.withColumn("_to", F.coalesce("_to", F.lit((1 << 62)))).withColumn("_from", F.coalesce("_from", F.lit(0).cast("long")))

    def _scoped(self, step: str) -> _Rows:
        """Matches of a step as (file, _from, _a, _z, _more): once for each function around and once for the file."""
        hit = self.hits(step)
        spans = self.functions.select("file", "depth", "first", "last", F.col("first").alias("_from"))
        inner = source.around(hit.withColumn("at", F.col("first")), spans).select("file", "at", "_from")
        inner = hit.join(inner.withColumnRenamed("at", "first"), ["file", "first"])
        every = inner.unionByName(hit.withColumn("_from", F.lit(0).cast("long")))
        return _Rows(every.select("file", "_from", F.col("first").alias("_a"), F.col("last").alias("_z"), F.col("values").alias("_more")), frozenset(compiled(step).names))

    def sequence(self, steps: list[str]) -> _Rows:
        """From a match of the first step to the next one of the second in its function, and so on, with equal bindings."""
        out, known = self._own(self.hits(steps[0])), frozenset(compiled(steps[0]).names)
        for step in steps[1:]:
            later, names = self._scoped(step)
            joined = _unified(out, later, known & names, ["file", "_from"]).where("_a > last")
            nearest = joined.groupBy("file", "_from", "_to", "first", "last", F.to_json("values").alias("_key")).agg(F.min_by(F.struct("_z", "values", "_more"), "_a").alias("n"))
            out = nearest.select("file", "_from", "_to", "first", F.col("n._z").alias("last"), _added(F.col("n.values"), F.col("n._more")).alias("values"))
            known |= names
        return _Rows(out.drop("_from", "_to"), known)

    def block(self, owner: str, body: str) -> _Rows:
        """Blocks of this owner, from the line of their statement, that hold the steps of the body in order, with their bindings."""
        if self.blocks is None:
            raise ValueError("rules on blocks need the bracket intervals")
        spans = self.blocks.where((F.col("owner") == owner) & F.col("block")).select("file", "depth", "first", "last", (F.col("first_line").cast("long") * LINE).alias("_head"), F.col("last").alias("_to"))
        out, known = None, frozenset()
        for step in _steps(body).steps:
            hit = self.hits(step)
            inner = hit.join(source.around(hit.withColumn("at", F.col("first")), spans).select("file", F.col("at").alias("first"), "_head", "_to"), ["file", "first"])
            names = frozenset(compiled(step).names)
            if out is None:
                out = inner
            else:
                later = inner.select("file", "_head", "_to", F.col("first").alias("_a"), F.col("last").alias("_z"), F.col("values").alias("_more"))
                joined = _unified(out, later, known & names, ["file", "_head", "_to"]).where("_a > last")
                out = joined.select("file", "_head", "_to", "first", F.col("_z").alias("last"), _added(F.col("values"), F.col("_more")).alias("values"))
            known |= names
        if out is None:
            out = spans.withColumn("values", F.create_map().cast("map<string,string>"))
        return _Rows(out.select("file", F.col("_head").alias("first"), F.col("_to").alias("last"), "values"), known)

    def pattern(self, text: str) -> _Rows:
        if m := _BLOCK.match(text):
            return self.block(m[1], m[3])
        parts = _steps(text)
        if len(parts.steps) > 1:
            return self.sequence(parts.steps)
        return _Rows(self.hits(parts.steps[0]), frozenset(compiled(parts.steps[0]).names))

    def held(self, found: _Rows, text: str) -> DataFrame:
        """The rows of `found` that lie within a match of the pattern with equal bindings."""
        rows, keys = found.rows, ["file", "first", "last", "_key"]
        rows = rows.withColumn("_key", F.to_json("values"))
        parts = _steps(text)
        if (m := _BLOCK.match(text)) or (len(parts.steps) == 1 and not parts.leads and not parts.trails):
            inner, names = self.block(m[1], m[3]) if m else self.pattern(text)
            inner = inner.select("file", F.col("first").alias("_a"), F.col("last").alias("_z"), F.col("values").alias("_more"))
            return _covered(rows, inner, found.names & names).select(*keys)
        if len(parts.steps) == 1:  # of equal bindings in a scope the first start and the last end decide
            inner, names = self._scoped(parts.steps[0])
            bound = found.names & names
            held = F.map_filter("_more", lambda k, _: k.isin(*sorted(bound))) if bound else F.create_map().cast("map<string,string>")
            inner = inner.groupBy("file", "_from", F.to_json(held).alias("_held")).agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.any_value("_more").alias("_more")).drop("_held")
            out = _unified(self._own(rows), inner, bound, ["file", "_from"])
            return (out.where("_z >= last") if parts.leads and not parts.trails else out.where("_a <= first") if parts.trails and not parts.leads else out).select(*keys)
        out, known = self._own(rows), found.names
        for k, step in enumerate(parts.steps):
            inner, names = self._scoped(step)
            out = _unified(out, inner, known & names, ["file", "_from"])
            out = out.where("_a > _end") if k else out if parts.leads else out.where("_a <= first")
            out = out.select("file", "first", "last", "_key", "_from", _added(F.col("values"), F.col("_more")).alias("values"), F.col("_z").alias("_end"))
            if k + 1 < len(parts.steps):  # of equal bindings the first end leaves most to what follows
                out = out.groupBy("file", "first", "last", "_key", "_from", F.to_json("values").alias("_now")).agg(F.min_by(F.struct("values", "_end"), "_end").alias("n")).select("file", "first", "last", "_key", "_from", "n.*")
            known |= names
        return (out if parts.trails else out.where("_end >= last")).select(*keys)


class _Parts(NamedTuple):
    steps: list[str]
    leads: bool
    trails: bool


def _steps(pattern: str) -> _Parts:
    """The parts of a pattern between lines of `...`, which stand for any statements, and whether it begins and ends with such a line."""
    lines = [x.strip() for x in pattern.strip().splitlines() if x.strip()]
    parts: list[list[str]] = [[]]
    for line in lines:
        if line == "...":
            parts.append([])
        else:
            parts[-1].append(line)
    return _Parts(["\n".join(p) for p in parts if p], lines[:1] == ["..."], len(lines) > 1 and lines[-1] == "...")


def _unified(left: DataFrame, right: DataFrame, names: frozenset, keys: list[str]) -> DataFrame:
    """left joined with right (keys, _a, _z, _more) on equal keys and equal bindings of these names."""
    bound = {f"_v{i}": n for i, n in enumerate(sorted(names))}
    a = left.withColumns({c: F.col("values")[n] for c, n in bound.items()}) if bound else left
    b = right.withColumns({c: F.col("_more")[n] for c, n in bound.items()}) if bound else right
    return a.join(b, [*keys, *bound]).drop(*bound)


def _covered(rows: DataFrame, inner: DataFrame, names: frozenset) -> DataFrame:
    """The rows (file, first, last, values, …) that lie within some of inner (file, _a, _z, _more) with equal bindings of these names.

    In order of their starts, the farthest end so far decides: no row meets all matches of its file."""
    bound = {f"_v{i}": n for i, n in enumerate(sorted(names))}
    asked = rows.withColumns({"_at": F.col("first"), "_asks": F.lit(1), "_end": F.lit(None).cast("long"), **{c: F.col("values")[n] for c, n in bound.items()}})
    known = inner.select("file", F.col("_a").alias("_at"), F.lit(0).alias("_asks"), F.col("_z").alias("_end"), *(F.col("_more")[n].alias(c) for c, n in bound.items()))
    before = Window.partitionBy("file", *bound).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    held = asked.unionByName(known, allowMissingColumns=True).withColumn("_end", F.max("_end").over(before)).where("_asks = 1 and _end >= last")
    for c in bound:  # a binding that is missing equals none
        held = held.where(F.col(c).isNotNull())
    return held.select(*rows.columns)


def _added(values: Column, more: Column) -> Column:
    return F.map_concat(values, F.map_filter(more, lambda k, _: ~F.array_contains(F.map_keys(values), k)))


def _condition(entry: dict) -> Column | None:
    if regex := entry.get("metavariable-regex"):
        return F.col("values")[regex["metavariable"].lstrip("$")].rlike(regex["regex"])
    if compared := entry.get("metavariable-comparison"):
        m = COMPARISON.match(compared["comparison"])
        if not m:
            raise ValueError(f"not a comparison with a number: {compared['comparison']}")
        value = F.regexp_replace(F.col("values")[m[1]], r"[_'\"]", "").try_cast("double")
        ops = {"<": value < float(m[3]), "<=": value <= float(m[3]), ">": value > float(m[3]), ">=": value >= float(m[3]), "==": value == float(m[3]), "!=": value != float(m[3])}
        return F.coalesce(ops[m[2]], F.lit(False))
    return None


def _found(run: _Run, rule: dict) -> _Rows:
    parts = rule.get("patterns") or [{k: v for k, v in rule.items() if k.startswith("pattern")}]
    out, later = None, []
    for entry in parts:
        for key, value in entry.items():
            if key == "pattern":
                hit = run.pattern(value)
            elif key == "pattern-regex":
                hit = _Rows(run.hits(value, raw=True), frozenset())
            elif key == "pattern-either":
                choices = [_found(run, choice) for choice in value]
                hit = _Rows(reduce(DataFrame.unionByName, (c.rows for c in choices)), frozenset.intersection(*(c.names for c in choices)))
            else:
                later.append((key, value, entry))
                continue
            if out is None:
                out = hit
            else:
                more = hit.rows.withColumnRenamed("values", "_more")
                joined = _unified(out.rows, more, out.names & hit.names, ["file", "first", "last"])
                out = _Rows(joined.select("file", "first", "last", _added(F.col("values"), F.col("_more")).alias("values")), out.names | hit.names)
    if out is None:
        raise ValueError(f"rule without a pattern: {rule}")
    for key, value, entry in later:
        if key in ("pattern-not", "pattern-inside", "pattern-not-inside"):
            # A negative pattern takes out what lies within its matches, and `pattern-not` is no more than that for equal or wider ones.
            held = run.held(out, value)
            rows = out.rows.withColumn("_key", F.to_json("values")).join(held.distinct(), ["file", "first", "last", "_key"], "left_semi" if key == "pattern-inside" else "left_anti").drop("_key")
        elif (condition := _condition(entry)) is not None:
            rows = rules.where(out.rows, condition)
        else:
            raise ValueError(f"no such part of a rule: {key}")
        out = _Rows(rows, out.names)
    return out


def _message(text: str, names: frozenset) -> Column:
    """The message with the bindings in place of their names; a name that is not bound stays."""
    out = F.lit(text)
    for name in sorted(names, key=len, reverse=True):
        if f"${name}" in text:
            out = F.replace(out, F.lit(f"${name}"), F.coalesce(F.col("values")[name], F.lit(f"${name}")))
    return out


def run_rules(stated: DataFrame, owned: DataFrame, rule_list: list[dict], blocks: DataFrame | None = None, keep=lambda hits: hits) -> DataFrame:
    """(rule_id, file, line_start, line_end, severity, message, metadata): each rule's distinct hits, with bindings in the message; metadata as JSON.

    owned: `modules.functions`; blocks: `source.intervals`, for rules on loops and the like. paths.include narrows a rule to the files that a
    glob fits. Each rule is a plan of its own over the same statements, which are best written first; `keep` can write each pattern's
    matches and each rule's hits, so that no pattern is sought twice and many rules do not become one large plan."""
    run, out = _Run(stated, owned, blocks, keep), None
    for rule in rule_list:
        globs = (rule.get("paths") or {}).get("include") or []
        hits, names = _found(run.within(globs) if globs else run, rule)
        line = lambda c: F.floor(F.col(c) / LINE).cast("int")
        named = hits.select("file", line("first").alias("first"), line("last").alias("last"), _message(rule.get("message", ""), names).alias("message")).distinct()
        same = {"rule_id": rule["id"], "severity": rule.get("severity", "WARNING"), "metadata": json.dumps(rule.get("metadata") or {}, sort_keys=True)}
        made = named.withColumnsRenamed({"first": "line_start", "last": "line_end"}).withColumns({c: F.lit(x) for c, x in same.items()})
        made = keep(made.select("rule_id", "file", "line_start", "line_end", "severity", "message", "metadata"))
        out = made if out is None else out.unionByName(made)
    return out
