"""Facts from TypeScript-like source, read line by line with regular expressions.

A full parser would be a library behind a thin function; these read declarations, imports and calls that stand on one line, which is what
the audit asks about, and they do it inside Spark expressions. input: (file, line_no, line). `masked` gives lines in which comments are
blank and strings cannot be taken for code; traces and assignments read both kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import source

#: What counts as a call of the cryptography interface.
SUBTLE = ("encrypt", "decrypt", "deriveKey", "deriveBits", "importKey", "exportKey", "generateKey", "sign", "verify", "wrapKey", "unwrapKey", "digest")
HELPERS = ("deriveChunkIV", "encryptLargeSecretKey", "decryptLargeSecretKey", "encryptFilename", "decryptFilename", "argon2id", "hkdf", "encryptFileChunk", "decryptFileChunk", "encryptHybrid", "decryptHybrid", "wrapKey", "unwrapKey", "keyWrap")
FUNCTION = r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)"
ARROW = r"^\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:function\s*)?\(([^)]*)\)\s*(?:=>|\{)"
IMPORT = r"^\s*import\s+(?:type\s+)?(?:([A-Za-z_$][A-Za-z0-9_$]*)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s+['\"]([^'\"]+)['\"]"
CALL = r"([A-Za-z_$][A-Za-z0-9_$.]*)\s*\("
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "await", "async")


def masked(lexed: DataFrame) -> DataFrame:
    """(file, line_no, line) of `source.lexed`: the code alone, without depth marks, strings in their shadow alphabet."""
    return lexed.where("bracket is null").select("file", "line_no", F.regexp_replace("code", source.MARK, "").alias("line"))


def functions(rows: DataFrame) -> DataFrame:
    """(file, name, exported, start_line, end_line, params): a function ends before the next one of its file, or with the file."""
    either = lambda g: F.when(F.regexp_extract("line", FUNCTION, 2) != "", F.regexp_extract("line", FUNCTION, g)).otherwise(F.regexp_extract("line", ARROW, g))
    last = rows.groupBy("file").agg(F.max("line_no").alias("_last"))
    found = rows.select("file", F.col("line_no").alias("start_line"), either(1).alias("_export"), either(2).alias("name"), either(3).alias("_params")).where("name <> ''")
    params = F.filter(F.transform(F.split("_params", ","), lambda p: F.regexp_extract(p, r"^\s*(?:\.\.\.)?([A-Za-z_$][A-Za-z0-9_$]*)", 1)), lambda p: p != "")
    after = F.lead("start_line").over(Window.partitionBy("file").orderBy("start_line"))
    return found.join(last, "file").select("file", "name", (F.col("_export") != "").alias("exported"), "start_line", F.coalesce(after - 1, F.col("_last")).alias("end_line"), params.alias("params"))


def imports(rows: DataFrame) -> DataFrame:
    """(file, line_no, specifier, symbol): one row for each imported name, under its own name where it is renamed."""
    names = F.concat(F.array(F.regexp_extract("line", IMPORT, 1)), F.split(F.regexp_extract("line", IMPORT, 2), ","))
    symbol = F.transform(names, lambda n: F.regexp_extract(n, r"^\s*(?:type\s+)?([A-Za-z_$][A-Za-z0-9_$]*)", 1))
    found = rows.where(F.col("line").rlike(IMPORT)).select("file", "line_no", F.regexp_extract("line", IMPORT, 3).alias("specifier"), F.explode(F.filter(symbol, lambda s: s != "")).alias("symbol"))
    return found


def called(rows: DataFrame) -> DataFrame:
    """(file, line_no, callee): each name that a line calls, once; of a member the last part counts as well as the whole."""
    names = F.array_distinct(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)))
    return rows.where(~F.col("line").rlike(FUNCTION)).select("file", "line_no", F.explode(F.filter(names, lambda n: ~n.isin(*KEYWORDS))).alias("callee"))


def crypto_calls(rows: DataFrame) -> DataFrame:
    """(file, line_no, method, text): calls of the cryptography interface, of its random source, of known helpers by prefix, or of a method that encrypts or signs."""
    callee, last = F.col("callee"), F.element_at(F.split("callee", r"\."), -1)
    method = (
        F.when(callee.rlike(r"^crypto\.subtle\.\w+"), F.when(last.isin(*SUBTLE), last)).when(callee == "crypto.getRandomValues", "getRandomValues")
        .when(callee.rlike("^(" + "|".join(HELPERS) + ")"), callee).when(callee.rlike(r"\.(encrypt|decrypt|sign|verify)$"), last)
    )
    calls = called(rows).withColumn("method", method).where("method is not null")
    return calls.join(rows, ["file", "line_no"]).select("file", "line_no", "method", F.substring(F.trim("line"), 1, 200).alias("text"))


def call_sites(rows: DataFrame, owned: DataFrame, links: DataFrame) -> DataFrame:
    """(caller_file, caller, line_no, callee_file, callee, arg_index, arg): one row for each argument of a call of an imported name.

    links: (file, symbol, target), the last import of a symbol first resolved. A call without arguments gives no row."""
    found = called(rows).alias("c").join(links.alias("l"), (F.col("c.file") == F.col("l.file")) & (F.col("c.callee") == F.col("l.symbol"))).select(F.col("c.file").alias("file"), "line_no", "callee", "target")
    text = found.join(rows, ["file", "line_no"])
    raw = F.call_function("regexp_extract", F.col("line"), F.concat(F.lit(r"\b\Q"), "callee", F.lit(r"\E\s*\(([^()]*)\)")), F.lit(1))
    args = F.filter(F.transform(F.split(raw, ","), lambda a: F.trim(a)), lambda a: a != "")
    each = text.select("file", "line_no", F.col("target").alias("callee_file"), "callee", F.posexplode(args).alias("arg_index", "arg"))
    inside = source.on_lines(each, owned.select("file", F.col("name").alias("caller"), "start_line", "end_line"))
    return inside.select(F.col("file").alias("caller_file"), "line_no", "callee_file", "callee", "arg_index", F.substring("arg", 1, 200).alias("arg"), "caller")


def resolved(links: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """links with target: the first of five candidates that exists, else the specifier. links: (file, specifier, …); files: (file).

    An alias at the start is replaced, a relative specifier joined to the importing file's folder; then the name itself, .ts, .tsx and the
    index files are tried in order by one equality join."""
    spec = F.col("specifier")
    for alias, target in reversed((aliases or {}).items()):
        spec = F.when(F.col("specifier").startswith(alias), F.concat(F.lit(target), F.substring("specifier", len(alias) + 1, 1 << 30))).otherwise(spec)
    folder = F.regexp_extract("file", r"^(.*/)?[^/]*$", 1)
    parts = F.filter(F.split(F.concat(folder, spec), "/"), lambda p: ~p.isin("", "."))
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))), "/")
    base = F.when(spec.startswith("."), clean).otherwise(spec)
    tries = F.transform(F.lit(["", ".ts", ".tsx", "/index.ts", "/index.tsx"]), lambda s: F.concat(base, s))
    asked = links.select("file", "specifier").distinct().select("file", "specifier", F.posexplode(tries).alias("place", "target"))
    hit = asked.join(files.select(F.col("file").alias("target")).distinct(), "target").groupBy("file", "specifier").agg(F.min_by("target", "place").alias("target"))
    return links.join(hit, ["file", "specifier"], "left").withColumn("target", F.coalesce("target", "specifier"))


#: What an assignment's right side says about the value: (origin, what follows `name = `, the part that names it), in order.
ORIGINS = (
    ("crypto_random", r".*getRandomValues", None),
    ("derived", r"(?:await\s+)?(deriveChunkIV|hkdf|deriveBits|deriveKey|HKDF)\s*\(", 1),
    ("derived", r"(?:await\s+)?(crypto\.subtle\.(?:deriveKey|deriveBits))\s*\(", 1),
    ("imported_key", r"(?:await\s+)?(crypto\.subtle\.importKey)\s*\(", 1),
    ("crypto_random", r"(?:await\s+)?(crypto\.subtle\.generateKey)\s*\(", 1),
    ("hardcoded", r"([\"'][^\"']*[\"']|[0-9]+)\s*;", 1),
    ("computed", r"(?:await\s+)?(\w[\w.]*)\s*\(", 1),
)


#: Lines that `assignments` and `traces` read have one of these; the latter, and buffers that are filled later, are read with the lines around.
ASSIGNED = rf"\w\s*=\s*(?:{'|'.join(pattern for _, pattern, _ in ORIGINS)}|new\s+Uint8Array)"
HELPER = "deriveChunkIV|encryptLargeSecretKey|decryptLargeSecretKey|encryptFilename|decryptFilename"
OPERATIONS = "encrypt|decrypt|wrapKey|unwrapKey|deriveKey|deriveBits"
SIGHT = rf"crypto\.subtle\.(?:{OPERATIONS})\s*\(|{HELPER}|=\s*new\s+Uint8Array"
BEHIND, AHEAD = 10, 4


def _around(rows: DataFrame, behind: int, ahead: int, only: bool = False) -> Column:
    """The lines around each, as one text, without the line itself if it is only the lines ahead: of `source.picked` those it comes with, else by a window over the file."""
    if "ahead" not in rows.columns:
        order = Window.partitionBy("file").orderBy("line_no").rowsBetween(1 if only else -behind, ahead)
        return F.array_join(F.collect_list("line").over(order), "\n")
    held = F.slice("ahead", 1, ahead)
    if not only:
        held = F.concat(F.slice("behind", F.greatest(F.size("behind") - behind + 1, F.lit(1)), behind), F.array("line"), held)
    return F.array_join(held, "\n")


def assignments(rows: DataFrame) -> DataFrame:
    """(file, line_no, var, origin, via): each line's assignments that one of the rules knows. A buffer that one of the next four lines fills counts as random.

    rows: lines, or lines of `source.picked` by ASSIGNED and SIGHT."""
    var, right = (F.regexp_extract_all("line", F.lit(r"\b(\w++)\s*+=(?=\s*(.*)$)"), F.lit(g)) for g in (1, 2))
    each = F.transform(F.arrays_zip(var.alias("var"), right.alias("right")), lambda x, i: F.struct(x["var"].alias("var"), x["right"].alias("right"), i.alias("i")))
    each = rows.withColumn("_next", _around(rows, 0, 4, True)).where(F.contains(F.col("line"), F.lit("="))).select("file", "line_no", "_next", var.alias("_vars"), F.explode(each).alias("_e"))
    each = each.where("array_position(_vars, _e.var) = _e.i + 1").select("file", "line_no", F.col("_e.var").alias("var"), F.col("_e.right").alias("_right"), "_next")
    right = F.col("_right")
    filled = F.contains(right, F.lit("Uint8Array")) & right.rlike(r"^new\s+Uint8Array") & F.contains("_next", F.concat(F.lit("getRandomValues("), "var"))
    random = F.contains(right, F.lit("getRandomValues")) & right.rlike("^" + ORIGINS[0][1])
    one = lambda origin, via: F.struct(F.lit(origin).alias("origin"), via.alias("via"))
    origin = F.when(random | filled, one("crypto_random", F.lit("crypto.getRandomValues")))
    for name, pattern, group in ORIGINS[1:]:
        origin = origin.when(right.rlike("^" + pattern), one(name, source.plain(F.regexp_extract(right, "^" + pattern, group))))
    # Exploded, for a filter would be pushed below and every pattern tried twice.
    return each.select("file", "line_no", "var", F.explode(F.array_compact(F.array(origin))).alias("o")).select("file", "line_no", "var", "o.origin", "o.via")


def traces(rows: DataFrame) -> DataFrame:
    """(file, line_no, operation, role, var): operations on a line with the variables that matter, from the lines around.

    The initial value is looked up ten lines before to two after, the salt ten before to four after, the algorithm is in `algorithm`; the
    key is the second argument on the line itself. rows: lines, or lines of `source.picked` by SIGHT."""
    line, char = F.col("line"), rf"[\w{source.SHADOWS[0]}-{source.SHADOWS[-1]}]"
    op = lambda *names: F.coalesce(F.get(F.filter("_ops", lambda o: o.isin(*names)), F.lit(0)), F.lit(""))
    wide = rows.select("file", "line_no", "line", _around(rows, 10, 2).alias("_iv"), _around(rows, 10, 4).alias("_salt"), _around(rows, 8, 2).alias("_name"), *(c for c in ("ahead",) if c in rows.columns))
    wide = wide.where("ahead is not null" if "ahead" in rows.columns else line.rlike(SIGHT)).withColumn("_ops", F.regexp_extract_all("line", F.lit(rf"crypto\.subtle\.({OPERATIONS})\s*\("), F.lit(1)))
    wide = wide.withColumns({"_ed": op("encrypt", "decrypt"), "_wrap": op("wrapKey", "unwrapKey"), "_derive": op("deriveKey", "deriveBits"), "_helper": F.when(reduce(or_, (F.contains(line, F.lit(h)) for h in HELPER.split("|"))), F.regexp_extract("line", rf"(?:await\s+)?({HELPER})\s*\(", 1)).otherwise("")})
    ed, wrap, derive, helper = map(F.col, ("_ed", "_wrap", "_derive", "_helper"))
    wide = wide.withColumns({
        "_at": F.when(ed != "", F.regexp_extract("_iv", r"\biv\s*:\s*(\w+)", 1)), "_key": F.when((ed != "") | (wrap != ""), F.regexp_extract("line", r"(?:encrypt|decrypt|wrapKey|unwrapKey)\s*\([^,]+,\s*(\w+)", 1)),
        "_salt": F.when(derive != "", F.regexp_extract("_salt", r"\bsalt\s*:\s*(\w+)", 1)), "_alg": F.when(ed != "", source.plain(F.regexp_extract("_name", rf"name\s*:\s*['\"]({char}(?:{char}|-)*)['\"]", 1))),
    })
    short = F.when(F.col("_iv").rlike(r"[\{,]\s*iv\s*[,\}]"), "iv").otherwise("unknown")
    iv = F.when(F.col("_at") != "", F.col("_at")).otherwise(short)
    known = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("unknown")
    algorithm, key, salt = known("_alg"), known("_key"), known("_salt")
    none = F.lit(None).cast("string")
    one = lambda operation, role, var, alg: F.struct(operation.alias("operation"), F.lit(role).alias("role"), var.alias("var"), alg.alias("algorithm"))
    found = F.array_compact(F.array(
        F.when(ed != "", one(ed, "iv", iv, algorithm)), F.when(ed != "", one(ed, "key", key, algorithm)), F.when(wrap != "", one(wrap, "wrapping_key", key, none)),
        F.when(derive != "", one(derive, "salt", salt, none)), F.when(helper != "", one(helper, "helper", none, none)),
    ))
    return wide.select("file", "line_no", F.explode(found).alias("t")).select("file", "line_no", "t.*")


def origins(found: DataFrame, assigned: DataFrame, first_lines: DataFrame) -> DataFrame:
    """traces with origin, origin_line and via: the earliest assignment up to the line, else a parameter of the first line, else unknown.

    One equality join by file and variable with a range filter instead of a scan of the scope for each trace."""
    keyed = found.select("file", "var", "line_no").distinct()
    by = assigned.select("file", "var", F.col("line_no").alias("_at"), "origin", "via")
    hit = keyed.join(by, ["file", "var"]).where("_at <= line_no").groupBy("file", "var", "line_no").agg(F.min_by(F.struct("origin", F.col("_at").alias("origin_line"), "via"), "_at").alias("o"))
    rows = found.join(hit, ["file", "var", "line_no"], "left").join(first_lines.select("file", F.col("line").alias("_first")), "file", "left")
    parameter = F.coalesce(F.regexp_like("_first", F.concat(F.lit(r"[(,]\s*\Q"), F.coalesce("var", F.lit("?")), F.lit(r"\E\s*[,:)\[]"))), F.lit(False)) & (F.col("var") != "unknown")
    origin = F.coalesce("o.origin", F.when(parameter, "parameter"), F.lit("unknown"))
    return rows.select("file", "line_no", "operation", "role", "var", "algorithm", origin.alias("origin"), F.coalesce("o.origin_line", F.when(parameter, F.lit(1))).alias("origin_line"), F.col("o.via").alias("via"))


def scoped_origins(found: DataFrame, assigned: DataFrame, owned: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """traces with function, origin, origin_line and via, each seen from the innermost function around it.

    owned: (file, name, start_line, end_line, depth, params). The earliest assignment from the function's first line to the trace's decides,
    not counting those of functions within it that do not hold the trace; else the innermost function around that has the variable as a
    parameter, with its line; else unknown. Outside functions the whole file counts, function is null and there are no parameters.

    Traces and assignments are placed in one pass over each file's lines (`_placed`); the earliest assignment is a running first one by
    file, function and variable. Nothing is joined. keep: writes what was placed, so that all before it runs as one step."""
    none = {c: F.lit(None).cast(k) for c, k in (("var", "string"), ("operation", "string"), ("role", "string"), ("algorithm", "string"), ("origin", "string"), ("via", "string"), ("depth", "int"), ("last", "int"), ("name", "string"), ("params", "array<string>"))}
    rows = lambda df, kind, at, **cols: df.select("file", F.col(at).cast("int").alias("line_no"), F.lit(kind).alias("kind"), *(F.col(cols[c]).alias(c) if c in cols else v.alias(c) for c, v in none.items()))
    same = lambda *names: dict(zip(names, names))
    every = rows(owned, 0, "start_line", last="end_line", **same("depth", "name", "params")).unionByName(rows(assigned, 1, "line_no", **same("var", "origin", "via"))).unionByName(rows(found, 2, "line_no", **same("operation", "role", "var", "algorithm")))
    placed = keep(source.dealt(every, "line_no", "kind").mapInArrow(_placed, _PLACED))
    before = Window.partitionBy("file", "scope", "var").orderBy("line_no", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.when(F.col("kind") == 1, F.struct("origin", F.col("line_no").alias("origin_line"), "via")), ignorenulls=True).over(before)
    seen = placed.withColumn("o", first).where("kind = 2")
    origin = F.coalesce("o.origin", F.when(F.col("given").isNotNull(), "parameter"), F.lit("unknown"))
    return seen.select("file", "line_no", "function", "operation", "role", "var", "algorithm", origin.alias("origin"), F.coalesce("o.origin_line", "given").alias("origin_line"), F.col("o.via").alias("via"))


_CARRIED = ("file", "line_no", "kind", "var", "operation", "role", "algorithm", "origin", "via")
_PLACED = "file string, line_no int, kind int, var string, operation string, role string, algorithm string, origin string, via string, scope int, function string, given int"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `scoped_origins` but for functions, which come in order of their lines, first functions, then assignments, then traces: each
    with the first line and the name of the innermost function around, and the first line of the innermost that has the variable as a parameter.

    Functions are nested, so of each depth only the last that starts at a line or before it can hold the line."""
    file, spans = None, {}
    for part in batches:
        taken, scopes, names, given = [], [], [], []
        ints = [source.values(part.column(c).fill_null(0)) for c in ("line_no", "kind", "depth", "last")]
        params = part.column("params")
        each, ends = source.values(params.values), source.values(params.offsets)
        for i, (own, at, kind, depth, last, name, var) in enumerate(zip(source.values(part.column("file")), *ints, source.values(part.column("name")), source.values(part.column("var")))):
            if own != file:
                file, spans = own, {}
            if kind == 0:
                spans[depth] = at, last, name, frozenset(each[ends[i]:ends[i + 1]])
                continue
            held = {d: s for d, s in spans.items() if s[1] >= at}
            if len(held) < len(spans):
                spans = held
            around = spans[max(spans)] if spans else (0, 0, None)
            taken.append(i)
            scopes.append(around[0])
            names.append(around[2])
            given.append(max((s[0] for s in spans.values() if var in s[3]), default=None) if kind == 2 else None)
        if taken:
            columns = [part.column(c).take(pa.array(taken, pa.int32())) for c in _CARRIED]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scopes, pa.int32()), pa.array(names, pa.string()), pa.array(given, pa.int32())], [*_CARRIED, "scope", "function", "given"])
