"""Facts about modules: statements over several lines, exports by kind, methods, imported names, nested call arguments and what follows from them.

Everything is a Spark expression over statements of lexed source (`source`): comments and strings are no code, and brackets are matched at
any depth by their marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs, source
from .lines import lines
from .source import MARK

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "await", "async", "typeof", "new")
#: One argument or parameter, with the brackets it holds; its first group is a mark.
ARGUMENT = rf"(?:[^,()\[\]{{}}]|[(\[{{]({MARK})[\s\S]*?[)\]}}]\1)++"
FUNCTION = rf"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({NAME})\s*(?:<[^>]*>)?\(({MARK})([\s\S]*?)\)\3"
ARROW = rf"^\s*(export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*(?:{NAME})?\s*)?(?:\(({MARK})([\s\S]*?)\)\3[^=;{{]*(?:=>|\{{)|({NAME})\s*=>)"
CLASS = rf"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({NAME})"
METHOD = rf"^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?\s*({NAME})\s*(?:<[^>]*>)?\(({MARK})([\s\S]*?)\)\2\s*(?::[^{{;=]+)?\{{"
#: The head of a call by name or member, and what its brackets hold; calls within it match as well.
CALL = rf"(?<![\w$.])({NAME}(?:\.{NAME})*)\s*\(({MARK})(?=([\s\S]*?)\)\2)"


#: One sign is in a line of every statement that `_form` knows, and the pattern, which is cheaper than its own, fits all of them but methods named as keywords.
SIGN = r"function|class|=>|\{"
DECLARED = (
    r"^\s*(?:export\s+)?(?:(?:default\s+)?(?:(?:async\s+)?function|(?:abstract\s+)?class\s)|(?:const|let|var)\s)"
    rf"|^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?\s*(?!(?:{'|'.join(KEYWORDS)})(?![\w$])){NAME}\s*[<(]"
)


def statements(rows: DataFrame) -> DataFrame:
    """(file, line_no, last, line, code, level, end_line) of (file, line_no, line): see `source.statements`."""
    return source.statements(source.lexed(rows, ("statements",)))


def _names(params: Column) -> Column:
    parts = F.regexp_extract_all(F.regexp_replace(params, r"^\s+", ""), F.lit(ARGUMENT), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, rf"^\s*(?:(?:public|private|readonly)\s+)*(?:\.\.\.)?({NAME})", 1)), lambda p: p != "")


def _form() -> Column:
    """What a statement declares: a function, an arrow function, a class or perhaps a method; null for all else. Words and signs that each needs are sought first, which is much cheaper than the patterns."""
    code = F.col("code")
    braced = F.contains(code, F.lit("{"))
    return (
        F.when(F.contains(code, F.lit("function")) & code.rlike(FUNCTION), "function").when((braced | F.contains(code, F.lit("=>"))) & F.contains(code, F.lit("=")) & code.rlike(ARROW), "arrow")
        .when(F.contains(code, F.lit("class")) & code.rlike(CLASS), "class").when(braced & code.rlike(METHOD), "method")
    )


def _declared(form: Column, group: int, *arrow: int) -> Column:
    """A group of the function's pattern, or of the arrow's, whose number may differ; null for other forms."""
    each = [F.regexp_extract("code", ARROW, g) for g in arrow or (group,)]
    return F.when(form == "function", F.regexp_extract("code", FUNCTION, group)).when(form == "arrow", F.concat(*each))


def functions(stated: DataFrame) -> DataFrame:
    """(file, name, exported, start_line, end_line, depth, params) of statements: functions, arrow functions and methods, the latter as Class.method.

    Each lasts to the end of its block. A method is one of the class around it: of the last one before it whose block it is directly in."""
    code, braced, none = F.col("code"), F.contains(F.col("code"), F.lit("{")), F.array().cast("array<string>")
    names = [
        (FUNCTION, 2, F.contains(code, F.lit("function"))), (ARROW, 2, (braced | F.contains(code, F.lit("=>"))) & F.contains(code, F.lit("="))),
        (CLASS, 2, F.contains(code, F.lit("class"))), (METHOD, 1, braced),
    ]
    # As `_form`, but the name that a pattern finds tells that it fits, so each is tried once.
    each, forms = stated.select("file", "line_no", "code", "level", "end_line").withColumn("_form0", F.lit("")), [f"_form{i}" for i in range(1, 5)]
    for form, (pattern, group, hint) in zip(forms, names):
        each = each.withColumn(form, F.when(F.concat(*(f for f in each.columns if f.startswith("_form"))) == "", F.when(hint, F.regexp_extract(code, pattern, group)).otherwise("")).otherwise(""))
    function, arrow, klass, method = map(F.col, forms)
    exported = code.rlike(r"^\s*export\s")
    one = lambda kind, name, params, out=F.lit(False): F.struct(F.lit(kind).alias("kind"), name.alias("name"), params.alias("params"), out.alias("exported"))
    found = (
        F.when(function != "", one("plain", function, _names(F.regexp_extract(code, FUNCTION, 4)), exported)).when(arrow != "", one("plain", arrow, _names(F.concat(*(F.regexp_extract(code, ARROW, g) for g in (4, 5)))), exported))
        .when(klass != "", one("class", klass, none)).when((method != "") & ~method.isin(*KEYWORDS), one("method", method, _names(F.regexp_extract(code, METHOD, 3))))
    )
    # Exploded, for filters would be pushed below and what they ask for done twice.
    found = each.select("file", "line_no", "end_line", "level", F.explode(F.array_compact(F.array(found))).alias("_e")).select("file", "line_no", "end_line", "level", "_e.*")
    kind, order = F.col("kind"), Window.partitionBy("file", "_inside").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    scoped = found.withColumn("_inside", F.when(kind == "class", F.col("level") + 1).otherwise(F.col("level")))
    scoped = scoped.withColumn("_class", F.last(F.when(kind == "class", F.struct("name", "end_line")), ignorenulls=True).over(order))
    scoped = scoped.where((kind == "plain") | (kind == "method") & (F.col("_class.end_line") >= F.col("line_no")))
    name = F.when(kind == "plain", F.col("name")).otherwise(F.concat("_class.name", F.lit("."), F.col("name")))
    return scoped.select("file", name.alias("name"), "exported", F.col("line_no").alias("start_line"), "end_line", F.col("level").alias("depth"), "params")


def exports(stated: DataFrame) -> DataFrame:
    """(file, line_no, name, kind, params, snippet): functions, constants, classes, defaults, and names in braces: re-exports if they come from another module. A renamed one counts under its new name."""
    code = F.col("code")
    entry = lambda name, kind, params=None: F.array(F.struct(name.alias("name"), F.lit(kind).alias("kind"), (F.array().cast("array<string>") if params is None else params).alias("params")))
    constant = rf"^\s*export\s+(?:const|let|var)\s+({NAME})"
    braces = rf"^\s*export\s+(?:type\s+)?\{{{MARK}([^}}]*)\}}{MARK}(\s*from\b)?"
    listed = F.filter(F.transform(F.split(F.regexp_extract(code, braces, 1), ","), lambda p: F.trim(F.element_at(F.split(p, r"\sas\s"), -1))), lambda p: p != "")
    kind = F.when(F.regexp_extract(code, braces, 2) != "", "re-export").otherwise("function")
    form = F.col("_form")
    found = (
        F.when(_declared(form, 1) != "", entry(_declared(form, 2), "function", _names(_declared(form, 4, 4, 5)))).when((form == "class") & code.rlike(r"^\s*export\b"), entry(F.regexp_extract(code, CLASS, 2), "class"))
        .when(code.rlike(constant), entry(F.regexp_extract(code, constant, 1), "const")).when(code.rlike(braces), F.transform(listed, lambda n: F.struct(n.alias("name"), kind.alias("kind"), F.array().cast("array<string>").alias("params"))))
        .when(code.rlike(r"^\s*export\s+default\b"), entry(F.lit("default"), "function"))
    )
    snippet = F.array_join(F.slice(F.split("line", "\n"), 1, 5), "\n")
    stated = stated.where(F.contains(code, F.lit("export"))).withColumn("_form", _form())
    return stated.withColumn("_found", found).where("_found is not null").select("file", "line_no", F.explode("_found").alias("e"), snippet.alias("snippet")).select("file", "line_no", "e.*", "snippet")


def import_statements(stated: DataFrame) -> DataFrame:
    """(file, line_no, text): whole import statements, namespace and side-effect ones too."""
    return stated.where(F.col("code").rlike(r"^import\b(?!\s*\()")).select("file", "line_no", F.trim("line").alias("text"))


def imported_names(stated: DataFrame, aliases: tuple[str, ...] = ("@/",)) -> DataFrame:
    """(file, line_no, specifier, symbol) of imports from the code base itself, by the names the file uses: a renamed one under its new name, a default under its own.

    Specifiers that start with neither a dot nor an alias are packages and go."""
    code = F.col("code")
    specifier = source.plain(F.regexp_extract(code, r"from\s+[\"']([^\"']+)[\"']", 1))
    local = specifier.startswith(".")
    for a in aliases:
        local |= specifier.startswith(a)
    listed = F.transform(F.split(F.regexp_extract(code, rf"\{{{MARK}([^}}]+)\}}", 1), ","), lambda p: F.regexp_replace(F.trim(F.element_at(F.split(p, r"\sas\s"), -1)), r"^type\s+", ""))
    default = F.regexp_extract(code, rf"import\s+({NAME})\s*(?:,|from\b)", 1)
    names = F.filter(F.concat(listed, F.array(F.when(default != "type", default).otherwise(""))), lambda n: n != "")
    return stated.where(code.startswith("import") & code.rlike(r"^import\b") & local).select("file", "line_no", specifier.alias("specifier"), F.explode(names).alias("symbol"))


def last_links(resolved: DataFrame) -> DataFrame:
    """(file, symbol, target): where each imported name of a file comes from; the last import of a name wins. resolved: (file, line_no, symbol, target)."""
    return resolved.groupBy("file", "symbol").agg(F.max_by("target", "line_no").alias("target"))


def called_arguments(stated: DataFrame, most: int = 200) -> DataFrame:
    """(file, line_no, callee, call, arg_index, arg): each argument of each call by name or member, nested calls too; a call without arguments has one row with nulls.

    Declarations are no calls. The callee is the text before the bracket, `call` the place among the statement's calls; arguments keep their
    own brackets and strings and are cut to `most` characters."""
    code = F.col("code")
    stated = stated.where(F.contains(code, F.lit("(")))
    method = F.contains(code, F.lit("{")) & code.rlike(METHOD) & ~F.regexp_extract(code, METHOD, 1).isin(*KEYWORDS)
    named = F.when(F.contains(code, F.lit("function")), F.regexp_replace(code, r"\bfunction\s*\*?\s*" + NAME, "function")).otherwise(code)
    body = F.when(method, F.regexp_replace(code, METHOD, "")).otherwise(named)
    part = lambda group: F.regexp_extract_all("_body", F.lit(CALL), F.lit(group))
    heads = stated.select("file", "line_no", body.alias("_body")).select("file", "line_no", F.posexplode(F.arrays_zip(part(1).alias("callee"), part(3).alias("inside"))).alias("call", "c"))
    each = heads.select("file", "line_no", F.col("c.callee").alias("callee"), "call", F.col("c.inside").alias("inside")).where(~F.col("callee").isin(*KEYWORDS))
    args = F.filter(F.transform(F.regexp_extract_all("inside", F.lit(ARGUMENT), F.lit(0)), lambda a: F.trim(F.regexp_replace(source.plain(a), r"\s+", " "))), lambda a: a != "")
    return each.select("file", "line_no", "callee", "call", F.posexplode_outer(F.transform(args, lambda a: F.substring(a, 1, most))).alias("arg_index", "arg"))


def imported_call_sites(arguments: DataFrame, owned: DataFrame, links: DataFrame) -> DataFrame:
    """(caller_file, caller, line_no, callee_file, callee, call, arg_index, arg): calls of imported names, of a member by its first part. A call outside functions is of <module>.

    owned: (file, name, start_line), with end_line if functions have one: the caller is the last that starts at the line or before and has not
    ended. Lines meet functions by blocks of lines (`source.on_lines`)."""
    hit = arguments.withColumn("symbol", F.element_at(F.split("callee", r"\."), 1)).join(links, ["file", "symbol"])
    if "end_line" not in owned.columns:  # each lasts to the next, or to the last call
        after = F.lead("start_line").over(Window.partitionBy("file").orderBy("start_line"))
        owned = owned.join(hit.groupBy("file").agg(F.max("line_no").alias("_last")), "file").withColumn("end_line", F.coalesce(after - 1, "_last"))
    before = source.on_lines(hit.select("file", "line_no").distinct(), owned.select("file", F.col("name").alias("caller"), "start_line", "end_line"))
    caller = before.groupBy("file", "line_no").agg(F.max_by("caller", "start_line").alias("caller"))
    rows = hit.join(caller, ["file", "line_no"], "left")
    return rows.select(F.col("file").alias("caller_file"), F.coalesce("caller", F.lit("<module>")).alias("caller"), "line_no", F.col("target").alias("callee_file"), F.col("symbol").alias("callee"), "call", "arg_index", "arg")


def signatures(arguments: DataFrame, names: DataFrame, exported: DataFrame) -> DataFrame:
    """(file, name, target, line_no, params, snippet): exports, by name alone, of the functions that a file imports and calls; of equal names the first by file and line."""
    used = arguments.select("file", F.element_at(F.split("callee", r"\."), -1).alias("name")).distinct().join(names.select("file", F.col("symbol").alias("name")).distinct(), ["file", "name"], "left_semi")
    first = exported.groupBy("name").agg(F.min_by(F.struct(F.col("file").alias("target"), "line_no", "params", "snippet"), F.struct("file", "line_no")).alias("e"))
    return used.join(first, "name").select("file", "name", "e.*")


def parameter_functions(traces: DataFrame, exported: DataFrame) -> DataFrame:
    """(file, line_no, operation, var, function, param_index): for each traced variable that is a parameter, the first export of its file that has it. traces: (file, line_no, operation, var, origin)."""
    each = exported.select("file", F.col("line_no").alias("_at"), F.col("name").alias("function"), F.posexplode("params").alias("param_index", "var"))
    first = each.groupBy("file", "var").agg(F.min_by(F.struct("function", "param_index"), F.struct("_at", "param_index")).alias("f"))
    return traces.where("origin = 'parameter'").join(first, ["file", "var"]).select("file", "line_no", "operation", "var", "f.*")


def resolved_parameters(found: DataFrame, sites: DataFrame, exported: DataFrame, depth: int = 3) -> DataFrame:
    """(file, line_no, operation, var, function, depth, origin, n): what callers pass for the parameters of parameter_functions, by paths of calls.

    A function is known by file and name. Search goes on through arguments that are parameters of an exported caller."""
    at = lambda file, name: F.concat_ws("#", file, name)
    calls = sites.where("arg is not null").select(at("caller_file", "caller").alias("caller"), at("callee_file", "callee").alias("callee"), "arg_index", "arg")
    passed = exported.select(at("file", "name").alias("caller"), F.posexplode("params").alias("param_index", "arg")).groupBy("caller", "arg").agg(F.min("param_index").alias("param_index"))
    keyed = found.withColumn("root", at("file", "function")).withColumnRenamed("param_index", "root_index")
    roots = keyed.select(F.col("root").alias("callee"), F.col("root_index").alias("arg_index")).distinct()
    return keyed.join(graphs.parameter_origins(roots, calls, passed, depth), ["root", "root_index"]).select("file", "line_no", "operation", "var", "function", "depth", "origin", "n")


def parameter_chains(found: DataFrame, sites: DataFrame, exported: DataFrame, keep, depth: int = 3, most: int = 20) -> DataFrame:
    """(file, line_no, operation, var, function, rank, origin, chain): as resolved_parameters, with the calls of each chain and their places (file, line_no, call); the first `most` of each parameter."""
    at = lambda file, name: F.concat_ws("#", file, name)
    calls = sites.select(at("caller_file", "caller").alias("caller"), at("callee_file", "callee").alias("callee"), "arg_index", "arg", F.struct(F.col("caller_file").alias("file"), "line_no", "call").alias("place"))
    passed = exported.select(at("file", "name").alias("caller"), F.posexplode("params").alias("param_index", "arg"))
    keyed = found.withColumn("root", at("file", "function")).withColumnRenamed("param_index", "root_index")
    chains = graphs.caller_chains(keyed.select(F.col("root").alias("callee"), F.col("root_index").alias("arg_index")), calls, passed, keep, depth, most)
    return keyed.join(chains, ["root", "root_index"]).select("file", "line_no", "operation", "var", "function", "rank", "origin", "chain")


def graph_facts(files: DataFrame, keep) -> dict[str, DataFrame]:
    """Of files (file, text), the tables a dependency graph is joined from: functions, exports, imported names and arguments of calls, each file's by itself. The statements are made once."""
    stated = keep(statements(lines(files)))
    return {"functions": functions(stated), "exports": exports(stated), "imports": imported_names(stated), "arguments": called_arguments(stated)}
