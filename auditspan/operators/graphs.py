"""Call graphs: components and callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import source


def call_graph(owned: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, src, dst): distinct calls between functions of one file, without those of a function by itself. A method's short name stands for it; the last of equal ones counts."""
    short = F.element_at(F.split("name", r"\."), -1)
    named = owned.groupBy("file", short.alias("callee")).agg(F.max_by("name", "start_line").alias("dst"))
    inside = source.on_lines(calls, owned).select("file", F.col("name").alias("src"), F.element_at(F.split("callee", r"\."), -1).alias("callee"))
    return inside.join(named, ["file", "callee"]).where("src <> dst").select("file", "src", "dst").distinct()


def reached(edges: DataFrame, keep) -> DataFrame:
    """(node, label): the least node that undirected edges (a, b) reach, for each node with an edge to another one.

    Each round every node takes the one of itself and its neighbours whose hash of that round is least, and then what that one took. Only
    edges between nodes that took different ones go on, as edges of these, which are a part of the nodes: so all rounds together join a few
    times the edges, however long the paths. `keep` writes a round's tables where lost executors don't matter."""
    pairs = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        by_hash = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("taken"))
        both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
        near = both.groupBy("node").agg(F.min(by_hash("other")).alias("near"))
        near = near.select("node", F.least("near", by_hash("node"))["taken"].alias("taken"))
        taken = keep(near.join(near.select(F.col("node").alias("taken"), F.col("taken").alias("next")), "taken").select("node", F.col("next").alias("taken")))
        rounds.append(taken)
        left, right = (taken.select(F.col("node").alias(end), F.col("taken").alias(f"new_{end}")) for end in "ab")
        pairs = pairs.join(left, "a").join(right, "b").where("new_a <> new_b")
        pairs = keep(pairs.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
    if not rounds:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    last = rounds.pop()
    while rounds:
        after = last.select(F.col("node").alias("taken"), F.col("taken").alias("root"))
        last = keep(rounds.pop().join(after, "taken", "left").select("node", F.coalesce("root", "taken").alias("taken")))
    least = keep(last.groupBy("taken").agg(F.min("node").alias("label")))
    return last.join(least, "taken").select("node", "label")


def components(nodes: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """(node, component): the least node that undirected edges (src, dst) between nodes reach."""
    nodes = keep(nodes.select("node").where("node is not null").distinct())
    inside = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for end in "ab":
        inside = inside.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    found = nodes.join(reached(inside.select("a", "b"), keep), "node", "left")
    return keep(found.select("node", F.coalesce("label", "node").alias("component")))


def function_components(owned: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """owned (file, name, …) with component: the least name that calls connect a function with inside its file. edges: (file, src, dst)."""
    at = lambda c: F.concat_ws("#", "file", c)
    found = components(owned.select(at("name").alias("node")), edges.select(at("src").alias("src"), at("dst").alias("dst")), keep)
    named = found.select(F.col("node").alias("_node"), F.substring_index("component", "#", -1).alias("component"))
    return owned.join(named, at("name") == F.col("_node")).drop("_node")


#: What an argument says about the value it passes, in order.
ARGUMENTS = (("crypto_random", r"getRandomValues|generateKey|crypto\.subtle\.generate"), ("derived", r"deriveKey|deriveBits|hkdf|HKDF|deriveChunkIV"), ("hardcoded", r"^\s*[\"']"), ("hardcoded", r"^\s*[0-9]+\s*$"), ("variable", r"^\s*\w+\s*$"))


def argument_origin(arg) -> F.Column:
    out = F.lit("expression")
    for name, pattern in reversed(ARGUMENTS):
        out = F.when(arg.rlike(pattern), name).otherwise(out)
    return out


def parameter_origins(roots: DataFrame, sites: DataFrame, passed: DataFrame, depth: int = 3) -> DataFrame:
    """(root, root_index, depth, origin, n): how many call paths give each parameter each origin.

    roots: (callee, arg_index). sites: (caller, callee, arg_index, arg). passed: (caller, arg, param_index), the arguments that are parameters
    of an exported caller; through these the search goes on. Paths are counted, not listed: each level is added up by parameter before the
    next join, so a level has at most roots times parameters rows. A parameter without callers, or with callers that give no such argument, says so."""
    kinds = sites.withColumn("origin", argument_origin(F.col("arg")))
    level = kinds.groupBy("callee", "arg_index", "origin").agg(F.count(F.lit(1)).alias("n"))
    onward = kinds.where("origin = 'variable'").join(passed, ["caller", "arg"]).groupBy("callee", "arg_index", "caller", "param_index").agg(F.count(F.lit(1)).alias("n"))
    called = sites.select("callee").distinct().withColumn("_called", F.lit(True))
    front = roots.select(F.col("callee").alias("root"), F.col("arg_index").alias("root_index"), "callee", "arg_index", F.lit(1).cast("long").alias("paths"))
    out = None
    for d in range(depth + 1):
        if d == depth:
            found = front.groupBy("root", "root_index").agg(F.lit("max_depth_reached").alias("origin"), F.sum("paths").alias("n"))
        else:
            joined = front.join(level, ["callee", "arg_index"], "left").join(called, "callee", "left")
            origin = F.coalesce("origin", F.when(F.col("_called").isNull(), "no_callers_found").otherwise("no_matching_arg_index"))
            found = joined.groupBy("root", "root_index", origin.alias("origin")).agg(F.sum(F.col("paths") * F.coalesce("n", F.lit(1))).alias("n"))
            front = front.join(onward, ["callee", "arg_index"]).groupBy("root", "root_index", F.col("caller").alias("callee"), F.col("param_index").alias("arg_index")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
        found = found.select("root", "root_index", F.lit(d).alias("depth"), "origin", "n")
        out = found if out is None else out.unionByName(found)
    return out


def caller_chains(roots: DataFrame, sites: DataFrame, passed: DataFrame, keep, depth: int = 3, most: int = 20) -> DataFrame:
    """(root, root_index, rank, origin, chain): the first `most` chains of calls that give a parameter its value, and what stands at their far ends.

    roots: (callee, arg_index). sites: (caller, callee, arg_index, arg, place), place of any type with an order. passed: (caller, arg,
    param_index), of which the least index counts. A chain is an array of (place, caller, arg) from the root outwards; it goes on through an
    argument that is a parameter of the caller, ends with the argument's origin, or says that nobody calls, that no call has such an
    argument, or that `depth` calls were followed. Chains are ranked by their places, call by call, so those through one call stand together.

    The first `most` are exact, though no more are ever held of a root: each chain still open ends in one chain or more that stand at its
    place, so what comes after `most` others never gets among them. For the same reason the first `most` calls of a parameter are enough,
    and a function that everybody calls joins no more rows than that. Spark limits both groups before it shuffles them."""
    first = Window.partitionBy("callee", "arg_index").orderBy("place", "caller", "arg")
    inner = passed.groupBy("caller", "arg").agg(F.min("param_index").alias("_next"))
    told = sites.where("arg is not null").select("callee", "arg_index", "place", "caller", "arg").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    told = told.withColumn("_origin", argument_origin(F.col("arg"))).join(inner, ["caller", "arg"], "left")
    going = (F.col("_origin") == "variable") & F.col("_next").isNotNull()
    told = keep(told.select("callee", "arg_index", F.struct("place", "caller", "arg").alias("_call"), F.when(~going, F.col("_origin")).alias("_origin"), F.col("caller").alias("_caller"), F.when(going, F.col("_next")).alias("_next")))
    called = sites.select("callee").distinct().withColumn("_called", F.lit(True))
    call = told.schema["_call"].dataType.simpleString()
    chains = roots.distinct().select(F.col("callee").alias("root"), F.col("arg_index").alias("root_index"), "callee", "arg_index", F.expr(f"cast(array() as array<{call}>)").alias("chain"), F.lit(None).cast("string").alias("origin"))
    ranked = Window.partitionBy("root", "root_index").orderBy("chain")
    for _ in range(depth):
        longer = chains.where("origin is null").drop("origin").join(told, ["callee", "arg_index"], "left").join(called, "callee", "left")
        none = F.when(F.col("_called").isNull(), "no_callers_found").otherwise("no_matching_arg_index")
        ends = F.when(F.col("_call").isNull(), none).otherwise(F.col("_origin"))
        longer = longer.select("root", "root_index", F.col("_caller").alias("callee"), F.col("_next").alias("arg_index"), F.when(F.col("_call").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("_call"))).alias("chain"), ends.alias("origin"))
        every = longer.unionByName(chains.where("origin is not null").select(*longer.columns))
        chains = keep(every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most))
    return chains.select("root", "root_index", "rank", F.coalesce("origin", F.lit("max_depth_reached")).alias("origin"), "chain")
