"""Chains of calls against a plain search."""

import random

from auditspan.operators import graphs, modules
from auditspan.sources.shared import written


def plain_chains(roots, sites, passed, depth, most):
    index = {}
    for caller, arg, i in passed:
        index[caller, arg] = min(i, index.get((caller, arg), i))
    called = {s[1] for s in sites}

    def follow(callee, i, left):
        if not left:
            return [("max_depth_reached", [])]
        hits = sorted((place, caller, arg) for caller, c, j, arg, place in sites if arg is not None and (c, j) == (callee, i))
        if not hits:
            return [("no_matching_arg_index" if callee in called else "no_callers_found", [])]
        out = []
        for place, caller, arg in hits:
            if (caller, arg) in index:
                out += [(origin, [(place, caller, arg), *rest]) for origin, rest in follow(caller, index[caller, arg], left - 1)]
            else:
                out.append(("hardcoded" if arg.isdigit() else "variable", [(place, caller, arg)]))
        return out

    return sorted((c, i, n, *chain) for c, i in set(roots) for n, chain in enumerate(follow(c, i, depth)[:most], 1))


def test_chains_equal_a_plain_search(spark):
    rng = random.Random(5)
    for depth, most, n in ((3, 1000, 25), (2, 3, 40), (4, 5, 40)):
        names = [f"f{i}" for i in range(8)]
        sites = [(rng.choice(names), rng.choice(names[:6]), rng.randrange(2), rng.choice(["a", "b", "x", "7", None]), place) for place in range(n)]
        sites += [("f1", "f0", 0, "a", 100 + k) for k in range(20)]  # a parameter with many calls
        passed = [(f, a, i) for f in names for i, a in enumerate("ab") if rng.random() < 0.6] + [("f1", "a", 1)]
        roots = [(f, i) for f in names for i in (0, 1)] * 2
        found = graphs.caller_chains(
            spark.createDataFrame(roots, "callee string, arg_index int"), spark.createDataFrame(sites, "caller string, callee string, arg_index int, arg string, place int"),
            spark.createDataFrame(passed, "caller string, arg string, param_index int"), written, depth, most)
        got = sorted((r.root, r.root_index, r.rank, r.origin, [tuple(c) for c in r.chain]) for r in found.collect())
        assert got == plain_chains(roots, sites, passed, depth, most)


def test_chains_of_traced_parameters(spark):
    exported = spark.createDataFrame([("a.ts", 1, "seal", ["key"]), ("b.ts", 1, "wrap", ["data", "key"])], "file string, line_no int, name string, params array<string>")
    traced = spark.createDataFrame([("a.ts", 2, "encrypt", "key", "parameter")], "file string, line_no int, operation string, var string, origin string")
    sites = [("b.ts", "wrap", 3, "a.ts", "seal", 0, 0, "key"), ("c.ts", "<module>", 9, "b.ts", "wrap", 0, 1, "'fixed'"), ("c.ts", "go", 4, "b.ts", "wrap", 0, 1, "await hkdf(x)"), ("c.ts", "go", 5, "b.ts", "wrap", 0, None, None)]
    calls = spark.createDataFrame(sites, "caller_file string, caller string, line_no int, callee_file string, callee string, call int, arg_index int, arg string")
    found = modules.parameter_functions(traced, exported)
    out = modules.parameter_chains(found, calls, exported, written).orderBy("rank").collect()
    assert [(r.function, r.rank, r.origin, [(c.caller, c.place.line_no) for c in r.chain]) for r in out] == [
        ("seal", 1, "derived", [("b.ts#wrap", 3), ("c.ts#go", 4)]), ("seal", 2, "hardcoded", [("b.ts#wrap", 3), ("c.ts#<module>", 9)])]
    empty = modules.parameter_chains(found, calls.limit(0), exported, written).collect()
    assert [(r.rank, r.origin, r.chain) for r in empty] == [(1, "no_callers_found", [])]
    assert modules.parameter_chains(found.limit(0), calls, exported, written).count() == 0
