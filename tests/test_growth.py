"""Steps whose cost has to grow with the input alone."""

from pyspark.sql import functions as F

from auditspan import queries
from auditspan.llm import jaccard_join
from auditspan.operators import graphs, modules, rule_files, source
from auditspan.sources.shared import written

ROW = "file string, line_no int, line string"
TEXT = ["export const f = async (", "  key,", ") => {", "  if (key) {", "    g(h(1), 'a(b'); g(h(2));", "  } else {", "    g(`", "      ${k}`,", "    2);", "  }", "}", "const x = (", "// open"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, files=3):
    return spark.createDataFrame([(f"f{n}", i + 1, x) for n in range(files) for i, x in enumerate(TEXT)], ROW)


def test_statements_are_joined_as_they_are_read(spark):
    found = lambda: modules.statements(_lines(spark))
    assert _plan(found()).count("Exchange") == 1
    whole = sorted(tuple(r) for r in found().collect())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(tuple(r) for r in found().collect()) == whole
        both = source.statements(source.lexed(_lines(spark)))
        assert sorted(tuple(r) for r in both.collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {r.line_no: (r.last, r.level, r.end_line, r.line) for r in found().where("file = 'f1'").collect()}
    assert got[1] == (3, 0, 11, "\n".join(TEXT[:3])) and got[4][:3] == (4, 1, 6) and got[7] == (9, 2, 9, "\n".join(TEXT[6:9])) and got[12][:3] == (13, 0, 13)
    assert sorted(got) == [1, 4, 5, 6, 7, 10, 11, 12]


def test_patterns_are_tried_once(spark):
    stated = modules.statements(_lines(spark, 1))
    hits = rule_files.matches(stated, "h($X)")
    assert _plan(hits).count("regexp_extract_all") == 0
    got = sorted((r.first, r.last, r["values"]["X"]) for r in hits.collect())
    code = stated.where("line_no = 5").first().code
    at = [code.index("h("), code.rindex("h(")]
    assert [(a - 5 * source.LINE, x) for a, _, x in got] == [(at[0], "1"), (at[1], "2")]
    nested = rule_files.matches(stated, "$F($X)").where(F.col("first").between(5 * source.LINE, 6 * source.LINE)).collect()
    assert sorted((r["values"]["F"], r["values"]["X"]) for r in nested) == [("g", "h(2)"), ("h", "1"), ("h", "2")]


def test_lines_meet_functions_by_blocks(spark):
    spans = [("a", 1, 400, "outer"), ("a", 17, 32, "one"), ("a", 20, 20, "two"), ("a", 300, 299, "none"), ("b", 5, 40, "other")]
    owned = spark.createDataFrame(spans, "file string, start_line int, end_line int, name string")
    points = spark.createDataFrame([(f, n) for f in "abc" for n in (1, 16, 17, 20, 32, 33, 299, 300, 400, 401)], "file string, line_no int")
    got = sorted((r.file, r.line_no, r.name) for r in source.on_lines(points, owned).collect())
    assert got == sorted((p.file, p.line_no, n) for p in points.collect() for f, a, z, n in spans if f == p.file and a <= p.line_no <= z)
    calls = points.withColumn("callee", F.lit("two"))
    assert "_block" in _plan(graphs.call_graph(owned, calls))
    arguments = calls.withColumns({"call": F.lit(0), "arg_index": F.lit(0), "arg": F.lit("x")})
    links = spark.createDataFrame([("a", "two", "t")], "file string, symbol string, target string")
    for functions, last in ((owned, "<module>"), (owned.drop("end_line"), "none")):
        sites = modules.imported_call_sites(arguments, functions, links)
        assert "_block" in _plan(sites)
        callers = {r.line_no: r.caller for r in sites.collect()}
        assert callers[16] == "outer" and callers[17] == "one" and callers[20] == "two" and callers[401] == last


def test_only_pairs_over_lines_are_stabbed(spark):
    lexed = source.lexed(_lines(spark, 1))
    points = lexed.where("bracket is null").select("file", "line_no")
    nodes = source.nodes_at(points.unionByName(points), source.intervals(lexed))
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "(last_line#" in plan and "> first_line#" in plan
    got = sorted((r.line_no, r.node_bracket) for r in nodes.collect())
    assert got == sorted(2 * [(1, "("), (2, "("), (3, "{"), (4, "{"), (5, "("), (6, "{"), (7, "`"), (8, "{"), (9, "("), (10, "{"), (11, "{"), (12, "("), (13, "(")])


def test_exports_are_read_once(spark, sf_dir):
    assert "MapInArrow" not in _plan(queries.imported_signatures(spark, sf_dir))


def test_parameters_are_traced_from_the_first_export_of_a_name(spark, sf_dir):
    found = queries.parameter_origins_of_traces(spark, sf_dir)
    assert "MapInArrow" not in _plan(found)
    first = modules.exports(queries._stated(spark, sf_dir)).where("kind = 'function'").groupBy("file", "name").agg(F.min("line_no").alias("line_no"))
    assert found.join(first, ["file", "line_no"], "left_anti").isEmpty()


def test_chunks_read_their_lines_once(spark, sf_dir):
    found = queries.semantic_chunks(spark, sf_dir)
    assert not [f for f in found.inputFiles() if "events.parquet" in f]
    assert "_block" in _plan(found)


def test_edges_are_contracted(spark):
    """Each round's edges are a part of the last one's, also along a path and about a hub; the join finds components in the same way."""
    path = [(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(600)]
    hub = [(5000, 5001 + i) for i in range(300)]
    edges = spark.createDataFrame([*path, *hub, (7000, 7001), (7001, 7000), (8000, 8000)], "src long, dst long")
    tables = []

    def keep(df):
        tables.append(written(df))
        return tables[-1]

    nodes = edges.select("src").union(edges.select("dst")).toDF("node")
    found = {r.node: r.component for r in graphs.components(nodes, edges, keep).collect()}
    ends = {n for e in path for n in e}
    assert {found[n] for n in ends} == {min(ends)} and {found[n] for e in hub for n in e} == {5000}
    assert (found[7001], found[8000]) == (7000, 8000) and len(found) == len(ends) + 301 + 3
    counts = [t.count() for t in tables if t.columns == ["a", "b"]]
    assert counts[0] == 901 and counts[-1] == 0 and sum(counts) < 2 * counts[0]
    assert jaccard_join.reached is graphs.reached
