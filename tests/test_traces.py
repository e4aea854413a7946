"""Traces of nested source: what is picked while lines are read gives what whole tables of lines and statements give, and scoping needs no join."""

import random

import pytest

from auditspan import queries
from auditspan.operators import code, modules, source
from auditspan.sources import relations
from auditspan.sources.shared import COMPILED, LONGEST, compiled

PIECES = [
    "export function f(key, iv) {", "  const seal = async (", "    data,", "  ) => {", "class K {", "  static run(salt, iv) {", "  for (const part of data) {", "  if (data) {", "}", "  }", "});", "", "// }",
    "  const iv = crypto.getRandomValues(new Uint8Array(12));", "  const buf = new Uint8Array(16);", "  crypto.getRandomValues(buf);", "  let salt = await hkdf(key, '}');", "  const key = 'fixed'; key = 12;", "  a = b = f(x);",
    "  await crypto.subtle.encrypt({ name: 'AES-GCM', iv: iv }, key, data);", "  await crypto.subtle.decrypt({ name: 'X', iv }, key, data); crypto.subtle.deriveKey({ salt: salt }, k);", "  iv", "    : buf,", "  crypto.subtle.deriveBits(",
    "    { salt: buf },", "  await crypto.subtle.wrapKey('raw', key, other);", "  const t = `crypto.subtle.encrypt( ${iv}`;", "  x = encryptFilename(name, iv);", "  /* crypto.subtle.sign( */", "function g(a, ...iv) { return seal(iv); }",
    "  get value(x) {", "  public static async go<T>(a, ...b): Promise<T> {", "  for$x(a) {", "  async(x) {", "export default async function* gen(a = f(1, 2), { b }) {", "const arrow = x => x;", "let h: Type = async function named(p, q) {",
    "abstract class Q extends R {", "iv = getRandomValues(x)\r", "x =\t deriveKey (k)", "p=new  Uint8Array(3)", "getRandomValues(p)", "  if$ (x) {", "é = 'x';", "  fore(x) {", "export   class E {", "é_1 = 12 ;", "  async", "  run(x) {",
]


def _files(rng, n=40):
    """(file, line_no, line), with gaps between numbers."""
    rows = []
    for f in range(n):
        no = 0
        for _ in range(rng.choice((1, 3, 15, 40))):
            no += rng.choice((1, 1, 1, 4))
            rows.append((f"f{f}", no, rng.choice(PIECES)))
    return rows


def _blocks(rng, rows):
    """The rows as blocks of lines that follow one another, cut at random."""
    blocks = []
    for file, no, line in rows:
        if blocks and blocks[-1][0] == file and blocks[-1][1] + len(blocks[-1][2]) == no and rng.random() < 0.7:
            blocks[-1][2].append(line)
        else:
            blocks.append((file, no, [line]))
    rng.shuffle(blocks)
    return blocks


def _rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def _picked(spark, blocks):
    made = spark.createDataFrame(blocks, "file string, line_no int, lines array<string>")
    return source.picked(made, code.ASSIGNED, code.SIGHT, modules.SIGN, modules.DECLARED, code.BEHIND, code.AHEAD)


@pytest.mark.parametrize("size", [1, 3, 10000])
def test_what_is_picked_gives_the_same(spark, size):
    rng = random.Random(size)
    rows = _files(rng)
    lexed = source.lexed(spark.createDataFrame(rows, "file string, line_no int, line string"))
    whole = code.masked(lexed)
    want = [_rows(x) for x in (code.traces(whole), code.assignments(whole), modules.functions(source.statements(lexed)))]
    assert min(map(len, want)) > 9
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        picked = _picked(spark, _blocks(rng, rows)).cache()
        lines = picked.where("line is not null")
        assert lines.count() < len(rows)
        assert [_rows(x) for x in (code.traces(lines), code.assignments(lines), modules.functions(picked.where("code is not null")))] == want
        picked.unpersist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_origins_equal_a_plain_search_of_the_scopes(spark):
    rng = random.Random(8)
    owned, assigned, found = [], [], []
    for f in ("a", "b", "c"):
        def nest(at, end, depth):
            while at <= end:
                last = min(at + rng.randint(0, 25), end)
                if rng.random() < 0.6:
                    owned.append((f, f"{f}{at}", at, last, depth, rng.sample(["iv", "key", "x"], rng.randint(0, 2))))  # noqa: B023
                    nest(at + 1, last, depth + 1)
                at = last + rng.randint(1, 4)

        nest(3, 120, 0)
        for no in range(1, 124):
            assigned += [(f, no, v, rng.choice(("derived", "computed")), f"by{no}") for v in ("iv", "key") if rng.random() < 0.15]
            found += [(f, no, "encrypt", role, var, "A") for role, var in (("iv", rng.choice(("iv", "unknown"))), ("key", "key"), ("helper", None)) if rng.random() < 0.3]
    made = code.scoped_origins(
        spark.createDataFrame(found, "file string, line_no int, operation string, role string, var string, algorithm string"), spark.createDataFrame(assigned, "file string, line_no int, var string, origin string, via string"),
        spark.createDataFrame(owned, "file string, name string, start_line int, end_line int, depth int, params array<string>"),
    )
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()

    def expected(file, no, operation, role, var, algorithm):
        around = lambda n: [s for s in owned if s[0] == file and s[2] <= n <= s[3]]
        scope = max(around(no), key=lambda s: s[4], default=None)
        first = min((x for x in assigned if x[0] == file and x[2] == var and x[1] <= no and max(around(x[1]), key=lambda s: s[4], default=None) == scope), key=lambda x: x[1], default=None)
        given = max((s[2] for s in around(no) if var in s[5]), default=None)
        origin, line, via = (first[3], first[1], first[4]) if first else ("parameter", given, None) if given else ("unknown", None, None)
        return file, no, scope and scope[1], operation, role, var, algorithm, origin, line, via

    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(expected(*x)) for x in found)


def test_nested_traces_reads_only_what_it_needs(spark, sf_dir):
    picked = _picked(spark, [tuple(r) for r in relations.nested_blocks(spark, sf_dir).collect()])
    events = relations.table(spark, sf_dir, "events").count()
    assert picked.count() < 4 * events and relations.nested_lines(spark, sf_dir).count() == 10 * events
    limit = spark.conf.get(LONGEST)
    found = queries.nested_traces(spark, sf_dir)
    assert spark.conf.get(LONGEST) == limit
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan
    with compiled(spark):
        assert spark.conf.get(LONGEST) == COMPILED
