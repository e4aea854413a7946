"""Lexed source against a plain character lexer, nesting against plain stabbing, and rules on the shapes that pattern rules have."""

import random

import pytest

from auditspan.operators import code, modules, rule_files, source, triage
from auditspan.sources.shared import written

ROW = "file string, line_no int, line string"


def table(spark, *texts):
    return spark.createDataFrame([(f"f{k}.ts", i + 1, x) for k, t in enumerate(texts) for i, x in enumerate(t.split("\n"))], ROW)


def mask(text):
    """Of each character whether it is code (c), string (s) or comment ( ), one at a time over the whole text; delimiters are code."""
    out, i, stack, last = [], 0, [], ""
    while i < len(text):
        c, two = text[i], text[i:i + 2]
        if stack and stack[-1] == "`":
            if two == "${":
                stack.append("${")
                out += "cc"
                i, last = i + 2, "{"
            elif c == "`":
                stack.pop()
                out.append("c")
                i, last = i + 1, '"'
            else:
                n = 2 if c == "\\" and text[i + 1:i + 2] not in ("", "\n") else 1
                out += ["c" if x == "\n" else "s" for x in text[i:i + n]]
                i += n
            continue
        if two == "//" or two == "/*":
            end = text.find("\n" if two == "//" else "*/", i + 2)
            end = len(text) if end < 0 else end + 2 * (two == "/*")
            out += ["c" if x == "\n" else " " for x in text[i:end]]
            i = end
            continue
        if c in "\"'":
            j = i + 1
            while j < len(text) and text[j] not in (c, "\n"):
                j += 2 if text[j] == "\\" and text[j + 1:j + 2] != "\n" else 1
            j = min(j, len(text))
            closed = text[j:j + 1] == c
            out += ["c", *"s" * (j - i - 1), *"c" * closed]
            i, last = j + closed, '"'
            continue
        if c == "/" and (last in ("", *"(,=:[!&|?{};+-*%<>~^") or last == "return"):
            j, group = i + 1, False
            while j < len(text) and text[j] != "\n" and (group or text[j] != "/"):
                group = (group or text[j] == "[") and text[j] != "]"
                j += 2 if text[j] == "\\" else 1
            if text[j:j + 1] == "/" and j > i + 1 and not group:
                end = j + 1
                while end < len(text) and "a" <= text[end] <= "z":  # flags
                    end += 1
                out += ["c", *"s" * (j - i - 1), *"c" * (end - j)]
                i, last = end, '"'
                continue
        if c == "`":
            stack.append("`")
        elif c == "{":
            stack.append("{")
        elif c == "}" and stack:
            stack.pop()
        word = c.isalnum() or c in "_$"
        j = i + 1
        while word and j < len(text) and (text[j].isalnum() or text[j] in "_$"):
            j += 1
        out += "c" * (j - i)
        if not c.isspace():
            last = text[i:j]
        i = j
    return "".join(out)


PIECES = ["a", "b(", ")", "{", "}", "[", "]", "=", ";", ",", " ", "\n", "'x{'", '"y\\")"', "'open", "`t (`", "`a ${b} c`", "`m\n${ {p: `q`} }\n{`", "// note :( '\n", "/* it's\n{ */", "= /[(/]'\\//", "return /x)/", "x / y", "`", "=> {", "é漢"]


def test_lexing_equals_a_plain_lexer():
    rng = random.Random(11)
    for _ in range(3000):
        depth, parts = 0, []
        for p in rng.choices(PIECES, k=rng.randrange(1, 25)):
            # Round and square brackets stay balanced here: what a stray one ends is the lexer's own choice.
            if p in ("b(", ")", "[", "]"):
                p = rng.choice(("b(1)", "[2]"))
            if p == "}" and depth == 0 or p == "`":
                continue
            depth += p.endswith("{") - (p == "}")
            parts.append(p)
        text = "".join(parts)
        lexer, got = source.Lexer(), []
        for i, line in enumerate(text.split("\n")):
            made, _, _ = lexer.line(i + 1, line)
            plain = "".join(c for c in made if not source.DEPTH <= ord(c) <= source.DEPTH + source.DEEPEST)
            assert len(plain) == len(line)
            want = mask(text).split
            got.append("".join("s" if ord(p) >= source.SHADOW and ord(p) < source.SHADOW + 128 else " " if p == " " and c != " " else "c" for p, c in zip(plain, line)))
        whole = mask(text)
        at = 0
        for line, g in zip(text.split("\n"), got):
            w = whole[at:at + len(line)]
            at += len(line) + 1
            # Blanks in comments and letters beyond ASCII look alike either way.
            assert all(x == y or c == " " or ord(c) > 127 for x, y, c in zip(w, g, line)), (text, line, w, g)


def test_brackets_in_comments_patterns_and_templates_hide_no_function(spark):
    text = """// see the notes :(
const open = /\\(/;
export function one(a) {
  const t = `${a} ( {
  } ${ {b: `)`} }`;
  /* } ) */
}
export const two = (x, y = ")") => {
  foo(
}
export function three() {}
// {"""
    lexed = source.lexed(table(spark, text))
    stated = source.statements(lexed)
    assert {(r.name, r.start_line, r.end_line, tuple(r.params)) for r in modules.functions(stated).collect()} == {("one", 3, 7, ("a",)), ("two", 8, 10, ("x", "y")), ("three", 11, 11, ())}
    assert modules.exports(stated).count() == 3
    assert [r.text for r in stated.where("line_no = 4").select(source.plain(stated["code"]).alias("text")).collect()] == ["  const t = `${a} ( {\n  } ${ {b: `)`} }`;"]
    empty = spark.createDataFrame([], ROW)
    assert source.lexed(empty).count() == 0 and source.statements(source.lexed(empty)).count() == 0
    odd = source.lexed(spark.createDataFrame([("o", 1, None), ("o", 2, ")} ]"), ("o", 3, "é  (")], ROW))
    assert [(r.line_no, r.line) for r in odd.where("bracket is null").orderBy("line_no").collect()] == [(1, None), (2, ")} ]"), (3, "é  (")]
    assert [(r.bracket, r.first_line, r.last_line) for r in source.intervals(odd).collect()] == [("(", 3, 3)]


def test_innermost_equals_plain_stabbing(spark):
    rng = random.Random(2)
    spans, points = [], []
    for f in ("a", "b", "empty"):
        def nest(lo, hi, depth, f=f):
            at = lo
            while at < hi and f != "empty":
                first = rng.randrange(at, hi + 1)
                last = rng.randrange(first, hi + 1)
                spans.append((f, depth, first, last, f"{f}{len(spans)}"))
                if depth < 5 and last - first > 2:
                    nest(first + 1, last - 1, depth + 1)
                at = last + 1 + rng.randrange(8)
        nest(0, 120, 0)
        points += [(f, p, p * 7) for p in range(-1, 123)] + [(f, 5, 1), (f, 5, 1)]
    s = spark.createDataFrame(spans, "file string, depth int, first int, last int, name string")
    out = source.innermost(spark.createDataFrame(points, "file string, at int, more int"), s).collect()
    assert len(out) == len(points)
    for r in out:
        held = [x for x in spans if x[0] == r.file and x[2] <= r.at <= x[3]]
        want = max(held, key=lambda x: (x[2], -x[3], x[1]), default=None)
        assert (r.name, r.depth) == ((want[4], want[1]) if want else (None, None))
    every = {(r.file, r.at, r.name) for r in source.around(spark.createDataFrame(points, "file string, at int, more int"), s).collect()}
    assert every == {(f, p, x[4]) for f, p, _ in points for x in spans if x[0] == f and x[2] <= p <= x[3]}


def test_nodes_at_lines_equal_plain_stabbing(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(3):
        lines = []
        for _ in range(60):
            lines.append(rng.choice(["f(a, [1]);", "if (x) {", "}", "const o = { p: g(2) };", "// )", "go(() => {", "});", "", "x = y"]))
        texts.append("\n".join(lines))
    lexed = written(source.lexed(table(spark, *texts)))
    spans = source.intervals(lexed)
    known = [r.asDict() for r in spans.collect()]
    points = lexed.where("bracket is null").select("file", "line_no")
    for r in source.nodes_at(points, spans).collect():
        lo = r.line_no * source.LINE
        held = [k for k in known if k["file"] == r.file and k["first"] < lo + source.LINE and k["last"] >= lo]
        want = max(held, key=lambda k: (k["first"], -k["last"]), default=None)
        assert r.node_first == (want and want["first"]) and r.node_last == (want and want["last"])


def test_two_functions_with_the_same_names_have_their_own_origins(spark):
    text = """export async function a(key, data) {
  const iv = crypto.getRandomValues(new Uint8Array(12));
  return crypto.subtle.encrypt({ name: 'AES-GCM', iv }, key, data);
}
export async function b(iv, key) {
  // const iv = hkdf(key);
  return crypto.subtle.encrypt({ name: 'AES-CBC', iv: iv }, key, "const iv = 1;");
}
await crypto.subtle.decrypt({ name: 'X', iv: iv }, key, d);"""
    lexed = source.lexed(table(spark, text))
    rows = code.masked(lexed)
    out = code.scoped_origins(code.traces(rows), code.assignments(rows), modules.functions(source.statements(lexed))).where("role = 'iv'")
    assert {(r.line_no, r.function, r.var, r.origin, r.origin_line) for r in out.collect()} == {(3, "a", "iv", "crypto_random", 2), (7, "b", "iv", "parameter", 5), (9, None, "iv", "unknown", None)}


def hits(spark, text, *parts, path="f0.ts", **more):
    rows = spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(text.split("\n"))], ROW)
    lexed = written(source.lexed(rows))
    stated = written(source.statements(lexed))
    rule = {"id": "r", "patterns": list(parts), **more}
    out = rule_files.run_rules(stated, modules.functions(stated), [rule], source.intervals(lexed)).collect()
    return sorted((r.line_start, r.line_end) for r in out) if "message" not in more else sorted((r.line_start, r.message) for r in out)


def test_bindings_of_a_rule_are_one(spark):
    text = """function a() {
  const salt = new Uint8Array(8);
  const iv = new Uint8Array(8);
  use({ name: 'AES-GCM', iv: iv });
}
function b() {
  const iv = new Uint8Array(8);
  // { name: 'AES-GCM', iv: iv }
}"""
    inside = {"pattern-inside": "...\n{ name: 'AES-GCM', iv: $IV }"}
    assert hits(spark, text, {"pattern": "const $IV = new Uint8Array($SIZE)"}, inside) == [(3, 3)]
    assert hits(spark, text, {"pattern": "const $IV = new Uint8Array($SIZE)"}, {"pattern-not-inside": "...\n{ name: 'AES-GCM', iv: $IV }"}) == [(2, 2), (7, 7)]
    assert hits(spark, text, {"pattern": "const $IV = new Uint8Array($SIZE)"}, inside, message="$IV of $SIZE, $OTHER") == [(3, "iv of 8, $OTHER")]
    conj = hits(spark, "f(a, a)\nf(a, b)", {"pattern": "f($X, $Y)"}, {"pattern": "f($X, $X)"})
    assert conj == [(1, 1)]


def test_loops_end_and_every_match_counts(spark):
    loop = "for (...) {\n ...\n crypto.subtle.encrypt({ name: 'AES-GCM', iv: $IV }, $KEY, $DATA)\n ...\n}"
    call = "crypto.subtle.encrypt({ name: 'AES-GCM', iv: iv }, k, d);"
    text = f"for (const x of y) {{\n  go(x);\n}}\n{call}\nfor (;;) {{\n  if (z) {{ {call} }}\n}}\nfor (a of b) {{ // {call}\n}}"
    assert hits(spark, text, {"pattern": loop}) == [(5, 7)]
    weak = ({"pattern": "bcrypt.hash($P, $ROUNDS)"}, {"metavariable-comparison": {"metavariable": "$ROUNDS", "comparison": "$ROUNDS < 12"}})
    assert hits(spark, "a(bcrypt.hash(p, 12), bcrypt.hash(q, 4))", *weak, message="$ROUNDS") == [(1, "4")]
    assert hits(spark, "// bcrypt.hash(p, 4)\nx = 'bcrypt.hash(p, 4)'\ny = `${bcrypt.hash(p, 4)}`\nz = bcrypt.hash(bcrypt.hash(s, 3), 20)", *weak) == [(3, 3), (4, 4)]


#: (pattern parts, lines with a hit, lines without one)
SHAPES = [
    ([{"pattern": "{ ..., algorithm: 'none', ... }"}], ["sign(p, { algorithm: 'none' })", 'x = { a: 1, algorithm: "none", b }'], ["sign(p, { algorithm: 'HS512' })", "s = \"{ algorithm: 'none' }\"", "f({ g: { other: 'none' } })"]),
    ([{"pattern": '{ ..., alg: "$ALG", ... }'}, {"metavariable-regex": {"metavariable": "$ALG", "regex": "^(A|B)$"}}], ["x = { alg: 'A' }"], ["x = { alg: 'AB' }", "x = { alg: B }"]),
    ([{"pattern": "$Q = `... $PASSWORD ...`"}, {"metavariable-regex": {"metavariable": "$PASSWORD", "regex": "pass"}}], ["const q = `select ${password} x`"], ["const q = 'select ${password}'", "const q = `select ${name}`"]),
    ([{"pattern": "{ name: 'GCM', iv: new Uint8Array([$...VALUES]) }"}], ["e({ name: 'GCM', iv: new Uint8Array([1, 2, 3]) })"], ["e({ name: 'GCM', iv: new Uint8Array(12) })"]),
    ([{"pattern": "{ name: 'GCM', ..., tagLength: $LEN, ... }"}, {"metavariable-comparison": {"metavariable": "$LEN", "comparison": "$LEN < 128"}}], ["e({ name: 'GCM', iv, tagLength: 96 })", "e({ name: 'GCM', tagLength: 64, x: f(1, 2) })"], ["e({ name: 'GCM', iv, tagLength: 128 })"]),
    ([{"pattern": "lib.import('raw', new Coder().encode(\"...\"), ...)"}], ["await lib.import('raw', new Coder().encode('abc'), x, true)"], ["await lib.import('raw', new Coder().encode(abc), x)", "await lib.import('pkcs8', new Coder().encode('abc'), x)"]),
    ([{"pattern": 'const $K = "..."'}], ["const k = 'v';", 'const k: string = "v"'], ["const k = f('v');", "let k = 'v'"]),
    ([{"pattern": "lib.make($ALG, true, $USES)"}], ["lib.make({ name: 'x' }, true, ['sign'])"], ["lib.make({ name: 'x' }, false, ['sign'])"]),
    ([{"pattern": "hash({..., cost: $M, ...})"}, {"metavariable-comparison": {"metavariable": "$M", "comparison": "$M < 65536"}}], ["hash({ a, cost: 1_024 })"], ["hash({ cost: 65536 })", "hash({ o: { cost: 3 } })"]),
    ([{"pattern": "eval(...)"}], ["eval(x)", "f(eval(a, b))"], ["evaluate(x)", "o.eval(x)", "// eval(x)"]),
    ([{"pattern-either": [{"pattern": "log(..., $K, ...)"}, {"pattern": "log($K)"}]}, {"metavariable-regex": {"metavariable": "$K", "regex": "(?i)secret"}}], ["log('x', secretKey)", "log(mySecret)", "log(a, secret, b)"], ["log(a, b)", "logger(secret)", "// log(secret)"]),
    ([{"pattern": "throw new Error(`... ${$K} ...`)"}, {"metavariable-regex": {"metavariable": "$K", "regex": "key"}}], ["throw new Error(`bad ${key} here`)"], ["throw new Error(`bad key ${name}`)", "throw new Error('bad ${key}')"]),
    ([{"pattern": "lib.subtle.$M(\"$ALG\", ...)"}], ["lib.subtle.digest('SHA-1', d)"], ["lib.subtle.digest(alg, d)"]),
    ([{"pattern": "$A === $B"}], ["if (a.b === c) {}", "x = f(1) === g(2)"], ["a == b", "a !== b", "'a === b'"]),
    ([{"pattern-either": [{"pattern": "$T == $O"}, {"pattern": "$T !== $O"}]}], ["if (a == b) {}", "if (a !== b) {}"], ["a === b", "a != b", "a => b", "a >= b"]),
    ([{"pattern": "store[$K] = $V"}], ["store[k] = v", "store['k'] = f(1)"], ["store.k = v", "store[k] == v"]),
    ([{"pattern": "res.json({ ..., $K: $V, ... })"}, {"metavariable-regex": {"metavariable": "$K", "regex": "pass"}}], ["res.json({ ok: 1, password: p })"], ["res.json({ ok: 1 })", "res.json(password)"]),
    ([{"pattern": "app.use(helmet(...))"}, {"pattern-not": "app.use(helmet({ ..., csp: ..., ... }))"}], ["app.use(helmet())", "app.use(helmet({ a: 1 }))"], ["app.use(helmet({ csp: { x: 1 } }))", "app.use(cors())"]),
    ([{"pattern": "{ ..., origin: '*', ... }"}], ["cors({ origin: '*' })"], ["cors({ origin: 'a' })"]),
    ([{"pattern": "path.join(..., $I, ...)"}, {"pattern-inside": "$APP.$METHOD($PATH, ...)"}], ["app.get('/x', () => { path.join(a, b) })"], ["join(a, b)", "x = path.join"]),
    ([{"pattern": "process.env.$K"}], ["x = process.env.KEY", "f(process.env.A, 1)"], ["process.environment", "'process.env.K'"]),
    ([{"pattern": "new Peer($C)"}, {"pattern-not": "new Peer({ ..., policy: 'relay', ... })"}], ["p = new Peer(config)", "p = new Peer({ policy: 'all' })"], ["p = new Peer({ a: 1, policy: 'relay' })"]),
    ([{"pattern": "$DB.query(`... ${$IN} ...`)"}], ["await db.query(`select ${id} from t`)"], ["await db.query(`select 1`)", "await db.query('x', `${y}`)"]),
    ([{"pattern": "$R = await lib.decrypt(...)"}, {"pattern-not-inside": "try { ... } catch (...) { ... }"}], ["const r = await lib.decrypt(a, { b: 1 })"], ["try { const r = await lib.decrypt(a) } catch (e) { }", "lib.decrypt(a)"]),
    ([{"pattern": "Math.random()"}, {"pattern-inside": "$IV = ...\n...\n{ ..., iv: $IV, ... }"}], ["const iv = Math.random()\nuse({ a: 1, iv: iv })"], ["const iv = Math.random()\nuse({ iv: other })", "const o = Math.random()\nconst iv = 1\nuse({ iv: iv })"]),
]


@pytest.fixture(scope="module")
def shaped(spark):
    """The files in which each of SHAPES hits, all lines of which are files of their own."""
    rows = [(f"s{i}/{kind}{j}.ts", n + 1, x) for i, (_, good, bad) in enumerate(SHAPES) for kind, texts in (("good", good), ("bad", bad)) for j, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    lexed = written(source.lexed(spark.createDataFrame(rows, ROW)))
    stated = written(source.statements(lexed))
    rules = [{"id": f"s{i}", "patterns": parts, "paths": {"include": [f"s{i}/*.ts"]}} for i, (parts, _, _) in enumerate(SHAPES)]
    found = rule_files.run_rules(stated, modules.functions(stated), rules, source.intervals(lexed)).collect()
    return {f"s{i}": {r.file for r in found if r.rule_id == f"s{i}"} for i in range(len(SHAPES))}


@pytest.mark.parametrize("i", range(len(SHAPES)))
def test_rule_shapes(shaped, i):
    assert shaped[f"s{i}"] == {f"s{i}/good{j}.ts" for j in range(len(SHAPES[i][1]))}


def test_constructs_are_looked_for_in_the_node_around(spark):
    text = "const o = makeKey({\n  plain,\n  other\n});\nplain"
    lexed = source.lexed(table(spark, text))
    files = spark.createDataFrame([("f0.ts", text)], "file string, text string")
    found = spark.createDataFrame([(1, "f0.ts", "KL1", 2, 2, "not there", "passed_layer1"), (2, "f0.ts", "KL1", 5, 5, "not there", "passed_layer1")], "pos int, file string, checklist_item string, line_start int, line_end int, evidence string, triage_status string")
    nodes = triage.node_texts(found.selectExpr("file", "line_start as line_no"), lexed)
    assert {(r.line_no, r.node_text) for r in nodes.collect()} == {(2, "const o = makeKey({\n  plain,\n  other\n});"), (5, "plain")}
    assert {(r.pos, r.evidence_quality) for r in triage.evidence_quality(found, files, nodes).collect()} == {(1, "fuzzy"), (2, "no_match")}
    assert {(r.pos, r.evidence_quality) for r in triage.evidence_quality(found, files).collect()} == {(1, "no_match"), (2, "no_match")}


def test_containment_of_matches_is_no_join(spark):
    rng = random.Random(11)
    spans = lambda n: [(f"f{rng.randint(0, 2)}", a := rng.randint(0, 60), a + rng.randint(0, 30), {"X": rng.choice("ab")} if rng.random() < 0.8 else {}) for _ in range(n)]
    left, right = spans(80), spans(40)
    rows = spark.createDataFrame(left, "file string, first long, last long, values map<string,string>")
    inner = spark.createDataFrame(right, "file string, _a long, _z long, _more map<string,string>")
    for names in (frozenset(), frozenset("X")):
        held = rule_files._covered(rows, inner, names)
        same = lambda v, w: not names or "X" in v and v.get("X") == w.get("X")  # noqa: B023, E731
        want = [r for r in left if any(r[0] == i[0] and i[1] <= r[1] and i[2] >= r[2] and same(r[3], i[3]) for i in right)]
        assert sorted(map(str, map(tuple, held.collect()))) == sorted(map(str, want))
        assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()


def test_lines_read_before_come_to_the_same():
    rng = random.Random(12)
    pieces = ["(", ")", "{", "}", "[", "]", "`", "${", "/*", "*/", "//", "'", "if", "class", "function", "=>", "case", ":", ";", ",", "a", "=", " ", "/x(/", "\\", "."]
    lines = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    seen = {}
    for _ in range(300):
        plain, shared = source.Lexer(), source.Lexer(seen)
        for no in sorted(rng.randint(0, 20) for _ in range(15)):
            text = rng.choice(lines)
            assert shared.line(no, text) == plain._read(no, text)
        assert shared.end() == plain.end()
    assert 0 < len(seen) <= source.MOST
