"""Lexed source: what is code in each line, how its brackets nest, and where statements begin.

A line's `code` is the line with comments blanked, with the characters of strings, templates and regular expressions moved into a shadow
alphabet, and with a mark behind each bracket that says how deep it is. The two brackets of a pair bear the same mark and nothing between
them does, so a plain regular expression with a back reference finds what a bracket holds at any nesting, and nothing in a comment or string
is taken for code. `plain` gives the text back.

Lexing goes through a file's lines in order with a stack of open brackets; a task holds a batch of lines and that stack. Files are dealt
over tasks, so one file's lines are read by one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depth marks, of which the last is that of a bracket without a partner, and the shadow alphabet: ASCII moved up.
DEPTH, DEEPEST, SHADOW = 0xE000, 0xFFF, 0xF000
MARK = f"[{chr(DEPTH)}-{chr(DEPTH + DEEPEST)}]"
#: A character that no code has.
FREE = chr(SHADOW)
_ASCII = "".join(map(chr, range(1, 0x80)))
SHADOWS = "".join(chr(SHADOW + ord(c)) for c in _ASCII)
HIDDEN = f"[^\\x00-\\x7f{chr(DEPTH)}-{chr(DEPTH + DEEPEST)}]"
_HIDE = {ord(c): SHADOW + ord(c) for c in _ASCII}
_TAKEN = re.compile(f"[{chr(DEPTH)}-{SHADOWS[-1]}]")
#: A place in a file: its line times this, and the column in `code`.
LINE = 1 << 21
#: Lines and spans of lines are joined by blocks of so many lines.
BLOCK = 16

_TOKEN = re.compile(r"""//.*|/\*|"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|`|[()\[\]{}]|(?:[^\W\d]|\$)[\w$]*|\d[\w.]*|=>|\s+|.""", re.S)
#: Words and blanks, which are read at once, and what they begin with.
_WORDS = re.compile(r"(?:[ \t]++|[A-Za-z_]\w*+(?!\$))+")
_WORDY = frozenset(" \tABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
_REGEX = re.compile(r"/(?:[^/\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{)|\\$)*", re.S)
_GOES_ON = re.compile(r"\s*(?:\.(?!\.)|\?\.|&&|\|\||\?\?|\?\s)")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Behind these a slash starts a regular expression, or a line goes on.
_BEFORE_REGEX = {"", *"(,=:[!&|?{};+-*%<>~^", "=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}
_OPEN_ENDED = {*"=+-*%&|^?,<", "=>"}
#: Before a brace these make it an object or a list of names, and these a block of their own.
_BEFORE_OBJECT = {"import", "export", "type", "const", "let", "var", "return", "of", "in", "default", "await", "yield", "typeof", "case", "new", "throw"}
#: Lines of so many characters in so many brackets are kept, at most so many.
SHORT, SHALLOW, MOST = 200, 16, 1 << 15
_BLOCK_WORDS = {"else", "try", "finally", "do", "static"}
CONTROL = ("if", "for", "while", "switch", "catch", "with")


class _State:
    """What a lexer is in before a line, but for places: comment, last, round, klass and case; its brackets are in the key it is kept under."""

    __slots__ = ("held",)

    def __init__(self, held: tuple) -> None:
        self.held = held


class Lexer:
    """Reads the lines of one file. `line` returns the code, the first line of the statement and the brackets that closed.

    What a line comes to follows from its text and the state before it, so lines that stand in many places are read once: `seen` holds
    what they came to, and can be shared between files. While `state` is set, what it holds is not set on the lexer."""

    def __init__(self, seen: dict | None = None) -> None:
        self.seen = {} if seen is None else seen
        self.state: _State | None = None
        self.stack: list[list] = []  # [bracket, place, owner, whether it is a block, statement, line]
        self.comment, self.last, self.statement = False, "", 0
        self.case = False  # whether a colon ends a case
        self.round, self.klass = None, False  # the control word before the last closed round bracket, or an empty one, and whether a class was named, since the last statement or brace

    def _open(self, bracket: str, at: int, owner: str, block: bool) -> str:
        self.stack.append([bracket, self.no * LINE + at, owner, block, self.statement, self.no])
        return bracket + chr(DEPTH + min(len(self.stack) - 1, DEEPEST - 1))

    def _brace(self) -> tuple[str, bool]:
        """Who owns a brace that opens here, and whether it is a block."""
        last, kept = self.last, self.round
        if last == "=>":
            return "function", True
        if last == ")":
            return (kept if kept in CONTROL else "function"), True
        if last in _BLOCK_WORDS:
            return last, True
        if last in _BEFORE_OBJECT:
            return "", False
        if last in ("", ";", "{", "}"):
            return "", True
        if last in (">", "]") or last[0].isalpha() or last[0] in "_$":
            return ("class" if self.klass else "function" if kept is not None else ""), True
        return "", False

    def _close(self, bracket: str, at: int, closed: list) -> str:
        wanted = _PAIRS[bracket]
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "`":
                break
            if self.stack[i][0] == wanted:
                for depth in range(len(self.stack) - 1, i - 1, -1):  # what is still open within ends here too
                    closed.append((*self.stack.pop(), depth, self.no * LINE + at, self.no))
                if bracket == ")":
                    self.round = closed[-1][2] if closed[-1][2] in CONTROL else ""
                return bracket + chr(DEPTH + min(i, DEEPEST - 1))
        return bracket + chr(DEPTH + DEEPEST)

    def line(self, no: int, text: str) -> tuple[str, int, list[tuple]]:
        known = self.seen.get((self.state, text)) if no else None
        if known is None:
            return self._unknown(no, text)
        out, starts, kept, opened, ended, self.state = known
        self.no = no
        if starts:
            self.statement = no
        if not ended and not opened:
            return out, self.statement, []
        stack, base = self.stack, no * LINE
        closed = [(*(stack[depth] if new is None else (new[0], base + new[1], new[2], new[3], self.statement, no)), depth, base + at, no) for depth, at, new in ended]
        del stack[kept:]
        stack += [[bracket, base + at, owner, block, self.statement, no] for bracket, at, owner, block in opened]
        return out, self.statement, closed

    def _unknown(self, no: int, text: str) -> tuple[str, int, list[tuple]]:
        if self.state:
            self.comment, self.last, self.round, self.klass, self.case = self.state.held
        elif no and self._settle():
            return self.line(no, text)
        if no and len(text) <= SHORT and len(self.stack) <= SHALLOW:
            return self._learned(no, text)
        found = self._read(no, text)
        self._settle()
        return found

    def _settle(self) -> bool:
        """Sets the state, the same object for all that is equal; none where brackets are deep. Keys are states, not what they hold, so that looking a line up is cheap."""
        self.state = None
        if len(self.stack) <= SHALLOW:
            held = self.comment, self.last, self.round, self.klass, self.case
            key = (held, not self.statement, *[x for e in self.stack for x in (e[0], e[2], e[3])])
            self.state = self.seen.get(key) or self._kept(key, _State(held))
        return self.state is not None

    def _kept(self, key: tuple, known):
        if len(self.seen) >= MOST:
            self.seen.clear()
        self.seen[key] = known
        return known

    def _learned(self, no: int, text: str) -> tuple[str, int, list[tuple]]:
        """`_read`, kept under the state and the text with all places relative to the line."""
        key, deep, before, base = (self.state, text), len(self.stack), self.statement, no * LINE
        self.statement = mark = -LINE if before else None  # a statement begins here if this changes
        out, statement, closed = self._read(no, text)
        starts = self.statement != mark
        if not starts:
            self.statement = statement = before
        kept, ended, done = deep, [], []
        for bracket, place, owner, block, of, line, depth, at, _ in closed:
            old = depth < kept  # the first to close at a depth of before was open before
            kept = min(kept, depth)
            ended.append((depth, at - base, None if old else (bracket, place - base, owner, block)))
            done.append((bracket, place, owner, block, of if old else statement, line, depth, at, no))
        for e in self.stack[kept:]:
            e[4] = statement
        opened = [(e[0], e[1] - base, e[2], e[3]) for e in self.stack[kept:]]
        if self._settle():
            self._kept(key, (out, starts, kept, opened, ended, self.state))
        return out, statement, done

    def _read(self, no: int, text: str) -> tuple[str, int, list[tuple]]:
        self.no, out, closed, i = no, "", [], 0
        text = _TAKEN.sub("�", text)
        top = self.stack[-1] if self.stack else None
        if not (self.comment or self.last in _OPEN_ENDED or (top and not top[3]) or (self.statement and _GOES_ON.match(text))):
            self.statement, self.round, self.klass = no, None, False
        while i < len(text):
            if self.comment:
                end = text.find("*/", i)
                j = len(text) if end < 0 else end + 2
                self.comment, out, i = end < 0, out + " " * (j - i), j
                continue
            if self.stack and self.stack[-1][0] == "`":
                m = _TEMPLATE.match(text, i)
                out, i = out + m[0].translate(_HIDE), m.end()
                if text.startswith("`", i):
                    closed.append((*self.stack.pop(), len(self.stack), no * LINE + len(out), no))
                    out, i, self.last = out + "`", i + 1, '"'
                elif text.startswith("${", i):
                    out += "$"
                    out, i, self.last = out + self._open("{", len(out), "$", False), i + 2, "{"
                continue
            if text[i] in _WORDY and (m := _WORDS.match(text, i)):
                words = m[0].split()
                out, i = out + m[0], m.end()
                if words:
                    self.last = words[-1]
                    self.klass |= "class" in words
                    self.case |= "case" in words or "default" in words
                continue
            m = _TOKEN.match(text, i)
            token = m[0]
            if token == "/" and self.last in _BEFORE_REGEX and (r := _REGEX.match(text, i)):
                cut = r[0].rindex("/")
                out, i, self.last = out + "/" + r[0][1:cut].translate(_HIDE) + r[0][cut:], r.end(), '"'
                continue
            i = m.end()
            if token.startswith("//"):
                out += " " * len(token)
            elif token == "/*":
                self.comment, out = True, out + "  "
            elif token[0] in "\"'":
                whole = len(token) > 1 and token[-1] == token[0]
                out += token[0] + token[1:len(token) - whole].translate(_HIDE) + (token[0] if whole else "")
                self.last = '"'
            elif token == "`":
                self.stack.append(["`", no * LINE + len(out), "", False, self.statement, no])
                out += token
            elif token in "([":
                out += self._open(token, len(out), self.last if token == "(" and (self.last[:1].isalpha() or self.last[:1] in ("_", "$")) else "", False)
                self.last = token
            elif token == "{":
                owner, block = self._brace()
                out += self._open(token, len(out), owner, block)
                self.last, self.round, self.klass = token, None, False
            elif token in _PAIRS:
                kept = self.round
                out += self._close(token, len(out), closed)
                self.last = token
                if token == "}":
                    self.round, self.klass = None, False
                elif token == "]":
                    self.round = kept
            else:
                out += token
                if not token.isspace():
                    self.last = token
                    self.klass |= token == "class"
                    self.case |= token in ("case", "default")
                    if token == ":" and self.case and (not self.stack or self.stack[-1][3]):
                        self.last, self.case = ";", False
                    if token == ";":
                        self.round, self.klass = None, False
        return out, self.statement, closed

    def end(self) -> list[tuple]:
        """What is still open at the end of the file, as closing there."""
        return [(*self.stack.pop(), len(self.stack), (self.no + 1) * LINE - 1, self.no) for _ in range(len(self.stack))]


_ROWS = ("file", "statement", "line_no", "line", "code", "level", "bracket", "first", "owner", "block", "first_line", "depth", "last", "last_line", "end_line")
_KINDS = "file string, statement int, line_no int, line string, code string, level int, bracket string, first long, owner string, block boolean, first_line int, depth int, last long, last_line int, end_line int"


class _Statements:
    """Puts the lines of one file's statements together as they come; holds those that may still get a line, or whose blocks are open."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}  # by first line: level, last line, lines, codes, the outermost block's depth and place, where it closes

    def add(self, no: int, text: str, code: str, level: int, statement: int) -> None:
        known = self.held.get(statement)
        if known is None:
            self.held[statement] = [level, no, [text], [code], None, no]
        else:
            known[1] = no
            known[2].append(text)
            known[3].append(code)

    def close(self, closed: list[tuple]) -> None:
        for _, place, _, block, statement, _, depth, _, line in closed:
            if block:
                known = self.held[statement]
                if known[4] is None or (depth, place) < known[4]:
                    known[4:] = (depth, place), line

    def take(self, but: set[int]) -> Iterator[tuple]:
        """Those that do not begin on one of these lines, as (line_no, level, last, line, code, end_line); they are held no longer."""
        for no in [n for n in self.held if n not in but]:
            level, last, texts, codes, _, closes = self.held.pop(no)
            yield no, level, last, "\n".join(texts), "\n".join(codes), max(last, closes)


def lexed(rows: DataFrame, only: tuple[str, ...] = ("lines", "pairs", "statements")) -> DataFrame:
    """A row for each of (file, line_no, line), with its code, the first line of its statement and how many brackets are open before it;
    one for each pair of brackets, or template, with its owner, whether it is a block, its depth and places, and the statement that opens it;
    and one for each statement, which has an end_line (see `statements`). `only`: which of them are made.

    The other's columns are null in each. A block's owner is `function`, `class`, a control word, or empty. A bracket left open ends with
    the one around it, or with the file; one that closes nothing has no row. Lines are taken in order of line_no; a null line is empty.
    Lines, and they alone, have a null bracket; a statement's is empty."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer, file, seen, whole, closed, done = None, None, {}, _Statements(), [], []
        lines, pairs, statements = (x in only for x in ("lines", "pairs", "statements"))

        def batch(n: int, columns: dict) -> pa.RecordBatch:
            held = [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(_ROWS, kinds)]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(held, kinds)], list(_ROWS))

        def made(names: tuple, found: list) -> Iterator[pa.RecordBatch]:
            if found:
                yield batch(len(found), dict(zip(names, zip(*found))))
                found.clear()

        def ended(found: list) -> None:
            if statements:
                whole.close(found)
            if pairs:
                closed.extend((file, *c) for c in found)

        def over(but: set[int]) -> None:
            done.extend((file, "", no, *rest) for no, *rest in whole.take(but))

        def given() -> Iterator[pa.RecordBatch]:
            yield from made(("file", "bracket", "first", "owner", "block", "statement", "first_line", "depth", "last", "last_line"), closed)
            yield from made(("file", "bracket", "line_no", "level", "last_line", "line", "code", "end_line"), done)

        for part in batches:
            out = []
            for name, no, text in zip(*(part.column(c).to_pylist() for c in ("file", "line_no", "line"))):
                if lexer is None or name != file:
                    if lexer:
                        ended(lexer.end())
                        over(set())
                    lexer, file = Lexer(seen), name
                text, level = text or "", len(lexer.stack)
                code, statement, found = lexer.line(no, text)
                if lines:
                    out.append((statement, code, level))
                if statements:
                    whole.add(no, text, code, level, statement)
                if found:
                    ended(found)
            if out:
                yield batch(len(out), dict(zip(("statement", "code", "level"), zip(*out))) | {c: part.column(c) for c in ("file", "line_no", "line")})
            if lexer:
                over({lexer.statement, *(e[4] for e in lexer.stack)})
            yield from given()
        if lexer:
            ended(lexer.end())
            over(set())
            yield from given()

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return dealt(rows.select("file", F.col("line_no").cast("int").alias("line_no"), "line"), "line_no").mapInArrow(read, _KINDS)


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows with those of a file in one part, in order. Reading costs more than the bytes tell, by which Spark would join parts to hardly more than there are cores."""
    session = rows.sparkSession
    parts = max(3 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "file").sortWithinPartitions("file", *order)


def values(column: pa.Array) -> list:
    """The column's values, in a fraction of `to_pylist`'s time; numbers must not be null."""
    return column.to_numpy(zero_copy_only=False).tolist()


_PICKED = "file string, line_no int, line string, behind array<string>, ahead array<string>, code string, level int, end_line int"


def picked(blocks: DataFrame, kept: str, wide: str, sign: str, declared: str, behind: int, ahead: int) -> DataFrame:
    """Of the lines of `lexed` those in which the pattern `kept` or `wide` is found, of its statements those with `sign` in one of their lines and `declared` in their code.

    A line has its code as `line`, without marks; where `wide` is found also the lines around it, up to so many behind and ahead; its code
    is null. A statement has its code, level and end_line; its `line` is null. blocks: (file, line_no, lines), lines that follow one another
    from line_no on. Lines' patterns are sought in code without marks, and what is found is kept like what the line was read to. Python tries
    them with ASCII's classes, as Spark does."""
    patterns, declares = [re.compile(p, re.ASCII) for p in (kept, wide, sign)], re.compile(declared, re.ASCII)
    mark = re.compile(MARK)
    schema = pa.schema([("file", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), *((c, pa.list_(pa.string())) for c in ("behind", "ahead")), ("code", pa.string()), ("level", pa.int32()), ("end_line", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer, file, seen, told, fit = None, None, {}, {}, {}
        plains, sights, held = [], [], {}  # of the file: lines without marks, numbers of wide ones and where they are in it, and statements as `_Statements` has them
        singles, wides, whole = [], [], []  # rows
        at, codes, known, above = None, [], None, 0  # the statement that lines are of

        def tell(code: str) -> tuple:
            """The code without marks, whether `wide` or `kept` is found in it, and whether `declared` is."""
            plain = mark.sub("", code)
            one, more, sign = (p.search(plain) is not None for p in patterns)
            if len(code) <= 2 * SHORT:
                if len(told) >= MOST:
                    told.clear()
                told[code] = plain, 2 if more else 1 if one else 0, sign
            return plain, 2 if more else 1 if one else 0, sign

        def close(closed: list) -> None:
            for _, place, _, block, statement, _, depth, _, line in closed:
                if block:
                    mine = held.get(statement)
                    if mine is None:
                        mine = held[statement] = [above, no, codes, None, 0, False]
                    if mine[3] is None or (depth, place) < mine[3]:
                        mine[3:5] = (depth, place), line

        def over(but: set[int]) -> None:
            for n in [n for n in held if n not in but]:
                level, last, texts, _, closes, sign = held.pop(n)
                if sign:
                    text = "\n".join(texts)
                    fits = fit.get(text)
                    if fits is None:
                        fits = declares.search(text) is not None
                        if len(text) <= 2 * SHORT:
                            if len(fit) >= MOST:
                                fit.clear()
                            fit[text] = fits
                    if fits:
                        whole.append((file, n, text, level, max(last, closes)))

        def seen_to(end: int) -> None:
            """Wide lines that come before this place have the lines ahead of them; others wait, with lines behind them."""
            n = 0
            for n, (i, line) in enumerate(sights, 1):
                if i >= end:
                    n -= 1
                    break
                wides.append((file, line, plains[i], plains[max(i - behind, 0):i], plains[i + 1:i + 1 + ahead]))
            del sights[:n]
            cut = max((sights[0][0] if sights else len(plains)) - behind, 0)
            sights[:] = [(i - cut, line) for i, line in sights]
            del plains[:cut]

        def ended() -> None:
            close(lexer.end())
            over(set())
            seen_to(len(plains))
            plains.clear()

        def given() -> Iterator[pa.RecordBatch]:
            for names, rows in ((("file", "line_no", "line"), singles), (("file", "line_no", "line", "behind", "ahead"), wides), (("file", "line_no", "code", "level", "end_line"), whole)):
                if rows:
                    columns = dict(zip(names, zip(*rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema], schema=schema)
                    rows.clear()

        for part in batches:
            lines = part.column("lines")
            texts, ends = values(lines.values), values(lines.offsets)
            for i, (name, no) in enumerate(zip(values(part.column("file")), values(part.column("line_no")))):
                if lexer is None or name != file:
                    if lexer:
                        ended()
                    lexer, file, at = Lexer(seen), name, None
                for no, text in enumerate(texts[ends[i]:ends[i + 1]], no):  # noqa: PLW2901
                    level = len(lexer.stack)
                    code, statement, closed = lexer.line(no, text or "")
                    plain, pick, sign = told.get(code) or tell(code)
                    if pick == 1:
                        singles.append((file, no, plain))
                    elif pick:
                        sights.append((len(plains), no))
                    plains.append(plain)
                    if statement != at:
                        at, codes, known, above = statement, [code], None, level
                    else:
                        codes.append(code)
                    if known:
                        known[1] = no
                    if sign:
                        if known is None:
                            known = held.setdefault(statement, [above, no, codes, None, 0, True])
                        known[5] = True
                    if closed:
                        close(closed)
                        known = known or held.get(statement)
            if lexer:
                over({lexer.statement, *(e[4] for e in lexer.stack)})
                seen_to(len(plains) - ahead)
            yield from given()
        if lexer:
            ended()
            yield from given()

    return dealt(blocks.select("file", F.col("line_no").cast("int").alias("line_no"), "lines"), "line_no").mapInArrow(read, _PICKED)


def statements(found: DataFrame) -> DataFrame:
    """(file, line_no, last, line, code, level, end_line) of `lexed`: lines with those that go on from them, as one text each.

    A line goes on while a round or square bracket, an object, a comment or a template is open, behind an operator, and before a dot. end_line:
    where the outermost block closes that the statement opens, or else its last line. A statement's lines stand together, so they are joined
    as they are read, without a shuffle."""
    return found.where("end_line is not null").select("file", "line_no", F.col("last_line").alias("last"), "line", "code", "level", "end_line")


def intervals(found: DataFrame) -> DataFrame:
    """(file, statement, bracket, owner, block, depth, first, last, first_line, last_line): the pairs of `lexed`."""
    return found.where("block is not null").select("file", "statement", "bracket", "owner", "block", "depth", "first", "last", "first_line", "last_line")


def plain(code: Column) -> Column:
    """The text of a piece of code, without its comments."""
    return F.translate(F.regexp_replace(code, MARK, ""), SHADOWS, _ASCII)


def hidden(text: str) -> str:
    """A string's characters as they stand in code."""
    return text.translate(_HIDE)


def on_lines(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file, line_no, …) with every one of spans (file, start_line, end_line, …) that holds the line, however spans lie.

    Both are joined by blocks of lines, so a line meets only spans that reach into its block, not all of its file; a span is sent once for
    each block it reaches into."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    cut = spans.where("start_line <= end_line").withColumn("_block", F.explode(F.sequence(block("start_line"), block("end_line"))))
    return points.withColumn("_block", block("line_no")).join(cut, ["file", "_block"]).where("line_no between start_line and end_line").drop("_block")


def around(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, at, depth, and the columns of the span): each distinct (file, at) of points with every one of spans (file, depth, first, last, …) around it.

    Spans are nested; those of one depth in a file are apart. So for each depth only the last that starts at the point or before can be
    around it: points are sent once for each depth of their file, and no point meets all spans of its file."""
    rest = [f for f in spans.schema.fields if f.name not in ("file", "depth")]
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rest) + ">"
    depths = spans.groupBy("file").agg(F.array_sort(F.collect_set("depth")).alias("_depths"))  # as many as the file nests deep
    asked = points.select("file", "at").distinct().join(depths, "file").select("file", "at", F.explode("_depths").alias("depth"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_span"))
    known = spans.select("file", F.col("first").alias("at"), "depth", F.lit(0).alias("_kind"), F.struct(*(f.name for f in rest)).alias("_span"))
    before = Window.partitionBy("file", "depth").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = asked.unionByName(known).withColumn("_span", F.last("_span", ignorenulls=True).over(before)).where("_kind = 1 and _span.last >= at")
    return held.select("file", "at", "depth", "_span.*")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file, at, …) with the columns of the innermost of spans (file, depth, first, last, …) around each, null where there is none: the deepest of `around`.

    Columns of spans must not be named as those of points are, but for file."""
    rest = [c for c in spans.columns if c not in ("file", "depth")]
    best = around(points, spans).groupBy("file", "at").agg(F.max_by(F.struct(*rest), "depth").alias("_span"), F.max("depth").alias("depth"))
    return points.join(best, ["file", "at"], "left").select(*points.columns, "depth", *(f"_span.{c}" for c in rest))


def nodes_at(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (file, line_no, …) with the innermost bracket pair of `intervals` that covers some of the line: node_bracket, node_owner, node_block, node_first, node_last, node_statement.

    The one of the greatest start on the line, of equal starts the least end; where none starts there, the innermost around its beginning."""
    line = F.col("line_no").cast("long") * LINE
    parts = ("bracket", "owner", "block", "first", "last", "statement")
    carried = F.struct(*parts)
    begun = found.groupBy("file", F.col("first_line").alias("line_no")).agg(F.max_by(carried, F.struct("first", -F.col("last"))).alias("_node"))
    asked = points.join(begun, ["file", "line_no"], "left")
    # Only pairs over several lines are around a line on which none starts.
    spans = found.where("last_line > first_line").select("file", "depth", "first", "last", carried.alias("_held"))
    inner = innermost(asked.where("_node is null").drop("_node").withColumn("at", line), spans)
    named = lambda rows, node: rows.select(*points.columns, *(F.col(f"{node}.{c}").alias(f"node_{c}") for c in parts))
    return named(asked.where("_node is not null"), "_node").unionByName(named(inner, "_held"))
