"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Everything is one narrow projection of DataFrame functions: no shuffle and no Python, so it follows the scan.
Offsets count code points, ends are exclusive. A null text is empty. Overlaps between kinds are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

SPAN = "array<struct<start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """pattern: a Java regex that finds the same matches as `plain`, in time linear in the text. sign: characters any match has."""

    name: str
    pattern: str
    sign: str
    score: float
    words: str
    confirm: Callable[[Column], Column]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; the doubled ones are every second from the right."""
    ones = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d: d.cast("int"))
    doubled = F.transform(ones, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number with its country and check digits passes ISO 7064 mod 97-10."""
    compact = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _octets(match: Column) -> Column:
    bare = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def _ssn(match: Column) -> Column:
    return ~match.rlike("^(000|666|9..)|-00-|-0000$")


#: In the order the results list them; the first four are the contract's base kinds, which stay whatever their score.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|kontakt|correo|courriel", lambda m: F.lit(True)),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ".", 0.6, r"\bip\b|addr|host|server|login", _octets),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+", "", 0.7, "card|visa|master|credit|karte|carte|tarjeta", lambda m: (F.char_length(_digits(m)) <= 19) & luhn(_digits(m))),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, r"phone|call|\btel|mobile|fax", lambda m: F.char_length(_digits(m)).between(9, 15)),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto|compte|cuenta", mod97),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social|security|taxpayer", _ssn),
)
BASE = KINDS[:4]
#: Added spans need this score; an ssn-like number reaches it only by a context word.
LEAST_SCORE = 0.5
CONTEXT, BONUS = 40, 0.2
#: Offsets are added up in runs of so many matches.
RUN = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, kind: Kind) -> Column:
    """The confirmed, non-overlapping matches of one kind, leftmost first, with their scores.

    A regex split gives the gaps between the matches and regexp_extract_all the matches; adding lengths up gives the offsets. Lengths are
    added up in runs of RUN matches and then over the runs, and contexts are put together from the ends of nearby gaps, so the work is
    linear in the text, however many matches it has."""
    none = F.array().cast(SPAN)

    def pieces(found: Column) -> Column:
        piece = lambda g, m: F.struct(F.left(g, F.lit(CONTEXT // 2)).alias("head"), F.right(g, F.lit(CONTEXT)).alias("tail"), m.alias("match"), F.char_length(g).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("size"))
        return F.zip_with(F.split(text, kind.pattern, -1), found, piece)

    def judged(steps: Column) -> Column:
        """(gap, size, score) of each step; score is null if there is no match or it isn't confirmed."""

        def judge(x: Column, i: Column) -> Column:
            # A match has five characters at least, so eight steps before and four after hold the context.
            past = F.transform(F.slice(steps, F.greatest(F.lit(1), i - 7), F.least(i, F.lit(8))), lambda y: F.concat(y["tail"], y["match"]))
            to_come = F.transform(F.slice(steps, i + 2, F.lit(5)), lambda y: F.concat(y["head"], F.coalesce(y["match"], F.lit(""))))
            before = F.right(F.concat(F.array_join(past, ""), x["tail"]), F.lit(CONTEXT))
            near = F.lower(F.concat(before, F.lit(" "), F.left(F.array_join(to_come, ""), F.lit(CONTEXT // 2))))
            score = F.round(F.when(near.rlike(kind.words), F.least(F.lit(1.0), F.lit(kind.score + BONUS))).otherwise(F.lit(kind.score)), 2)
            return F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.when(x["match"].isNotNull() & kind.confirm(x["match"]), score).alias("score"))

        return F.transform(steps, judge)

    def placed(rated: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rated) - 1) / RUN).cast("int")), lambda k: F.slice(rated, k * RUN + 1, F.lit(RUN)))
        length = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + x["size"])

        def offsets(runs: Column) -> Column:
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
            step = lambda a, run: F.struct((a["at"] + length(run)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
            return F.aggregate(runs, first, step, lambda a: a["all"])

        def within(run: Column, start: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                at = a["at"] + x["gap"]
                span = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["score"].alias("score"))
                return F.struct((at + x["size"]).alias("at"), F.when(x["score"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span))).alias("out"))

            return F.aggregate(run, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

        return _let(runs, lambda r: F.flatten(F.zip_with(r, offsets(r), within)))

    out = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(_let(pieces(found), lambda s: _let(judged(s), placed))))
    if kind not in BASE:
        out = F.filter(out, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(F.contains(text, F.lit(kind.sign)), out).otherwise(none) if kind.sign else out


def _joined(kinds: tuple[Kind, ...], value: Callable[[Kind, Column], Column]) -> Column:
    def of(kind: Kind) -> Column:
        return F.transform(F.col(f"_{kind.name}"), lambda s: value(kind, s))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one column _<kind> of spans for each kind.

    Null and empty texts have no spans; texts of any length are searched whole, in work linear in the text and its matches; of matches that
    start together the longer counts; repeated rows get equal results; an empty table stays empty; extra columns pass, but ones named like a result give way."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return put(docs, **{f"_{k.name}": spans(whole, k) for k in KINDS})


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span that was found replaced by its kind in brackets; of overlapping spans the leftmost, then the longest, counts."""
    found = find_pii(docs, text)

    def named(kind: Kind) -> Column:
        return F.transform(F.col(f"_{kind.name}"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind.name).alias("kind")))

    every = F.array_sort(F.concat(*map(named, KINDS)))
    source = F.col(text)

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(source, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct((-s["back"]).cast("int").alias("at"), F.concat(a["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))).otherwise(a)

    clean = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(source, a["at"] + 1, F.char_length(source))))
    return found.withColumn(text, F.when(source.isNull(), F.lit(None).cast("string")).otherwise(clean)).drop(*(f"_{k.name}" for k in KINDS))


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = find_pii(docs.select("doc_id", "text"))
    place = lambda k, s: F.concat_ws(":", F.lit(k.name), s["start"], s["end"])
    return found.select(
        "doc_id",
        *(F.size(F.col(f"_{k.name}")).cast("long").alias(f"n_{k.name}") for k in KINDS),
        F.sha2(_joined(BASE, place), 256).alias("base_sha256"),
        _joined(KINDS, place).alias("spans"),
        _joined(KINDS, lambda k, s: F.format_string("%.2f", s["score"])).alias("scores"),
    )
