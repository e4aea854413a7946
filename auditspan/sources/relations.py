"""Audit relations derived from the given tables, so that every query has inputs that grow with them.

A user's events are findings about the document of that number; line items are static-analysis hits; events are calls and lines of code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Checklist items by event type; sign-ups have none.
ITEMS = {"error": "C01", "click": "KD05", "view": "KL12", "purchase": "A07"}
RUNS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(number) -> F.Column:
    return F.concat(F.lit("u"), number.cast("string"))


def _chosen(by, values: dict, default=None):
    out = default if isinstance(default, F.Column) else F.lit(default)
    for key, value in reversed(values.items()):
        out = F.when(by == key, value).otherwise(out)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text)"""
    return table(spark, sf_dir, "documents").select(_file(F.col("doc_id")).alias("file"), "text")


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each run, before they are merged: a chunk is half a file. Their vectors are dealt in turn from all query vectors; vec_ids run from 0 without gaps."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.get_json_object("props", "$.k").cast("int") % 12
    asked = vectors(spark, sf_dir)[1].agg(F.nullif(F.count(F.lit(1)), F.lit(0))).scalar()
    joined = e.join(d, e["user_id"] == d["doc_id"]).withColumn("nth", F.col("event_id") % asked)
    return joined.select(
        F.col("event_id").alias("pos"), _file(F.col("user_id")).alias("file"), (F.col("user_id") * 2 + F.floor(F.col("event_id") / 3) % 2).alias("chunk_id"),
        (F.col("event_id") % RUNS).cast("int").alias("run_idx"), _chosen(F.col("event_type"), ITEMS).alias("checklist_item"),
        _chosen(F.col("event_id") % 5, {0: "critical", 1: "high", 2: "medium"}, "low").alias("severity"),
        k.alias("line_start"), (k + F.col("event_id") % 5).cast("int").alias("line_end"), (F.col("event_id") % 97 == 0).alias("parse_error"),
        F.when(F.col("event_id") % 5 == 0, "evidence that is not in the text").otherwise(F.substring("text", (1 + F.col("event_id") * 37 % F.greatest(F.lit(1), F.char_length("text"))).cast("int"), F.lit(40))).alias("evidence"),
        F.substring("text", (1 + F.floor(F.col("event_id") / 7) * 61 % F.greatest(F.lit(1), F.char_length("text"))).cast("int"), F.lit(80)).alias("finding"), (F.col("nth") + F.floor(F.col("nth") / 9) + 1).alias("vec_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, run_idx): each chunk's runs, those without findings too."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 2 + F.floor(F.col("event_id") / 3) % 2).alias("chunk_id")).distinct()
    return e.select("chunk_id", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run_idx"))


def sast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static-analysis hits: every line item is one; twenty orders in a row are of one file."""
    users = table(spark, sf_dir, "events").agg(F.max("user_id") + 1).scalar()
    rows = table(spark, sf_dir, "lineitem").withColumn("users", users)
    start = (F.col("l_linenumber") * 3).cast("int")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sast_pos"), _file(F.floor(F.col("l_orderkey") / 20) % F.col("users")).alias("file"),
        F.concat(F.lit("rule-"), "l_returnflag", "l_linestatus").alias("rule_id"), start.alias("line_start"), (start + F.col("l_quantity").cast("int") % 4).alias("line_end"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sections, queries), each (vec_id, embedding)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee, arg_index, arg, pos): a user calls another with one argument."""
    e = table(spark, sf_dir, "events")
    users = e.agg(F.max("user_id") + 1).scalar()
    arg = _chosen(F.col("event_type"), {"click": "crypto.getRandomValues(x)", "view": "await deriveKey(k)", "purchase": "'fixed'", "error": "42"}, "param")
    return e.withColumn("users", users).select(
        F.col("user_id").alias("caller"), ((F.col("user_id") * 7 + F.col("event_id") % 3) % F.col("users")).alias("callee"), (F.col("event_id") % 2).cast("int").alias("arg_index"), arg.alias("arg"), F.col("event_id").alias("pos"),
    )


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line): a user's events in order as lines of a source file."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    name = k.cast("string")
    click = _chosen(k % 3, {0: "  const iv = crypto.getRandomValues(new Uint8Array(12));", 1: "  const salt = await hkdf(key, 'ctx');"}, "  const count = 42;")
    defined = F.first(F.when(F.col("event_type") == "signup", k), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id"))
    called = F.when(k % 2 == 0, F.coalesce(defined, k)).otherwise(k - 2)
    line = (
        F.when(k % 11 == 0, F.concat(F.lit("import { f"), F.greatest(k - 1, F.lit(0)).cast("string"), F.lit(" } from './u"), (F.col("user_id") + 1).cast("string"), F.lit("';")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("export async function f"), name, F.lit("(key, iv, data) {")))
        .when(F.col("event_type") == "click", click)
        .when(F.col("event_type") == "view", F.lit("  const out = await crypto.subtle.encrypt({ name: 'AES-GCM', iv: iv }, key, data);"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("  const k2 = await crypto.subtle.deriveKey({ name: 'HKDF', salt: salt }, f"), called.cast("string"), F.lit("(key, 'fixed', data));")))
        .otherwise(F.lit("}"))
    )


    return e.select(_file(F.col("user_id")).alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line_no"), line.alias("line"))


def module_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line): a user's events in order as statements of a module, four lines each, with imports under other names, methods, and lists and calls over several lines.

    Sign-ups and purchases open a function, or a class with a method, that last to the next of them; the first line of other events has brackets
    and quotes in comments, templates and regular expressions."""
    e = table(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts))
    order = Window.partitionBy("user_id").orderBy("event_id")
    opened = F.last(F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    odd = _chosen(k % 4, {0: "// see the notes :(", 1: "/* it's { open */", 2: "  const open = /[({]'\\/\"/g;"}, "  const note = `a ${k} ({'` + '// [';")
    first = F.when(~F.col("event_type").isin("signup", "purchase"), odd).otherwise(_chosen(opened, {"signup": "}", "purchase": "}}"}, ""))
    lines = _chosen(F.col("event_type"), {
        "click": F.array(text("import def", k, ", { a", k % 7, " as r", k % 5, ", b", k % 3, " } from './m", u + 1, "';"), F.lit("import * as ns from 'package';"), F.lit("import './effects';")),
        "signup": F.array(text("export const f", k % 50, " = async ("), F.lit("  key: CryptoKey, iv = mix(1, 'a,(b'),"), F.lit(") => {")),
        "view": F.array(text("  await r", k % 5, "(wrap(iv, 'a,b'), [1, 2],"), F.lit("    { n: data });"), F.lit("  // }")),
        "purchase": F.array(text("export class K", k, " {"), F.lit("  static async seal(key, data) {"), F.lit("    return key;")),
    }, F.array(text("export { x", k, ", y as z", k, " } from './m0';"), text("export const c", k, " = ", k % 20, ";"), F.lit("jwt.decode(token, options);")))
    each = e.select(F.concat(F.lit("m"), u.cast("string")).alias("file"), F.row_number().over(order).alias("_place"), F.concat(F.array(first), lines).alias("_lines"))
    return each.select("file", "_place", F.posexplode("_lines").alias("_i", "line")).select("file", (F.col("_place") * 4 - 3 + F.col("_i")).alias("line_no"), "line")


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line) of `nested_blocks`."""
    each = nested_blocks(spark, sf_dir).withColumnRenamed("line_no", "_first")
    return each.select("file", "_first", F.posexplode("lines").alias("_i", "line")).select("file", (F.col("_first") + F.col("_i")).alias("line_no"), "line")


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, lines), lines from line_no on: a user's events in order, ten lines each, as functions with one inside the other, loops, and the same names in all of them.

    Sign-ups pass the vector on as a parameter, clicks draw it, views derive it in a loop with an encryption after the loop too, purchases fix it
    in the inner function; others have all of it in comments and strings."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id").cast("string")
    text = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    call = "crypto.subtle.encrypt({ name: 'AES-GCM', iv: iv }, key, data);"
    body = lambda *lines: F.array(text("export function f", k, "(", lines[0], ") {"), *(p if isinstance(p, F.Column) else F.lit(p) for p in lines[1:]), F.lit("}"))
    lines = _chosen(F.col("event_type"), {
        "signup": body("key, iv, data", "  // const iv = 'not this one';", "  function inner(data) {", "    const iv = 42;", "    return data;", "  }", "  const t = `${iv} { (`;", "  await " + call, "  return t;"),
        "click": body("key, data", "  const iv = crypto.getRandomValues(new Uint8Array(12));", "  if (data) {", "    /* } */ await " + call, "  }", "  const p = /[)}]/;", "  return iv;", "", ""),
        "view": body("key, data", "  for (const part of data) {", "    const iv = await hkdf(key, '}');", "    await " + call, "  }", "  const iv = 7;", "  await " + call, "", ""),
        "purchase": body("key, iv", "  function seal(data) {", "    const iv = 'fixed';", "    await " + call, "  }", "  return seal;", "", "", ""),
    }, body("key, iv, data", "  /* for (;;) {", "  await " + call, "  } */", '  const s = "await crypto.subtle.encrypt({ iv: iv }, key)";', "  return s;", "", "", ""))
    each = e.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("_place"), lines.alias("lines"))
    return each.select("file", (F.col("_place") * 10 - 9).alias("line_no"), "lines")
