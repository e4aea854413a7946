"""Facts brought up to date, and states of streams, against whole builds."""

import json
import os

import pytest
from pyspark.sql import functions as F

from auditspan.operators import modules, reports
from auditspan.sources import incremental
from auditspan.sources.shared import written
from auditspan.streaming import reports as stream


def modules_of(numbers, change=""):
    return {f"m{i}.ts": f"import {{ f{i + 1} }} from './m{i + 1}';\nexport function f{i}(key, iv) {{\n  return f{i + 1}(key{change}, iv);\n}}" for i in numbers}


def test_refresh_equals_a_whole_build(spark, tmp_path):
    asked = []

    def facts(files):
        asked.append(sorted(r.file for r in files.collect()))
        return modules.graph_facts(files, written)

    def run(texts, path="kept"):
        rows = spark.createDataFrame([(*x, 1) for x in texts.items()] + [(None, "x", 1)], "file string, text string, part int")
        return incremental.refresh(rows, str(tmp_path / path), facts, parts=8)

    def tables(path):
        return {t: sorted(map(str, incremental.table(spark, str(tmp_path / path), t).collect())) for t in ("functions", "exports", "imports", "arguments")}

    texts = modules_of(range(20))
    assert len(run(texts)) == 8 and asked.pop() == sorted(texts)
    assert run(texts) == [] and not asked
    before = {p: os.path.getmtime(tmp_path / "kept/exports" / p) for p in os.listdir(tmp_path / "kept/exports") if p.startswith("part=")}
    texts |= modules_of([3], change=".slice(0)")
    (part,) = run(texts)
    assert asked.pop() == ["m3.ts"]
    after = {p: os.path.getmtime(tmp_path / "kept/exports" / p) for p in before}
    assert [p for p in before if before[p] != after[p]] == [f"part={part}"]
    texts |= {"new.ts": "export const k = 1;", "empty.ts": None}
    gone = [f for f in texts if f.startswith("m1")]
    for f in gone:
        del texts[f]
    run(texts)
    assert asked.pop() == ["empty.ts", "new.ts"]
    run(texts, "anew")
    assert tables("kept") == tables("anew") and "f3(key.slice(0)" not in str(tables("kept")["exports"]) and "key.slice(0)" in str(tables("kept")["arguments"])
    with pytest.raises(ValueError):
        incremental.refresh(spark.createDataFrame([("a.ts", "")], "file string, text string"), str(tmp_path / "kept"), facts, parts=9)
    run({})
    assert not any(tables("kept").values())


def test_a_run_that_was_cut_off_is_done_again(spark, tmp_path):
    texts = modules_of(range(6))
    build = lambda t, path, facts: incremental.refresh(spark.createDataFrame(list(t.items()), "file string, text string"), str(tmp_path / path), facts, parts=4)
    whole = lambda files: modules.graph_facts(files, written)
    build(texts, "kept", whole)

    def broken(files):
        found = whole(files)
        yet = iter(found)

        class Half(dict):
            def items(self):
                yield (name := next(yet)), found[name]
                raise RuntimeError("lost")

        return Half()

    with pytest.raises(RuntimeError):
        build({k: v for k, v in texts.items() if k != "m2.ts"} | modules_of([4], change="2"), "kept", broken)
    build(texts, "kept", whole)  # as it was at first: the half that was written must go
    build(texts, "anew", whole)
    for t in ("functions", "exports", "imports", "arguments"):
        a, b = (sorted(map(str, incremental.table(spark, str(tmp_path / p), t).collect())) for p in ("kept", "anew"))
        assert a == b and a


def test_states_of_streams_equal_the_batch_over_restarts(spark, tmp_path):
    root, at = tmp_path / "in", lambda x: str(tmp_path / x)
    root.mkdir()

    def report(name, time, *items):
        rows = [{"checklist_item": i, "file": f, "severity": s, "line_start": n} for n, (i, f, s) in enumerate(items)]
        (root / "tmp").write_text(json.dumps({"findings": rows}))
        os.rename(root / "tmp", root / name)
        os.utime(root / name, (time, time))

    keys = ("file", "checklist_item")
    for run in range(3):
        report(f"combined_{run}.json", 1000 + run, ("C01", "a.ts", f"s{run}"), ("C02", f"b{run}.ts", "low"), ("C01", "a.ts", "twice"))
        report(f"triaged_{9 - run}.json", 2000 - 700 * run, ("C01", "a.ts", f"t{run}"), ("C03", "a.ts", f"t{run}"))  # those that come later are older
        stream.update(stream.first_arrivals(stream.stream(spark, str(root), 1), *keys), at("first"), at("first-at")).awaitTermination()
        stream.update(reports.latest(stream.report_stream(spark, str(root), 1)), at("last"), at("last-at")).awaitTermination()
        from auditspan.sources import files

        whole = spark.read.option("multiLine", "true").schema(files.FINDINGS).json(str(root))
        whole = whole.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode("findings").alias("pos", "f")).select("name", "arrived", "pos", "f.*")
        got = stream.current(spark, at("first"), *keys)
        want = stream.first_arrivals(whole, *keys)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.where("checklist_item = 'C01'").first().n_arrived == 3 * (run + 1)
        kinds = reports.latest(files.report_names(spark, str(root)).select("name", "n_findings"))
        assert sorted(map(tuple, stream.current(spark, at("last"), "kind").select(kinds.columns).collect())) == sorted(map(tuple, kinds.collect()))
    assert got.where("checklist_item = 'C01'").first().severity == "t2"  # the oldest file came last


def test_small_files_of_many_rows_are_not_broadcast(spark):
    from auditspan.sources.shared import shuffled, written

    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), F.lit("x" * 1000).alias("text"))
    plan = lambda kept: rows.join(kept(rows).groupBy("k").count(), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(written) and "BroadcastHashJoin" not in plan(shuffled)
