"""Queues that lose a batch, objects, stored tables that fail half way, cursors, budgets by turns, batches, cosine joins."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.models import batch as B
from weftline.operators import matching as M, tables as R, vectors as V
from weftline.session import shared_dir
from weftline.sources import objects, stored
from weftline.streaming import queue

# ---- queues


def test_a_batch_lost_between_write_and_commit_is_not_doubled(spark):
    folder, run, lost = shared_dir(spark), shared_dir(spark), []
    queue.enqueue(spark.range(90).repartition(1), folder, batch_rows=30)

    def work(rows):
        return rows.withColumn("error", F.when((F.col("id") % 10 == 0) & (F.col("attempt") < 2), "not yet").when(F.col("id") == 7, "never"))

    plain = queue.attempted

    class Written:
        """A batch whose rows are written, but whose end is not noted."""

        def __init__(self, df):
            self.df = df

        @property
        def write(self):
            return self

        def mode(self, how):
            self.how = how
            return self

        def parquet(self, path):
            self.df.write.mode(self.how).parquet(path)
            if not lost and path.endswith("000000001"):
                lost.append(path)
                raise RuntimeError("lost after the write")

    queue.attempted = lambda *a: Written(plain(*a))
    try:
        with pytest.raises(Exception, match="lost after the write"):
            queue.drain_queue(spark, folder, "id", work, run)
        assert lost and queue.outcome(spark, run, "id").count() == 60
        queue.drain_queue(spark, folder, "id", work, run, retry=False)
    finally:
        queue.attempted = plain
    results = spark.read.parquet(f"{run}/results")
    assert results.count() == 90 and results.select("turn").distinct().count() == 3
    assert tuple(queue.tallies(queue.outcome(spark, run, "id")).first()) == (90, 80, 10)
    queue.enqueue(spark.range(90, 95), folder)
    queue.drain_queue(spark, folder, "id", work, run)
    found = {r["id"]: (r["status"], r["attempt"]) for r in queue.outcome(spark, run, "id").collect()}
    assert len(found) == 95 and found[10] == ("success", 2) and found[7] == ("failed", 2) and found[90] == ("failed", 1) and found[91] == ("success", 1)
    queue.drain_queue(spark, folder, "id", work, run, attempts=2)
    assert {r["id"]: r["attempt"] for r in queue.outcome(spark, run, "id").filter("id IN (7, 90)").collect()} == {7: 2, 90: 2}


def test_one_row_that_raises(spark):
    work = queue.tried(lambda x: 10 // x, "share", "int")
    found = work(spark.createDataFrame([(0,), (5,)], "n int"), "n").collect()
    assert {(r["n"], r["share"], (r["error"] or "")[:17]) for r in found} == {(0, None, "ZeroDivisionError"), (5, 2, "")}


# ---- objects


def test_objects(spark, tmp_path):
    rows = [("a/b/one.txt", "é\n" * 3), ("a/two.html", ""), ("", "x"), (None, "x"), ("a/none.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {(r["path"], r["n_bytes"], r["stored"]) for r in objects.put_texts(df, f"{tmp_path}/store").collect()}
    assert got == {("a/b/one.txt", 9, True), ("a/two.html", 0, True), ("", 0, False), (None, 0, False), ("a/none.txt", 0, False)}
    (tmp_path / "store/a/bad.txt").write_bytes(b"ok \xff end")
    (tmp_path / "store/a/large.txt").write_bytes(b"x" * 100)
    wanted = spark.createDataFrame([("a/b/one.txt",), ("a/bad.txt",), ("a/gone.txt",), ("a/large.txt",)], "path string")
    back = objects.get_texts(spark, f"{tmp_path}/store", wanted, "*.txt", most_bytes=50)
    assert {tuple(r) for r in back.collect()} == {("a/b/one.txt", "é\n" * 3), ("a/bad.txt", "ok � end")}
    plan = objects.get_texts(spark, f"{tmp_path}/store", pattern="*.txt", most_bytes=50)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)" in plan
    assert {tuple(r) for r in objects.listed(spark, f"{tmp_path}/store", "*.txt").collect()} == {("a/b/one.txt", 9), ("a/bad.txt", 8), ("a/large.txt", 100)}


def test_wanted_objects_are_looked_up_not_listed(spark, tmp_path):
    folder = f"{tmp_path}/store"
    (tmp_path / "store/a").mkdir(parents=True)
    for name in ("a/one.txt", "a/two.txt", "a/.hid.txt", "a/_hid.txt", "a/x.html"):
        (tmp_path / "store" / name).write_text(name)
    (tmp_path / "out.txt").write_text("outside")
    wanted = spark.createDataFrame([(x,) for x in ("a/one.txt", "a/one.txt", "a/.hid.txt", "a/_hid.txt", "a/x.html", "a", "", None, "/a/two.txt", "a//two.txt", "../out.txt", "a/gone.txt")], "path string")
    for found in (objects.get_texts(spark, folder, wanted, "*.txt").withColumnRenamed("text", "x"), objects.listed(spark, folder, "*.t[wx]t", wanted).withColumnRenamed("n_bytes", "x")):
        assert "binaryFile" not in found._jdf.queryExecution().toString()
        assert [(r["path"], r["x"]) for r in found.collect()] in ([("a/one.txt", "a/one.txt")], [("a/one.txt", 9)])


def test_types(spark):
    rows = [("x/report.PDF", None, None, "pdf"), ("x.y/report", "application/msword", None, "docx"), (".profile", None, b"%PDF-1.7", "pdf"), (None, None, b"<html>", "html"), ("x", "image/png", b"\x89PNG", "unknown"), ("x", None, None, "unknown"), ("a.txt", "application/pdf", b"%PDF", "txt")]
    df = spark.createDataFrame(rows, "path string, mime string, content binary, want string")
    assert [r for r in df.withColumn("got", objects.detected_type(F.col("path"), F.col("mime"), F.col("content"))).collect() if r["got"] != r["want"]] == []


# ---- stored tables


def test_changes_leave_other_partitions_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    files = lambda part: sorted(p.name for p in (tmp_path / f"t/part={part}").glob("*.parquet"))
    stored.store(spark.range(30).select("id", F.lit("old").alias("v"), (F.col("id") % 3).alias("part")), path, ["part"])
    before = {p: files(p) for p in range(3)}
    new = spark.createDataFrame([(1, "new", 1), (100, "new", 1)], "id bigint, v string, part bigint")

    def upsert(rows, changes):
        return rows.join(changes, "id", "left_anti").unionByName(changes)

    touched = stored.change(spark, path, ["part"], new, upsert)
    assert [r["part"] for r in touched.collect()] == [1] and files(0) == before[0] and files(2) == before[2] and files(1) != before[1]
    assert Counter(r["v"] for r in spark.read.parquet(path).collect()) == {"old": 29, "new": 2}
    with pytest.raises(Exception, match="broken"):
        stored.change(spark, path, ["part"], new, lambda rows, changes: rows.withColumn("v", F.raise_error(F.lit("broken")).cast("string")))
    assert spark.read.parquet(path).count() == 31
    assert stored.drop_partitions(spark, path, touched) == 1 and spark.read.parquet(path).count() == 20


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(ValueError):
        stored.current(spark, path)
    stored.swap(spark.range(5), path)
    stored.swap(stored.current(spark, path).filter("id > 0"), path)
    assert stored.current(spark, path).count() == 4
    with pytest.raises(Exception, match="half way"):
        stored.swap(spark.range(8).repartition(4).withColumn("id", F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("half way")))), path)
    assert sorted(r["id"] for r in stored.current(spark, path).collect()) == [1, 2, 3, 4]
    stored.swap(spark.range(2), path)
    assert stored.current(spark, path).count() == 2 and len(list(tmp_path.glob("t/version-*"))) == 2


# ---- cursors


def test_pages_with_ties(spark, tmp_path):
    rows = [(i % 4, i) for i in range(57)]
    df = R.sorted_files(spark.createDataFrame(rows, "k int, id bigint"), ["k", "id"], f"{tmp_path}/t", 5)
    pages = list(R.pages(df, ["k", "id"], 10))
    assert [tuple(r) for page in pages for r in page] == sorted(rows) and [len(p) for p in pages] == [10, 10, 10, 10, 10, 7]
    plan = R.page_after(df, ["k", "id"], (2, 9), 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,2)" in plan and "TakeOrderedAndProject" in plan
    assert list(R.pages(df.limit(0), ["k", "id"], 10)) == []


def test_pages_are_numbered_without_a_job_for_each(spark, tmp_path):
    rows = [(i % 4, i) for i in range(570)]
    df = R.sorted_files(spark.createDataFrame(rows, "k int, id bigint"), ["k", "id"], f"{tmp_path}/t", 5)
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        got = run()
        spark.sparkContext._jsc.clearJobGroup()
        return got, len(tracker.getJobIdsForGroup(name))

    want = {(k, i): at // 10 for at, (k, i) in enumerate(sorted(rows))}
    got, n_jobs = jobs("numbered", lambda: R.numbered_pages(df, ["k", "id"], 10).collect())
    assert {(r["k"], r["id"]): r["page"] for r in got} == want and n_jobs < 20
    got, n_jobs = jobs("cursor", lambda: list(R.pages(df, ["k", "id"], 10)))
    assert [len(p) for p in got] == [10] * 57 and [tuple(r) for p in got for r in p] == sorted(rows) and n_jobs < 20
    assert list(map(len, R.pages(df, ["k", "id"], 57, ahead=2))) == [57] * 10
    assert R.numbered_pages(df.limit(570).filter("k > 9"), ["k", "id"], 10).count() == 0


# ---- contents by turns


def by_turns(sources, limit):
    used, out, turn, grew = 0, [], 0, True
    while grew:
        grew = False
        for name in sorted(sources):
            if turn < len(sources[name]):
                item = (sources[name][turn] or "").strip(" ")
                cost = len(json.dumps(item, ensure_ascii=False)) + 1
                if item and used + cost <= limit:
                    out.append((name, turn, item))
                    used, grew = used + cost, True
        turn += 1
    return out


def test_contents_by_turns(spark):
    rng = random.Random(3)
    owners = {o: {s: [rng.choice([None, "", "  ", 'a "quoted"\n', "é" * rng.randint(1, 30), "x" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 12))] for s in "pqr"} for o in range(30)}
    owners[99] = {"p": ["", "late"], "q": []}  # a turn that adds nothing is the last
    rows = [(o, s, i, t) for o, by in owners.items() for s, texts in by.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "owner bigint, source string, pos int, text string")
    got = {}
    for r in R.by_turns(df, ["owner"], "source", ["pos"], "text", 120).orderBy("place").collect():
        got.setdefault(r["owner"], []).append((r["source"], r["turn"], r["text"]))
    assert {o: got.get(o, []) for o in owners} == {o: by_turns(by, 120) for o, by in owners.items()}


# ---- scalars


def first_object(text):
    at = text.find("{")
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0] if at >= 0 else None
    except ValueError:
        return None


def test_first_json_object(spark):
    texts = ['{"a":1} and {"b":2}', 'x {"a": "}{\\"", "b": {"c": []}} }', '```json\n{"a": 1}\n```', "none", '{"a": {"b": 1}', "{not json}", '{"a": "\\\\"} "}', "", '{}{"a":1}', '{"a": "' + "x\\n" * 20_000 + '"} tail', 'say "{" then {"a":1}']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", T.json_object(F.col("t")).alias("o")).collect()
    for r in got:
        want = first_object(r["t"])
        assert (r["o"] == r["t"]) if want is None else json.loads(r["o"]) == want, r["t"][:60]
    assert spark.range(1).select(T.json_object(F.lit(None).cast("string")).alias("o")).first()["o"] is None


def test_latency_of_skewed_values(spark):
    rng = random.Random(9)
    groups = {"flat": [round(rng.random() * 1000, 3) for _ in range(20_001)], "hot": [5.0] * 9000 + [1e9, -1e9], "one": [3.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    got = {r["g"]: r for r in R.latency(df, "g", "v").collect()}
    for g, vs in groups.items():
        vs = sorted(vs)
        assert got[g]["median"] == pytest.approx((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2) and got[g]["p95"] == vs[-(-95 * len(vs) // 100) - 1] and got[g]["n"] == len(vs)
    assert got["none"]["n"] == 0 and got["none"]["p95"] is None


# ---- batches


def test_batch_statuses_and_invariants(spark):
    targets = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5, None)], "id bigint")
    entities = spark.range(5).withColumn("name", F.lit("n"))

    def score(rows):
        return rows.select("id", F.array(F.lit(0)).alias("covered"), F.when(F.col("id") == 2, F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("missing"), F.when(F.col("id") == 3, "no answer").alias("error"))

    rule = {"once": B.in_one_of(F.array(F.lit(0), F.lit(1)), F.col("covered"), F.col("missing"))}
    rows, tallies = B.batch(targets, entities, spark.range(4, 5), "id", score, invariants=rule)
    assert {(r["id"], r["status"], r["error"], r["covered"] and tuple(r["covered"])) for r in rows.collect()} == {(1, "processed", None, (0,)), (2, "failed", "breaks once", None), (3, "failed", "no answer", None), (4, "skipped_existing", None, None), (5, "missing", None, None)}
    assert tallies == {"processed": 1, "skipped_existing": 1, "missing": 1, "failed": 2, "once": 1}
    forced, tallies = B.batch(targets, entities, spark.range(4, 5), "id", score, force=True)
    assert tallies == {"processed": 3, "skipped_existing": 0, "missing": 1, "failed": 1}


# ---- incremental rebuild


def test_only_changed_people_are_scored_again(spark):
    before = spark.createDataFrame([(p, i, p * i) for p in range(1, 9) for i in range(3)], "person bigint, idx int, w bigint")
    after = before.filter("person <> 8").withColumn("w", F.when((F.col("person") == 2) & (F.col("idx") == 1), 100).otherwise(F.col("w")))
    after = after.unionByName(spark.createDataFrame([(9, 0, 1)], after.schema)).unionByName(before.filter("person = 5 AND idx = 0"))
    scored = []

    def build(rows):
        scored.extend(r["person"] for r in rows.select("person").distinct().collect())
        return rows.groupBy("person").agg(F.sum("w").alias("total"), F.count("*").alias("n"))

    whole = {tuple(r) for r in build(after).collect()}
    scored.clear()
    got = M.rebuilt(build(before), before, after, "person", ["idx", "w"], build)
    scored = scored[8:]  # without the stored table's own
    assert {tuple(r) for r in got.collect()} == whole and sorted(scored) == [2, 5, 9]


# ---- cosine joins


@pytest.mark.parametrize("block", [4, 512])
def test_pairs_over_a_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "TILE", 2)
    rng = np.random.default_rng(4)
    tops = rng.normal(size=(5, 8))
    rows = [(g, int(i), [float(x) for x in tops[rng.integers(5)] + rng.normal(size=8) * 0.3]) for g in ("a", "b") for i in range(60)]
    rows += [("a", 100 + i, rows[0][2]) for i in range(20)] + [("b", 200, [1.0, 0.0]), ("b", 201, [2.0, 0.0]), ("b", 202, None), ("b", 203, [0.0] * 8), ("b", 204, []), ("c", 1, [1.0] * 8)]
    df = spark.createDataFrame(rows, "g string, id bigint, v array<double>")
    want = set()
    for g, i, x in rows:
        for h, j, y in rows:
            if g == h and i < j and x and y and len(x) == len(y) and any(x) and any(y):
                cosine = np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
                if round(cosine, 6) >= 0.9:
                    want.add((g, i, j))
    got = [(r["g"], r["a"], r["b"]) for r in V.pairs_over(df, "id", "v", 0.9, ["g"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    linked = {(r["a"], r["b"]) for r in V.links_over(df.filter("g = 'a'"), "id", "v", 0.9, ["g"]).collect()}
    assert linked <= {(i, j) for g, i, j in want if g == "a"} and {(0, 100 + i) for i in range(20)} <= linked and len(linked) < len([1 for g, *_ in want if g == "a"])
