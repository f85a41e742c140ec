"""Operators on small tables with known results."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.classify import environment_at_fault, missing_dependencies, parses_tests, remedy
from ledgerline.functions.columns import bucket, length_prefixed, nearest_rank, normalized_span, plain_text
from ledgerline.functions.globs import to_regex
from ledgerline.operators.closure import closure, settled_closure
from ledgerline.operators import drain as drains
from ledgerline.operators.drain import drain
from ledgerline.operators.folds import edges, health_fold
from ledgerline.operators.logs import classified, compiler_messages, progress, scraped, summed_tests
from ledgerline.operators.matching import bag_sides, longest_prefix
from ledgerline.operators.paging import budget_prefix, page, where_given
from ledgerline.operators.rollup import fold
from ledgerline.plans.fleet import overview_document
from ledgerline.plans.governance import path_dependencies, settings
from ledgerline.plans.logs import HINTS, cut_bytes, elide, hinted, packed
from ledgerline.plans.paths import entries, is_internal, laid_out
from ledgerline.plans.placement import demand, drained, explained, picked
from ledgerline.plans.registry import QUERIES
from ledgerline.plans.sets import lossy_text, stable_scan
from ledgerline.plans.windows import failures, fleet_alerts, raised_once, silences
from ledgerline.operators.leases import granted
from ledgerline.sources.stores import append, fetch_blobs, held, insert_absent, listed_files, put, store_blobs


#: Small logs to run the parsers on.
LOGS = {
    1: "Compiling foo v0.1.0\n   Checking bar v1.2.3\nFresh baz v1.0.0\nerror: could not compile `bar`\nsrc/main.rs:7:5: error: mismatched types\nlib.c:3: warning: unused variable",
    2: "running 12 tests\ntest result: FAILED. 10 passed; 0 failed; 1 ignored; 0 measured\n     Running tests/it.rs (target/debug/deps/it-1234)\nfailures:\n    it::one\n    it::two\n\ntest result: FAILED. 3 passed; 2 failed; 0 ignored",
    3: "Package libssh2 was not found in the pkg-config search path\n/usr/bin/ld: cannot find -lz\nopenssl/ssl.h: No such file or directory\nbash: cmake: command not found\n{\"message\": \"No package 'json' found\"}",
    4: "The pkg-config command could not be found\nNo package 'dbus-1' found\nCould not find librrd",
    5: "thread main panicked (signal: 9, SIGKILL: kill)",
    6: "write: No space left on device",
    7: "error: linker `cc` not found",
    8: "Could not find librrd\nfailed to run custom build command for `rrd-sys v0.1`",
}


def small_logs(spark):
    return spark.createDataFrame([(k, n, line) for k, text in LOGS.items() for n, line in enumerate(text.split("\n"), 1)], "log_id long, line_no int, line string")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(("at", "width", "want"), [(125, 60, 120), (3599, 3600, 0), (3600, 3600, 3600), (-1, 60, -60)])
def test_bucket(spark, at, width, want):
    assert one(spark, bucket(F.lit(at), width)) == want


@pytest.mark.parametrize(("values", "share", "want"), [([1, 2, 3, 4], 0.5, 3), ([5], 0.95, 5), ([1, 2], 0.5, 2)])
def test_nearest_rank(spark, values, share, want):
    assert one(spark, nearest_rank(F.array(*map(F.lit, values)), share)) == want


def test_spans_are_normalized(spark):
    assert one(spark, normalized_span(F.lit("mismatched types at src/lib.rs:10:5 expected [u8; 32]"))) == "mismatched types at expected [u8; 32]"


def test_lengths_keep_fields_apart(spark):
    assert one(spark, length_prefixed(F.lit("ab"), F.lit("c")) == length_prefixed(F.lit("a"), F.lit("bc"))) is False


@pytest.mark.parametrize(("line", "want"), [("\x1b[31mred\x1b[0m", "red"), ("abc\x1b", "abc"), ("abc\x1b[31", "abc"), ("\x1b]8;;x\x1b\\link", "link")])
def test_escapes_go(spark, line, want):
    assert one(spark, plain_text(F.col("x")), x=line) == want


def test_rollup_points_add_up(spark):
    points = spark.createDataFrame([("tasks", 60, 2.0, 2), ("tasks", 60, 3.0, 1)], "metric string, bucket long, sum double, count long")
    assert [tuple(r) for r in fold(points, 60).collect()] == [("tasks", 60, 5.0, 3)]
    assert [tuple(r) for r in fold(points, 3600).collect()] == [("tasks", 0, 5.0, 3)]


def sequential(rows):
    streak, last, out = 0, None, []
    for ok, counted, origin in rows:
        if ok:
            streak, last = 0, None
        elif counted and origin != last:
            streak, last = streak + 1, origin
        elif counted:
            last = origin
        out.append(streak)
    return out


def test_health_fold_equals_the_sequential_one(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.random() < 0.2, rng.random() < 0.7, rng.choice("abc")) for k in range(8) for n in range(50)]
    df = spark.createDataFrame(rows, "key int, n int, ok boolean, counted boolean, origin string")
    got = health_fold(df, "key", ["n"], F.col("ok"), ~F.col("ok") & F.col("counted"), F.col("origin")).orderBy("key", "n").collect()
    want = [s for k in range(8) for s in sequential([r[2:] for r in rows if r[0] == k])]
    assert [r["streak"] for r in got] == want


def test_alerts_fire_on_edges(spark):
    ticks = spark.createDataFrame([("r", n, f) for n, f in enumerate([True, True, False, None, True])], "rule string, t int, f boolean")
    assert [(r["t"], r["edge"]) for r in edges(ticks, "rule", "t", F.col("f")).orderBy("t").collect()] == [(0, "raise"), (2, "resolve"), (4, "raise")]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_bags_match_earliest_first(spark, width):
    rng = random.Random(width)
    rows = [("A", 20, True), ("C", 1, True), ("C", 2, True), ("A", 10, False), ("B", 3, False), ("C", 9, False)] + [("hot", k, rng.random() < 0.6) for k in range(100, 400)]
    got = bag_sides(spark.createDataFrame(rows, "key string, line int, now boolean"), F.col("now"), ["key"], ["line"], F.expr(f"line div {width}")).collect()
    want = set()
    for key in "A", "B", "C", "hot":
        now, before = ([r for r in rows if r[0] == key and r[2] is side] for side in (True, False))
        want |= {(*r, "preexisting" if k < len(before) else "new") for k, r in enumerate(now)} | {(*r, "fixed") for r in before[len(now) :]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_longest_prefix_goes_by_segments(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (2, "ab/c"), (3, "x")], "id int, path string")
    owners = spark.createDataFrame([("",), ("a",), ("a/b",)], "o string")
    assert {r["id"]: r["owner"] for r in longest_prefix(rows, "path", owners, "o", ["id"]).collect()} == {1: "a/b", 2: "", 3: ""}


def test_closure_ends_on_cycles(spark):
    edges_ = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6)], "src long, dst long")
    got = closure(spark.createDataFrame([(1,)], "root long"), edges_, 4)
    assert {r["node"]: r["depth"] for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_incomplete_roots_have_no_nodes(spark):
    edges_ = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 8), (8, 7), (9, 10)], "src long, dst long")
    got = settled_closure(spark.createDataFrame([(1,), (2,), (7,), (9,)], "root long"), edges_, 4, F.col("node") == 10).collect()
    assert {tuple(r) for r in got} == {(1, None, None, False), (9, None, None, False), (7, 7, 0, True), (7, 8, 1, True)} | {(2, n, n - 2, True) for n in range(2, 7)}


def test_drain_respects_slots(spark):
    tasks = spark.createDataFrame([(n, "x") for n in range(5)] + [(9, "y")], "task long, arch string")
    workers = spark.createDataFrame([(1, "x", 1, 0.0), (2, "x", 2, 0.5)], "worker long, arch string, slots long, load double")
    assert sorted((r["task"], r["worker"]) for r in drain(tasks, workers).collect()) == [(0, 1), (1, 2), (2, 2)]


def test_the_drain_gathers_a_row_for_each_kind(spark, monkeypatch):
    """Python gets each kind's workers as one list, not a row for each option of a kind."""
    seen, assign = spark.sparkContext.accumulator(0), drains._assign
    monkeypatch.setattr(drains, "_assign", lambda queue, fleet: (seen.add(len(fleet)), assign(queue, fleet))[1])
    options = spark.range(600).selectExpr("'a' AS arch", "concat('kind ', id % 6) AS kind", "id div 6 AS worker", "1 AS slots", "double(id * 7 % 13) AS score")
    queue = spark.range(300).selectExpr("'a' AS arch", "concat('kind ', id % 6) AS kind", "id AS task", "id % 5 AS tried")
    got = sorted((r["task"], r["worker"]) for r in drains.drain_scored(queue, options).collect())
    assert seen.value == 7
    free, want = dict.fromkeys(range(100), 1), []
    for task in range(300):
        able = sorted((-float((w * 6 + task % 6) * 7 % 13), w) for w in free if free[w] and w != task % 5)
        if able:
            free[able[0][1]] = 0
            want.append((task, able[0][1]))
    assert got == want


def test_the_drain_is_asked_for_every_task(spark):
    sf = "/root/testdata/sf0.001"
    asked = demand(spark, sf)
    assert asked.count() == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert {r["est"] for r in asked.select("est").distinct().collect()} == {10, 20, 30, 40, 50}
    assert QUERIES["placement_drain"](spark, sf).filter("task % 5 <> 0").count() > 0


FLEET = "worker long, arch string, online boolean, load double, disk long, slots long, nation long, w_image long, cached long, busy long, capable array<string>"
QUEUE = "task long, project long, worktree long, arch string, est int, image long, need string, tried long"


def judged(w, t):
    """The reference: the first filter that keeps a worker from a task, and its score."""
    worker, arch, online, load, disk, slots, nation, image, cached, busy, capable = w
    _, project, worktree, asked, est, wanted, need, tried = t
    apart = arch and asked and arch != asked
    filters = [(not online, "NotOnline"), (apart, "ArchMismatch"), (worker == tried, "AlreadyTried"), (bool(set(filter(None, need.split(","))) - set(capable)), "MissingCapability"), (slots == 0, "NoFreeSlot"), (nation == project and busy == worktree, "WorktreeBusy"), (disk < max(20, -(-est * 3 // 2)), "InsufficientDisk")]
    near = 1.0 if nation == project and cached == worktree else 0.6 if nation == project else 0.0
    return next((name for bad, name in filters if bad), ""), round(min(disk / (3.0 * est), 1.0) + 1 - load + 2 * near + 0.8 * (image == wanted), 6)


def random_fleet(rng, archs):
    fleet = [(w, rng.choice(archs), rng.random() < 0.8, rng.random(), rng.choice([0, 20, 40, 60, 100]), rng.randrange(4), rng.randrange(6), rng.randrange(3), rng.randrange(2), rng.choice([None, 0, 1]), rng.choice([[], ["a"], ["a", "b"]])) for w in range(1, 25)]
    queue = [(t, rng.randrange(6), rng.randrange(2), rng.choice(archs), rng.choice([10, 30]), rng.randrange(3), rng.choice(["", "", "a", "a,b"]), rng.randrange(1, 30)) for t in range(400)]
    return fleet, queue


@pytest.mark.parametrize("archs", [["x", "y"], ["x", "y", "", None]])
def test_placement_equals_one_pair_at_a_time(spark, archs):
    fleet, queue = random_fleet(random.Random(len(archs)), archs)
    w, q = spark.createDataFrame(fleet, FLEET), spark.createDataFrame(queue, QUEUE)
    pick, why = {}, {}
    for t in queue:
        able = []
        for worker in fleet:
            reason, score = judged(worker, t)
            if reason:
                why[t[0], reason] = why.get((t[0], reason), 0) + 1
            else:
                able.append((-score, worker[0]))
        if able:
            pick[t[0]] = min(able)[1]
    assert {r["task"]: r["worker"] for r in picked(q, w).collect()} == pick
    assert {(r["task"], r["reason"]): r["workers"] for r in explained(q, w).collect()} == why
    assert {reason for _, reason in why} == {"NotOnline", "ArchMismatch", "AlreadyTried", "MissingCapability", "NoFreeSlot", "WorktreeBusy", "InsufficientDisk"}


def test_an_empty_fleet_is_told(spark):
    q = spark.createDataFrame([(1, 1, 1, "x", 10, 1, "", 3)], QUEUE)
    assert [tuple(r) for r in explained(q, spark.createDataFrame([], FLEET)).collect()] == [(1, "*", 0)]
    assert picked(q, spark.createDataFrame([], FLEET)).count() == 0


def test_drain_equals_one_task_at_a_time(spark):
    fleet, queue = random_fleet(random.Random(2), ["x", "y"])
    free, want = {w[0]: w[5] for w in fleet}, []
    for t in queue:
        able = [(-score, w[0]) for w in fleet for reason, score in [judged(w, t)] if not reason and free[w[0]]]
        if able:
            free[min(able)[1]] -= 1
            want.append((t[0], t[3], min(able)[1]))
    assert sorted(tuple(r) for r in drained(spark.createDataFrame(queue, QUEUE), spark.createDataFrame(fleet, FLEET)).collect()) == want


def test_pages_and_filters(spark):
    df = spark.range(1000).withColumn("s", F.lit("a"))
    assert page(where_given(df, s="a", id=None), ["id"], 5000).count() == 500
    assert [r["id"] for r in page(df, [F.desc("id")], 2, 1).collect()] == [998, 997]
    assert budget_prefix(df.filter("id < 10"), "s", ["id"], F.lit(3), 10).count() == 3


@pytest.mark.parametrize(("rule", "path", "want"), [("*.tmp", "a/b.tmp", True), ("/en/*", "en/x", True), ("/en/*", "x/en/x", False), ("de/**/x", "de/a/b/x", True), ("de/**/x", "de/x", True), ("a?c", "abc", True), ("[!a]b", "ab", False)])
def test_globs(spark, rule, path, want):
    assert one(spark, F.lit(path).rlike(to_regex(rule)[0])) is want


def test_missing_dependencies(spark):
    rows = {(r["log_id"], r["name"]): r for r in missing_dependencies(small_logs(spark)).collect()}
    assert rows[3, "libssh2"]["package"] == "libssh2-1-dev" and rows[3, "libssh2"]["certain"]
    assert rows[3, "z"]["package"] == "zlib1g-dev" and rows[3, "openssl/ssl.h"]["package"] == "libssl-dev" and rows[3, "cmake"]["kind"] == "program"
    assert (3, "json") not in rows
    assert rows[4, "pkg-config"]["place"] == 1 and (4, "dbus-1") not in rows
    assert rows[8, "librrd"]["package"] == "librrd-dev" and not rows[8, "librrd"]["certain"]


def test_classifier(spark):
    rules = {r["log_id"]: r["rule"] for r in classified(small_logs(spark)).collect()}
    assert {k: rules[k] for k in (1, 2, 5, 6, 7)} == {1: "compile_error", 2: "test_failed", 5: "sigkill_suspected_oom", 6: "disk_full", 7: "env_markers_raw"}


def test_test_summary_and_progress(spark):
    s = summed_tests(small_logs(spark)).first()
    assert (s["passed"], s["failed"], s["ignored"], s["binaries"], s["names"]) == (13, 2, 1, 2, "it::it::one,it::it::two")
    u = progress(small_logs(spark)).first()
    assert (u["units"], u["current"]) == (2, "bar")


def test_diagnostics_are_scraped(spark):
    got = [tuple(r) for r in scraped(small_logs(spark)).orderBy("line_no").collect()]
    assert got == [(1, 5, "src/main.rs", 7, 5, "error", "mismatched types"), (1, 6, "lib.c", 3, 0, "warning", "unused variable")]


@pytest.mark.parametrize(("file", "text", "want"), [("src/a.rs", "cannot find -lz", False), ("build.c", "openssl/ssl.h: No such file or directory", True), ("", "could not run\n= note: linker `cc` not found", False), ("", "linking failed\n= note: ld: cannot find -lssl", True), ("a.c", "the toolchain was not found", False), ("x.c", "unused", False)])
def test_whose_fault(spark, file, text, want):
    assert one(spark, environment_at_fault(F.lit(file), F.lit(text))) is want


def test_byte_budgets(spark):
    df = spark.createDataFrame([("é" * 10,), (None,), ("x" * 1000,)], "t string")
    got = [r[0] for r in df.select(cut_bytes("t", F.lit(5))).collect()]
    assert got == ["éé", None, "xxxxx"]
    assert all(r[0] is None or len(r[0].encode()) <= 100 for r in df.select(elide("t", F.lit(100))).collect())


def test_long_logs_are_packed_by_slots(spark):
    rng = random.Random(3)
    logs = {k: [rng.choice(["", " ", "é" * rng.randrange(90), "x" * rng.randrange(390)]) for _ in range(rows)] for k, rows in enumerate((1, 5, 60, 700, 3000))}
    logs[9] = ["top"] + ["x" * 18] * 600  # more critical lines than the budget holds
    want = set()
    for k, texts in logs.items():
        order = []
        for at, t in enumerate(texts, 1):
            n = len(t)
            error, e7 = n % 3 == 0, n % 5 != 0 and n % 11 == 7
            order.append((0 if at == 1 else 4 if not t.strip() else 1 if error and e7 else 2 if error else 3 if n % 3 == 1 else 4, at, t))
        left = 8192
        for slot, at, t in sorted(order):
            if left > 0:
                want.add((k, slot, at, t.encode()[:left].decode(errors="ignore")))
            left -= len(t.encode()) + 1
    df = spark.createDataFrame([(k, at, t) for k, texts in logs.items() for at, t in enumerate(texts, 1)], "log_id int, line_no int, line string")
    got = [tuple(r) for r in packed(df).select("log_id", "slot", "line_no", "text").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[1] for r in got if r[0] == 4} >= {0, 1, 2} and 8000 < sum(len(r[3].encode()) + 1 for r in got if r[0] == 4) <= 8193


def test_sinks_touch_only_what_changes(spark, tmp_path):
    schema, path = "k int, v string, n long, part int", f"file://{tmp_path}/t"
    row = lambda *rows: spark.createDataFrame([(*r, (r[0] or 0) % 2) for r in rows], schema)
    files = lambda part: {str(f) for f in (tmp_path / "t" / f"part={part}").glob("*.parquet")}
    append(row((1, "a", 1)), path, ["part"])
    new = insert_absent(row((1, "b", 5), (2, "c", 2), (2, "c", 2), (None, "d", 3)), path, schema, ["k", "part"], ["part"])
    assert sorted(map(str, (tuple(r)[:3] for r in new.collect()))) == ["(2, 'c', 2)", "(None, 'd', 3)"]
    assert insert_absent(row((None, "e", 9)), path, schema, ["k", "part"], ["part"]).count() == 0
    odd = files(1)
    put(row((2, "x", 7), (4, "y", 8)), path, schema, ["k", "part"], ["part"])
    assert files(1) == odd and len(files(0)) == 1
    assert sorted(map(str, (tuple(r)[:3] for r in held(spark, path, schema).collect()))) == ["(1, 'a', 1)", "(2, 'x', 7)", "(4, 'y', 8)", "(None, 'd', 3)"]
    sums, keys = "metric string, bucket long, sum double, count long", ["metric", "bucket"]
    assert held(spark, f"file://{tmp_path}/s", sums).count() == 0
    for rows in ([("tasks", 60, 2.0, 2)], [("tasks", 60, 3.0, 1), ("tasks", 60, 1.0, 1), ("other", 0, 1.0, 1)]):
        put(spark.createDataFrame(rows, sums), f"file://{tmp_path}/s", sums, keys, ["bucket"], ["sum", "count"])
    assert sorted(tuple(r) for r in held(spark, f"file://{tmp_path}/s", sums).collect()) == [("other", 0, 1.0, 1), ("tasks", 60, 6.0, 4)]


def test_listings_count_files_at_any_depth(spark, tmp_path):
    (tmp_path / "a" / "bb").mkdir(parents=True)
    (tmp_path / "a" / "x").write_bytes(b"12345")
    (tmp_path / "a" / "bb" / "y").write_bytes(b"1234")
    (tmp_path / "z").write_bytes(b"")
    assert sorted(r["length"] for r in listed_files(spark, f"file://{tmp_path}").collect()) in ([0, 4, 5], [4, 5])


def test_blobs_are_verified_when_they_are_read(spark, tmp_path):
    good, bad = hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"y").hexdigest()
    store_blobs(spark.createDataFrame([(good, bytearray(b"x")), (bad, bytearray(b"z"))], "hash string, content binary"), f"file://{tmp_path}/s")
    wanted = spark.createDataFrame([(good,), (bad,), ("0" * 64,), (good,)], "hash string")
    assert [(r["hash"], bytes(r["content"])) for r in fetch_blobs(wanted, f"file://{tmp_path}/s").collect()] == [(good, b"x")]


def lease_by_hand(claims, offline, lease):
    out, held = {}, {}
    for key, i, at, worker in sorted(claims, key=lambda c: (c[0], c[2], c[1])):
        now = held.get(key)
        out[i] = now is None or at - now[0] >= lease or any(w == now[1] and a <= at < b for w, a, b in offline)
        if out[i]:
            held[key] = at, worker
    return out


def test_leases(spark):
    claims = [("e", 1, 0, 1), ("e", 2, 40, 2), ("e", 3, 80, 1), ("f", 4, 0, 3), ("f", 5, 10, 1), ("f", 6, 10, 2), ("g", 7, 5, 1)]
    rng = random.Random(5)
    claims += [(rng.choice("abc"), k, rng.randrange(400), rng.randrange(4)) for k in range(10, 160)]
    offline = [(3, 8, 12), (0, 100, 130), (2, 200, 201), (1, 300, 310)]
    got = granted(spark.createDataFrame(claims, "key string, id long, at long, worker long"), spark.createDataFrame(offline, "worker long, off long, until long"), 60)
    assert {r["id"]: r["granted"] for r in got.collect()} == lease_by_hand(claims, offline, 60)


def test_leases_under_many_reports(spark):
    # pairs of claims and of reports of a worker would be 20 billion here
    claims = spark.range(200_000).select((F.col("id") % 20).alias("key"), "id", (F.col("id") * 3).alias("at"), F.lit(1).alias("worker"))
    offline = spark.range(100_000).select(F.lit(1).alias("worker"), (F.col("id") * 6).alias("off"), (F.col("id") * 6 + 1).alias("until"))
    got = granted(claims, offline, 600)
    # claims at times that six divides find their holder offline; the others wait for ten claims' time
    by = {r["id"] % 20: r["n"] for r in got.groupBy((F.col("id") % 20).alias("id")).agg(F.count_if("granted").alias("n")).collect()}
    assert all(by[k] == (10_000 if k % 2 == 0 else 1_000) for k in range(20))


def test_failures_of_each_kind_of_event_raise_alerts(spark):
    per = {0: "fdd", 1: "ff", 2: "fdddd", 3: "dddf", 5: "ddd"}
    rows = [(kind, tick, {"f": "failed", "d": "done"}[s]) for kind in "ab" for tick, told in per.items() for s in told if kind == "a" or tick > 2]
    got = failures(spark.createDataFrame(rows, "event_type string, tick long, status string"))
    # two tasks decide nothing; one of five isn't over the rate
    assert sorted(map(tuple, got.collect())) == [("failed:a", 0, "raise"), ("failed:a", 2, "resolve"), ("failed:a", 3, "raise"), ("failed:a", 5, "resolve"), ("failed:b", 3, "raise"), ("failed:b", 5, "resolve")]


def test_scans_are_taken_again_while_files_change(spark):
    scan = lambda last: lambda n: spark.createDataFrame([("a", "1"), ("b", str(min(n, last)))], "path string, hash string")
    assert [stable_scan(scan(last))[:2] for last in (0, 1, 2, 3, 9)] == [(2, True), (3, True), (4, True), (4, False), (4, False)]
    gone = stable_scan(lambda n: spark.createDataFrame([("a", "1")] + [("b", "1")] * (n == 0), "path string, hash string"))
    assert gone[:2] == (3, True) and gone[2].count() == 1


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    stream = {(r["metric"], r["bucket"]): (r["sum"], r["count"]) for r in QUERIES["stream_rollup"](spark, sf).collect()}
    from ledgerline.plans.fleet import rollup_1min

    batch = {(r["metric"], r["bucket"]): (r["sum"], r["count"]) for r in rollup_1min(spark, sf).collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())
    assert len(set(batch) - set(stream)) <= 2


def test_overview_document_holds_the_counters(spark):
    got = json.loads(overview_document(spark.createDataFrame([(3, 0.5, None)], "running long, rate double, none string")).first()["document"])
    assert got == {"running": 3, "rate": 0.5}


def test_lossy_text(spark):
    for data in (b"plain", "é漢𝄞".encode(), b"a\xffb\xfe", b""):
        df = spark.createDataFrame([(bytearray(data),)], "b binary")
        assert df.select(lossy_text(F.col("b"))).first()[0] == data.decode("utf-8", "replace")


def test_alerts_of_a_fleet(spark):
    counts = spark.createDataFrame([(0, 1, 10, 9, 0, 0), (1, 1, 10, 0, 0, 51), (20, 1, 30, 0, 30, 0), (96, 1, 0, 0, 0, 1)], "tick long, n long, fin long, infra long, late long, came long")
    got = {(r["rule"], r["tick"]): r["edge"] for r in fleet_alerts(counts).collect()}
    assert got == {
        ("infra_error_rate", 1): "raise", ("infra_error_rate", 20): "resolve", ("timeout_rate", 20): "raise", ("queue_backlog", 1): "raise", ("queue_backlog", 96): "resolve",
        ("no_workers", 2): "raise", ("no_workers", 20): "resolve", ("no_workers", 21): "raise", ("no_workers", 96): "resolve",
    }
    once = raised_once(spark.createDataFrame([("a", 5), ("a", 3), ("b", 9)], "rule string, tick long"))
    assert {tuple(r) for r in once.collect()} == {("a", 3, "raise"), ("b", 9, "raise")}
    quiet = silences(spark.createDataFrame([("w", 0), ("w", 25), ("w", 60), ("v", 70), ("u", 44)], "worker string, tick long"))
    assert {tuple(r) for r in quiet.collect()} == {("worker_offline:w", 50, "raise"), ("worker_offline:w", 60, "resolve"), ("worker_offline:u", 69, "raise")}


@pytest.mark.parametrize(("address", "want"), [
    ("127.0.0.1", True), ("8.8.8.8", False), ("0.1.2.3", True), ("100.64.0.1", True), ("100.128.0.1", False), ("255.255.255.255", True), ("255.255.255.254", False), ("239.1.1.1", True), ("203.0.113.9", True),
    ("::1", True), ("::", True), ("0:0:0:0:0:0:0:1", True), ("fd00::1", True), ("fe80::1", True), ("FE80::1", True), ("2606:4700::1111", False), ("::ffff:192.168.0.1", True), ("::ffff:9.9.9.9", False), ("::ffff:a00:1", True), ("1::1", False), ("ff02::fb", True), ("name", True), ("8.8.8.999", True), ("::ffff:8.8.8.300", True), ("", True),
])
def test_internal_addresses(spark, address, want):
    assert one(spark, is_internal(F.lit(address))) is want


def test_roots_are_laid_out(spark):
    rows = [("p", "/ws/app"), ("p", "/ws/lib"), ("p", "/ws/app/local/foo"), ("p", "/ws/app"), ("q", "/one/two"), ("r", "/opt/lib"), ("r", "/home/u/a/b/c/d/e/f/g"), ("s", "a/bc"), ("s", "a/bcd")]
    got = {(r["project"], r["root"]): tuple(r)[2:] for r in laid_out(spark.createDataFrame(rows, "project string, root string")).collect()}
    assert got == {
        ("p", "/ws/app"): ("/ws", "app", False, False, 1), ("p", "/ws/lib"): ("/ws", "lib", False, False, 2), ("p", "/ws/app/local/foo"): ("/ws", "app/local/foo", True, False, 3),
        ("q", "/one/two"): ("/one/two", "", False, False, 1), ("r", "/opt/lib"): ("", "opt/lib", False, False, 1), ("r", "/home/u/a/b/c/d/e/f/g"): ("", "home/u/a/b/c/d/e/f/g", False, True, 2),
        ("s", "a/bc"): ("a", "bc", False, False, 1), ("s", "a/bcd"): ("a", "bcd", False, False, 2),
    }


RULES = {
    1: ("success", 0, False, False), 2: ("timeout", 0, True, True), 3: ("env_diagnostics", 101, False, True), 4: ("compile_error", 101, False, False), 5: ("test_failed", 101, False, True), 6: ("oom_killed", 137, False, True),
    7: ("sigkill_suspected_oom", 101, False, False), 8: ("rustc_crash", 101, False, False), 9: ("disk_full", 1, False, False), 10: ("env_markers_raw", 127, False, False), 11: ("unknown", 1, False, False), 12: ("unknown", 1, False, False), 13: ("unknown", 101, False, False),
}
RUN_LINES = {
    1: "src/a.rs:1:2: error: odd", 2: "src/a.rs:1:2: error: odd", 3: "a.c:3:1: error: openssl/ssl.h: No such file or directory", 4: "a.c:3:1: error: cannot find -lz\nsrc/a.rs:1: error: odd\nx.c:1: warning: w",
    5: "test result: FAILED. 1 passed; 2 failed; 0 ignored", 6: "(signal: 9, SIGKILL: kill)", 7: "(signal: 9, SIGKILL: kill)\nNo space left on device", 8: "error: could not compile `a`\n(signal: 6, SIGABRT: process abort signal)",
    9: "x: NO SPACE left on device\nprotoc not found", 10: "protoc not found", 11: "(signal: 11, SIGSEGV: x)", 13: "test result: FAILED. 1 passed; 2 failed; 0 ignored",
}


def test_every_rule_of_the_classifier(spark):
    logs = spark.createDataFrame([(k, n, line) for k, text in RUN_LINES.items() for n, line in enumerate(text.split("\n"), 1)], "log_id long, line_no int, line string")
    ends = spark.createDataFrame([(k, code, late, oom, k != 13) for k, (_, code, late, oom) in RULES.items()], "log_id long, exit_code int, timed_out boolean, oom boolean, tests boolean")
    got = {r["log_id"]: r for r in classified(logs, ends).collect()}
    assert {k: r["rule"] for k, r in got.items()} == {k: v[0] for k, v in RULES.items()}
    assert (got[4]["errors"], got[4]["warnings"], got[4]["attribution"]) == (2, 1, "code") and got[7]["attribution"] == "resource" and got[12]["errors"] == 0


def test_only_the_end_of_a_log_counts(spark):
    logs = spark.createDataFrame([(1, n, "write: No space left on device" if n == 1 else "note") for n in range(1, 202)] + [(2, n, "write: No space left on device" if n == 2 else "note") for n in range(1, 202)], "log_id long, line_no int, line string")
    assert {r["log_id"]: r["rule"] for r in classified(logs).collect()} == {1: "unknown", 2: "disk_full"}


def test_diagnostics_of_a_whole_log_count(spark):
    early = [(1, 1, "src/a.rs:1:5: error: bad")] + [(1, n, "note") for n in range(2, 402)] + [(1, 402, "bash: foo: command not found")]
    loose = [(2, 1, "a.c:1:10: error: the toolchain was not found"), (3, 1, "  my dir/a.c:3:1: fatal error: x/y.h: No such file or directory"), (3, 2, "\x1b[31mb.c:1: error: cannot find -lz\x1b[0m")]
    tests = [(4, 1, "test result: FAILED. 1 passed; 1 failed; 0 ignored")] + [(4, n, "ok") for n in range(2, 300)]
    logs = spark.createDataFrame(early + loose + tests, "log_id long, line_no int, line string")
    got = {r["log_id"]: (r["rule"], r["errors"]) for r in classified(logs).collect()}
    assert got == {1: ("compile_error", 1), 2: ("compile_error", 1), 3: ("env_diagnostics", 2), 4: ("test_failed", 0)}


def test_json_messages(spark):
    span = '{"file_name": "%s", "line_start": 7, "column_start": 3, "is_primary": %s}'
    message = '{"reason": "compiler-message", "message": {"level": "%s", "message": "m", "code": {"code": "E1"}, "rendered": "%s", "spans": [%s]}}'
    rows = [
        message % ("error", "x", span % ("a.rs", "false") + "," + span % ("b.rs", "true")), message % ("warning", "x", span % ("a.rs", "false")), message % ("note", "x", ""), message % ("error", "x\\n  = note: ld: cannot find -lz\\n", ""),
        message % ("error", "x\\n  = note: n\\n          cannot find -lz", ""), message % ("error", "x\\n  = note: n\\n  --> a.c\\n   cannot find -lz", ""), message % ("error", "cannot find -lz", span % ("a.c", "true")), message % ("error", "  = help: cannot find -lz", span % ("a.rs", "true")),
        '{"reason": "build-finished"}', '{"reason": "compiler-message"}', '{"reason": "compiler-message", "message"', "plain", "", None, "  " + message % ("error", "x", "null"),
    ]
    got = compiler_messages(spark.createDataFrame(list(enumerate(rows)), "line_no int, line string").withColumn("log_id", F.lit(1))).orderBy("line_no").collect()
    assert [(r["line_no"], r["level"], r["file"], r["line"], r["environmental"]) for r in got] == [
        (0, "error", "b.rs", 7, False), (1, "warning", "a.rs", 7, False), (3, "error", "", 0, True), (4, "error", "", 0, True), (5, "error", "", 0, False), (6, "error", "a.c", 7, False), (7, "error", "a.rs", 7, False), (14, "error", "", 0, False),
    ]


def test_remedies_must_change_something(spark):
    rows = [("oom_killed", {}), ("oom_killed", {"CARGO_BUILD_JOBS": "8", "A": "1"}), ("sigkill_suspected_oom", {"CARGO_BUILD_JOBS": "2"}), ("unknown", {})]
    df = spark.createDataFrame(rows, "rule string, env map<string,string>")
    assert [r[0] for r in df.select(remedy(F.col("rule"), F.col("env"))).collect()] == [{"CARGO_BUILD_JOBS": "2"}, {"A": "1", "CARGO_BUILD_JOBS": "2"}, None, None]


@pytest.mark.parametrize(("task", "override", "own", "want"), [("test", "", None, True), ("test", "make", None, False), ("test", "", "nextest", False), ("build", "", None, False)])
def test_test_results_are_read_of_default_commands(spark, task, override, own, want):
    assert one(spark, parses_tests(F.lit(task), F.lit(override), F.lit(own))) is want


MESSAGES = {
    "Package libssh2 was not found in the pkg-config search path.": ("libssh2", "pkg-config", "libssh2-1-dev", True), "The system library `alsa` required by crate `x` was not found.": ("alsa", "pkg-config", "libasound2-dev", True),
    "/usr/bin/ld: cannot find -lglib-2.0: No such file": ("glib-2.0", "library", "libglib2.0-dev", True), "/usr/bin/ld: cannot find -lfoo-1.5": ("foo-1.5", "library", "libfoo1.5-dev", False),
    "fatal error: 'Python.h' file not found": ("Python.h", "header", "python3-dev", True), "a.c:1:2: fatal error: openssl/ssl.h: No such file or directory": ("openssl/ssl.h", "header", "libssl-dev", True),
    "sodium.h: No such file or directory": ("sodium.h", "header", "libsodium-dev", False), "sh: 1: protoc: not found": ("protoc", "program", "protobuf-compiler", True), "zsh: command not found: node": ("node", "program", "nodejs", True),
    "error: linker `cc` not found": ("cc", "program", "build-essential", True), "bash: frob: command not found": ("frob", "program", None, False), "Is `cmake` installed?": ("cmake", "program", "cmake", True),
    "failed to run custom build command for `aws-lc-sys v0.1`": ("aws-lc-sys v0.1", "build-script", None, False), "Could not find librrd": ("librrd", "pkg-config", "librrd-dev", False), "Could NOT find Protobuf (missing: X)": ("Protobuf", "pkg-config", "libprotobuf-dev", True),
    "could not find Cargo.toml": None, "Could not find directory": None, "could not find `lib.rs`": None, "unable to find library -lz": ("z", "library", "zlib1g-dev", True), '{"message": "cannot find -lz"}': None,
    '"pkg-config" "--libs" "--cflags" "gtk+-3.0" "gtk+-3.0 >= 3.22" did not exit successfully': ("gtk+-3.0 >= 3.22", "pkg-config", None, False), "push: origin: not found": None, "make: /bin/sh: line 3: ninja: not found": ("ninja", "program", "ninja-build", True),
    "Package 'zlib' was not found in the pkg-config path": ("zlib", "pkg-config", "zlib1g-dev", True), "System Library `z` required by crate `q`": ("z", "pkg-config", "zlib1g-dev", True), "\x1b[1mbash: cmake: command not found\x1b[0m": ("cmake", "program", "cmake", True),
    '"pkg-config" "--libs" "--cflags" "dbus-1" did not exit successfully: exit status: 1': ("dbus-1", "pkg-config", "libdbus-1-dev", True), "could not find native static library `pq`, perhaps an -L flag is missing?": ("pq", "library", "libpq-dev", True),
}


def test_messages_of_tools(spark):
    rows = [(k, 1, m) for k, m in enumerate(MESSAGES)]
    got = {r["log_id"]: (r["name"], r["kind"], r["package"], r["certain"]) for r in missing_dependencies(spark.createDataFrame(rows, "log_id long, line_no int, line string")).collect()}
    assert {m: got.get(k) for k, m in enumerate(MESSAGES)} == MESSAGES


def test_hints_and_path_dependencies(spark):
    assert {tuple(r) for r in hinted(spark.createDataFrame([(1, "openssl-sys and openssl-sys, protoc"), (2, None), (3, "serde")], "id int, text string"), HINTS).collect()} == {(1, "libssl-dev pkg-config"), (1, "protobuf-compiler")}
    doc = '{"packages": [{"name": "a", "dependencies": [{"name": "b", "path": "/w/b"}, {"name": "serde", "path": null}]}], "patch": {"crates-io": {"b": "/y/b", "z": "/y/z"}}, "replace": {"b": "/r/b"}, "odd": []}'
    got = path_dependencies(spark.createDataFrame([(1, doc)], "id int, doc string"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", "b", "/y/b"), (1, "", "z", "/y/z")}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        path_dependencies(spark.createDataFrame([(1, "{oops")], "id int, doc string")).collect()


def test_settings_tolerate_what_they_do_not_know(spark):
    rows = [(1, "offline_hours = 3\nx = 1\n[y]\nz = 2"), (2, "offline_hours = 'a'"), (3, "= ="), (4, None)]
    assert [tuple(r) for r in settings(spark.createDataFrame(rows, "id int, conf string")).orderBy("id").collect()] == [(1, "x,y", 3, 10, 20), (2, "", 24, 10, 20), (3, "", 24, 10, 20), (4, "", 24, 10, 20)]


def test_manifest_entries(spark):
    stats = spark.createDataFrame([(1, "file", 0o100755, "", bytearray(b"x")), (2, "symlink", 0o120777, "../é", None), (3, "directory", 0o40755, "", None), (4, "missing", 0, "", None), (5, "file", 0o100644, "", bytearray(b""))], "id long, type string, mode int, target string, content binary")
    got = {r["id"]: tuple(r)[1:] for r in entries(stats, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    h = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {1: ("file", h(b"x"), 1, True, True, ""), 2: ("symlink", h("../é".encode()), 5, False, False, "../é"), 5: ("file", h(b""), 0, False, False, "")}
