"""Deltas, searches, addresses, approvals, overlaps and streams with state, on small cases and against brute force."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.adapters import diagnosed, register
from ledgerline.functions.diagnostics import compiler_message, scraped
from ledgerline.operators.matching import overlapping
from ledgerline.plans.paths import canonical_address, egress_error
from ledgerline.plans.reviews import collisions, consent, delta_report, log_chunks, notices, reclaimed, script_states, summaries, taken_up
from ledgerline.plans.search import entry_error
from ledgerline.plans.registry import QUERIES
from ledgerline.plans.sets import ago, fingerprints, percent, short_id, whole_duration
from ledgerline.sources.scratch import Folder, scratch, shared_dir
from ledgerline.operators.logs import classified
from ledgerline.streaming.rollups import drained, latest_worker
from ledgerline.streaming.states import state_store, task_ends


def one(spark, column):
    return spark.range(1).select(column).first()[0]


DIAGNOSTIC = "log_id long, pos long, level string, code string, message string, file string, now boolean"


def delta(spark, rows, cut=()):
    both = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], DIAGNOSTIC)
    return delta_report(both, spark.createDataFrame([(1, *cut)] if cut else [], "log_id long, current long, baseline long")).first()


def test_delta_matches_bags_and_names_crates(spark):
    same = ("error", "E1", "at src/a.rs:1:2 odd", "core/src/a.rs")
    moved_line = ("error", "E1", "at src/a.rs:9:9 odd", "core/src/a.rs")
    r = delta(spark, [(*same, True), (*same, True), (*moved_line, False), ("warning", "W", "w", "src/x.rs", True), ("warning", "W", "w", "src/x.rs", False), ("note", "", "n", "", True), ("note", "", "n", "", False)])
    assert (r["n_new"], r["n_fixed"], r["n_preexisting"], r["approximate"], r["summary"]) == (1, 0, 3, False, "(unknown): 1, core: 1, x.rs: 1")


@pytest.mark.parametrize(
    ("rows", "cut", "causes", "fixed"),
    [
        ([("error", "E", "m", "a.rs", True), ("error", "E", "m", "b.rs", False)], (), "moved", 1), ([("error", "E", "m", "a.rs", True), ("error", "E", "q", "b.rs", False)], (), "", 1),
        ([("error", "E", "m", "a.rs", True), ("error", "E", "m", "b.rs", False)], (2, 0), "current_truncated,moved", 0), ([("error", "E", "q", "b.rs", False)], (0, 1), "baseline_truncated", 0),
        ([("warning", "", "m", "a.rs", True)], (), "empty_code", 0), ([("note", "", "m", "a.rs", True)], (), "", 0),
    ],
)
def test_delta_tells_why_it_is_approximate(spark, rows, cut, causes, fixed):
    r = delta(spark, rows, cut)
    assert (r["causes"], r["approximate"], r["n_fixed"]) == (causes, causes != "", fixed)


def test_searches_tell_why_they_are_empty(spark):
    logs = spark.createDataFrame([(1, n, t) for n, t in enumerate(["The a", "b", "the c", "THE d"], 1)], "log_id long, line_no int, line string")
    asked = [(1, 1, "the", 1, 1, False, True), (2, 1, "the", 0, 2, True, True), (3, 1, "zz", 0, 0, False, True), (4, 1, "", 9, 0, False, True), (5, 1, "the", 0, 0, False, False), (6, 2, "the", 0, 0, False, True)]
    got = log_chunks(spark.createDataFrame(asked, "query long, log_id long, needle string, start long, most long, tail boolean, has_log boolean"), logs).orderBy("query").collect()
    assert [(r["text"], r["offset"], r["next_offset"], r["total"], r["matched"], r["truncated"], r["empty_reason"]) for r in got] == [
        ("the c", 1, 2, 4, 3, True, ""), ("the c\nTHE d", 1, 3, 4, 3, False, ""), ("", 0, 0, 4, 0, False, "no_match"), ("", 4, 4, 4, 4, False, ""), ("", 0, 0, 0, 0, False, "no_log"), ("", 0, 0, 0, 0, False, "no_match"),
    ]


def test_a_log_in_short(spark):
    logs = spark.createDataFrame([(1, 1, "x"), (1, 2, " error: y "), (1, 3, ""), (2, 1, "a"), (2, 2, " ")], "log_id long, line_no int, line string")
    assert [tuple(r) for r in summaries(logs, "x", 2).orderBy("log_id").collect()] == [(1, 3, 1, "error: y", " error: y \n"), (2, 2, 0, "a", "a\n ")]


@pytest.mark.parametrize(
    ("raw", "why"),
    [
        (" Example.COM ", ""), ("*.example.com", ""), ("", "empty"), ("https://a.b", "url"), ("a.b/c", "url"), ("a.b?c", "url"), ("a.b#c", "url"), ("me@a.b", "url"), ("a b.c", "url"), ("a.b:80", "port"), ("a.*.b", "wildcard"), ("*.*.b", "wildcard"), ("*", "wildcard"),
        ("a..b", "empty_label"), (".a.b", "empty_label"), ("a_b.c", "characters"), ("ä.de", "characters"), ("*.com", "too_broad"), ("localhost", "single_label"), ("127.0.0.1", "address"), ("127.0.0.0x1", "address"), ("x.xn--p1ai", ""), ("0x7f.0.0.1", "address"),
    ],
)
def test_host_patterns(spark, raw, why):
    assert one(spark, egress_error(F.lit(raw))) == why


@pytest.mark.parametrize("url", ["git@Host.org:o/R.git", "https://host.org/o/r.git", "https://host.org/o/r/", "http://host.org/o/r", "ssh://git@host.org/o/r.git", "git+https://host.org/o/r", " git+ssh://git@host.org/o/r.git/ ", "host.org/o/r"])
def test_one_repository_has_one_address(spark, url):
    assert one(spark, canonical_address(F.lit(url))) == "host.org/o/r"


@pytest.mark.parametrize(("key", "value", "place", "why"), [("A", "x", 1, ""), ("A", "x", 33, "too_many"), ("1A", "x", 1, "bad_name"), ("", "x", 1, "bad_name"), ("PATH", "x", 1, "denied"), ("SCCACHE_X", "x", 1, "denied"), ("path", "x", 1, ""), ("A", "é" * 2049, 1, "too_long")])
def test_environment_entries(spark, key, value, place, why):
    assert one(spark, entry_error(F.lit(key), F.lit(value), F.lit(place))) == why


def test_texts_for_people(spark):
    now = F.lit(10 * 86_400_000)
    ages = [one(spark, ago(F.lit(ms), now)) for ms in (0, 864_000_000, 863_990_000, 863_000_000, 800_000_000, 864_000_001)]
    assert ages == ["never", "now", "10s ago", "16m ago", "17h ago", "now"]
    assert [one(spark, percent(F.lit(x))) for x in (0.0, 0.125, 0.005, 1.0)] == ["0%", "13%", "1%", "100%"]
    assert [one(spark, whole_duration(F.lit(s))) for s in (86_400, 7200, 120, 61)] == ["1 d", "2 h", "2 min", "61 s"]
    assert [one(spark, short_id(F.lit(s))) for s in ("t-1", "worker-01kyabcdefgh", "x" * 14, "averylongkind-123")] == ["t-1", "worker-…cdefgh", "…" + "x" * 10, "…gkind-123"[:0] + "…lkind-123"[:0] + "…" + "averylongkind-123"[-10:]]


def test_fingerprints_need_a_manifest_and_a_digest(spark):
    digest = "i@sha256:" + "a" * 64
    rows = [(1, "m", digest, "t", "p", []), (2, "", digest, "t", "p", []), (3, "m", "i:latest", "t", "p", []), (4, "m", digest, "t", "p", ["b", "a", "b"]), (5, "m", digest, "t", "p", ["a", "b"]), (6, "m", None, "t", "p", [])]
    got = {r["id"]: r for r in fingerprints(spark.createDataFrame(rows, "id int, manifest string, image string, toolchain string, profile string, grants array<string>")).collect()}
    assert [got[k]["error"] for k in range(1, 7)] == ["", "missing_manifest", "image_not_digest", "", "", "image_not_digest"]
    assert got[1]["granted"] == got[1]["fingerprint"] == got[4]["fingerprint"] and got[4]["granted"] == got[5]["granted"] != got[1]["granted"] and got[2]["fingerprint"] == ""


def test_queues_are_filled_in_order(spark):
    asked = spark.createDataFrame([("p", "a", 5), ("p", "b", 1), ("p", "a", 0), ("p", "c", 2), ("p", "z", 9), ("q", "a", 1)], "key string, item string, at long")
    got = taken_up(asked, spark.createDataFrame([("p", "z"), ("p", "y")], "key string, item string"), 4)
    assert {(r["key"], r["item"]): r["taken"] for r in got.collect()} == {("p", "a"): True, ("p", "b"): True, ("p", "c"): False, ("p", "z"): True, ("q", "a"): True}


def test_one_script_is_approved(spark):
    rows = [("k", "a", 1, "approved"), ("k", "b", 2, "approved"), ("k", "c", 3, "rejected"), ("k", "a", 0, "rejected"), ("l", "a", 1, "rejected")]
    assert {(r["key"], r["digest"]): r["status"] for r in script_states(spark.createDataFrame(rows, "key string, digest string, at long, status string")).collect()} == {("k", "a"): "superseded", ("k", "b"): "approved", ("k", "c"): "rejected", ("l", "a"): "rejected"}


def test_volumes_that_live_tasks_use_stay(spark):
    volumes = spark.createDataFrame([("a", 0), ("b", 0), ("c", 95), (None, 0)], "worktree string, used long")
    decide = lambda everything: {r["worktree"]: r["decision"] for r in reclaimed(volumes, F.lit(100), 10, F.lit(everything), spark.createDataFrame([("a",)], "worktree string")).collect()}
    assert decide(False) == {"a": "skipped_active", "b": "reclaimed", "c": "skipped_fresh", None: "kept"} and decide(True)["c"] == "reclaimed"


def test_consent_by_policy(spark):
    found = spark.createDataFrame([("auto", "x"), ("listed", "d/e"), ("listed", "d"), ("short", "d"), ("short", "dd"), ("empty", "x"), ("absent", "x")], "repo string, root string")
    policies = spark.createDataFrame([("auto", "auto"), ("listed", "list"), ("short", "list"), ("empty", "list")], "repo string, policy string")
    got = {r["repo"]: tuple(r)[1:] for r in consent(found, policies, spark.createDataFrame([("listed", "d"), ("short", "d")], "repo string, dir string")).collect()}
    assert got == {"auto": ("approved", 0, 1), "listed": ("approved", 0, 2), "short": ("blocked", 1, 0), "empty": ("approved", 0, 0), "absent": ("blocked", 1, 0)}


def test_paths_of_two_roots_collide(spark):
    rows = [("a", "x"), ("b", "x"), ("a", "x"), ("a", "y"), ("b", "X")]
    assert [tuple(r) for r in collisions(spark.createDataFrame(rows, "root string, path string")).collect()] == [("x", "a,b")]


def test_notices_by_category(spark):
    schema = "id int, roots array<string>, exclude array<string>, include array<string>, egress_config array<string>, egress_pending array<string>, egress_refused array<string>, warnings array<string>"
    rows = [(1, ["."], [], [], [], [], [], []), (2, [".", "b", "a"], ["q", "p"], [], [], ["h"], [], ["no BASELINE", "w", "v", "baseline two"])]
    got = {(r["id"], r["category"], r["severity"], r["identity"]) for r in notices(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, "sync_roots", "info", "a,b"), (2, "exclude", "critical", "p,q"), (2, "egress_pending", "critical", "h"), (2, "baseline_off", "critical", "no BASELINE"), (2, "baseline_off", "critical", "baseline two"), (2, "scanner", "warning", "v,w")}


LINES = [
    "a b.c:1:2: fatal error: x/y.h: No such file", "\x1b[31msrc/a.rs:7: warning: w\x1b[0m", "   x.c:3:error:odd", "plain", "a:b", "x.c:1: errors: no", "",
    '{"reason": "compiler-message", "message": {"message": "m", "code": {"code": "E1"}, "spans": [{"file_name": "a", "is_primary": false, "line_start": 1, "column_start": 2}, {"file_name": "b", "is_primary": true, "line_start": 3, "column_start": 4}]}}',
    '{"reason": "compiler-message", "message": {"level": "note", "message": "m"}}', '{"reason": "compiler-message"', '{"reason": "x"}', '{"reason": "compiler-message", "message": {"level": "warning", "message": "m", "code": null, "spans": []}}',
]


@pytest.mark.parametrize(("adapter", "column"), [("generic", scraped), ("cargo", compiler_message), ("another", scraped)])
def test_adapters_tell_what_the_columns_tell(spark, adapter, column):
    logs = spark.createDataFrame([(n % 2, n, t) for n, t in enumerate([*LINES, None])], "log_id long, line_no long, line string")
    want = logs.select("log_id", "line_no", column(F.col("line")).alias("d")).filter("d IS NOT NULL").select("log_id", "line_no", *[F.col(f"d.{c}") for c in ("level", "code", "message", "file", "line", "column")])
    got = diagnosed(logs, adapter)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_adapters_shuffle_no_lines_and_tell_what_the_table_function_tells(spark):
    logs = spark.createDataFrame([(n % 2, n, t) for n, t in enumerate([*LINES, None])], "log_id long, line_no long, line string")
    for adapter in ("generic", "cargo"):
        got = diagnosed(logs, adapter)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "UDTF" not in plan
        register(spark)
        want = spark.sql("SELECT * FROM diagnose(:a, TABLE(SELECT log_id, line_no, line FROM {logs}))", args={"a": adapter}, logs=logs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_the_classifier_reads_logs_once(spark):
    rows = [(1, n, "note: x") for n in range(1, 401)] + [(1, 200, "(signal: 9, SIGKILL: kill)"), (2, 1, "(signal: 9, SIGKILL: kill)"), (2, 200, "note: y"), (3, 201, "z"), (3, 1, "No space left on device"), (4, 1, "no space left on device"), (4, 150, "q")]
    got = classified(spark.createDataFrame(rows, "log_id long, line_no int, line string"))
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {r["log_id"]: r["rule"] for r in got.collect()} == {1: "unknown", 2: "sigkill_suspected_oom", 3: "unknown", 4: "disk_full"}


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.choice([0, 1, 5, 40, 200])))(rng.randrange(-100, 500))
    left = [("hot" if k % 3 else "cold", k, *span()) for k in range(150)]
    right = [("hot" if k % 4 else "cold", k, *span()) for k in range(80)]
    got = overlapping(spark.createDataFrame(left, "key string, a int, from_at long, to_at long"), spark.createDataFrame(right, "key string, b int, r_from long, r_to long"), "key", 30)
    want = {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3])}
    pairs = [(r["a"], r["b"]) for r in got.select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "task long, id long, at_ms long, status string"
    first = [(1, 1, 0, "queued"), (1, 2, 50, "done"), (2, 3, 0, "queued"), (3, 4, 10, "queued")]
    late = [(1, 5, 60, "failed"), (2, 6, 500, "done"), (3, 7, 90, "canceled"), (4, 8, 10_000, "queued")]
    for n, rows in enumerate((first, first, late, late)):
        spark.createDataFrame([(t, i, 1_000_000 + at, status) for t, i, at, status in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={n}")
    stream = spark.readStream.schema(schema + ", batch int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second")
    with state_store(spark):
        got = drained(task_ends(stream.select("task", "id", "at_ms", "status", "at"), 100), "replay")
    ends = sorted((r["task"], r["at"] - 1_000_000, r["status"]) for r in got.collect())
    assert ends == [(1, 50, "done"), (2, 100, "expired"), (3, 90, "canceled")]


def test_tasks_share_states(spark, tmp_path):
    schema = "task long, id long, at_ms long, status string"
    rows = [(t, 2 * t + k, 1_000_000 + t % 7 + 20 * k, "done" if k and t % 3 else "queued") for t in range(2500) for k in (0, 1)] + [(9000, 9000, 1_010_000, "done")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 second")
    with state_store(spark):
        got = drained(task_ends(stream.select("task", "id", "at_ms", "status", "at"), 100), "shared-states")
        state = next(f.path for f in Folder.live if "shared-states-state" in f.path)
        assert spark.read.format("statestore").load(state).count() == 4  # of 2501 tasks
    want = [(t, 1_000_000 + t % 7 + (20 if t % 3 else 100), "done" if t % 3 else "expired") for t in range(2500)] + [(9000, 1_010_000, "done")]
    assert sorted(map(tuple, got.collect())) == want


def test_a_pin_shows_while_a_worker_is_online():
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    shown = []
    state = State()
    for n, what in enumerate(["view", "error", "click", "signup", "view", "purchase"]):
        shown += [next(latest_worker((1,), iter([pd.DataFrame({"event_id": [n], "event_type": [what]})]), state))["status"][0]]
    assert shown == ["online", "draining", "busy", "offline", "draining", "online"]


def test_a_pin_counts_in_whatever_order_rows_come():
    import itertools

    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    events = [(1, "error"), (2, "click"), (4, "view")]
    for order in itertools.permutations(events):
        for chunks in ([order], [order[:1], order[1:]], [[e] for e in order]):
            frames = [pd.DataFrame(list(c), columns=["event_id", "event_type"]) for c in chunks]
            assert next(latest_worker((1,), iter(frames), State())).values.tolist() == [[1, 4, "draining"]]
            state = State()
            assert [next(latest_worker((1,), iter([f]), state)) for f in frames][-1].values.tolist() == [[1, 4, "draining"]]


@pytest.mark.parametrize("name", ["delta_summary", "rollup_sink", "blob_gets", "lease_claims", "dependency_closure", "stream_sessions"])
def test_scratch_leaves_nothing_behind(spark, name):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    with scratch():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and set(shared.iterdir()) > before
    assert set(shared.iterdir()) == before
