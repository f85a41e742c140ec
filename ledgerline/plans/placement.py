"""Placement of tasks on workers: hard filters in order, scores, the best worker, reasons, first fit and a greedy drain.

Tasks of equal project, worktree, architecture, estimate, image and needs are of a kind. To pick and to explain, only architecture, estimate and
needs are held against the fleet; what a project, an image or a worker that was tried changes is put right by joins of equality. Scores of
all pairs, and a drain, hold every kind against the fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.drain import drain_scored
from ..sources.telemetry import load, tasks
from .base import TASKS, query

#: Weights of disk, processor, cache and image, and the least free disk in GB.
W_DISK, W_CPU, W_CACHE, W_IMAGE, MIN_DISK = 1.0, 1.0, 2.0, 0.8, 20
KIND = ["project", "worktree", "arch", "est", "image", "need"]
#: What of a kind counts whatever its project and image.
BASE = ["arch", "est", "need"]

_FLEET = """w AS (SELECT s_suppkey AS worker, r_name AS arch, s_suppkey % 10 <> 9 AS online, (s_acctbal + 1000) / 11000.0 AS load, s_suppkey % 7 * 20 AS disk, s_suppkey % 4 AS slots, s_nationkey AS nation, s_suppkey % 6 AS image,
  s_suppkey % 2 AS cached, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey // 3 % 2 END AS busy, s_suppkey % 5 <> 2 AS multi_root FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 d AS (SELECT c_custkey AS task, c_nationkey AS project, c_custkey % 2 AS worktree, r_name AS arch, 10 + c_custkey % 5 * 10 AS est, c_custkey % 6 AS image, CASE WHEN c_custkey % 4 = 0 THEN 'multi_root' ELSE '' END AS need, c_custkey % 100 AS tried
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_REASON = f"""CASE WHEN NOT online THEN 'NotOnline' WHEN d.arch <> w.arch THEN 'ArchMismatch' WHEN worker = tried THEN 'AlreadyTried' WHEN need = 'multi_root' AND NOT multi_root THEN 'MissingCapability'
  WHEN slots = 0 THEN 'NoFreeSlot' WHEN nation = project AND busy = worktree THEN 'WorktreeBusy' WHEN disk < greatest({MIN_DISK}, ceil(1.5 * est)) THEN 'InsufficientDisk' ELSE '' END"""
_SCORE = f"""{W_DISK} * least(disk / (3.0 * greatest(est, 1)), 1.0) + {W_CPU} * (1.0 - least(greatest(load, 0.0), 1.0)) + {W_CACHE} * CASE WHEN nation = project AND cached = worktree THEN 1.0 WHEN nation = project THEN 0.6 ELSE 0.0 END
  + {W_IMAGE} * CASE WHEN w.image = d.image THEN 1.0 ELSE 0.0 END"""
_PAIRS = f"{_FLEET}, p AS (SELECT task, worker, {_REASON} AS reason, {_SCORE} AS score FROM d, w)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("arch"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers: architecture, state, load, free disk in GB, free slots, where they are, their image, and worktrees (of the project that is
    where they are) that they have cached and are busy with, and what they are capable of."""
    n = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(
        n.alias("worker"), "arch", (n % 10 != 9).alias("online"), ((F.col("s_acctbal") + 1000) / 11000.0).alias("load"), (n % 7 * 20).alias("disk"), (n % 4).alias("slots"),
        F.col("s_nationkey").alias("nation"), (n % 6).alias("w_image"), (n % 2).alias("cached"), F.when(n % 3 == 0, F.expr("s_suppkey div 3 % 2")).alias("busy"),
        F.when(n % 5 != 2, F.array(F.lit("multi_root"), F.lit("relink"))).otherwise(F.array(F.lit("relink"))).alias("capable"),
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks to place: project, worktree, architecture, disk estimate in GB, image, needs (capabilities, joined by commas) and a worker already tried."""
    n = F.col("c_custkey")
    return load(spark, sf_dir, "customer").join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(
        n.alias("task"), F.col("c_nationkey").alias("project"), (n % 2).alias("worktree"), "arch", (10 + n % 5 * 10).alias("est"), (n % 6).alias("image"),
        F.when(n % 4 == 0, "multi_root").otherwise("").alias("need"), (n % 100).alias("tried"),
    )


def known(arch: Column) -> Column:
    return F.coalesce(arch, F.lit("")) != ""


def scored(kinds: DataFrame, fleet: DataFrame, also: Column | None = None) -> DataFrame:
    """The columns KIND, worker, nation, reason (the first hard filter that rejects, or empty) and score, for workers that are online and whose architecture may be that of the kind.

    A known architecture meets its own and, under a key of theirs, those that aren't known; one that isn't known meets all.
    """
    any_, unknown = F.lit("?any"), F.lit("?unknown")
    sides = F.when(known(F.col("arch")), F.array(F.concat(F.lit("="), "arch"), unknown)).otherwise(F.array(any_))
    asked = kinds.withColumn("_key", F.explode(sides))
    own = F.when(known(F.col("w_arch")), F.array(F.concat(F.lit("="), "w_arch"), any_)).otherwise(F.array(unknown, any_))
    ready = fleet.filter("online").withColumnRenamed("arch", "w_arch").withColumn("_key", F.explode(own)).withColumnRenamed("_key", "_own")
    meet = F.col("_key") == F.col("_own")
    return judged(asked.join(ready, meet if also is None else meet & also)).select(*KIND, "worker", "nation", "reason", "plain", "score")


def judged(both: DataFrame) -> DataFrame:
    """The columns of `both`, kinds that stand beside workers, with reason, plain (the reason where the project counts for nothing) and score."""
    lacks = F.size(F.array_except(F.filter(F.split("need", ","), lambda x: x != ""), "capable")) > 0
    busy = (F.col("nation") == F.col("project")) & F.col("busy").eqNullSafe(F.col("worktree"))

    def first(busy: Column) -> Column:
        small = F.col("disk") < F.greatest(F.lit(MIN_DISK), F.ceil(F.col("est") * 1.5))
        return F.when(lacks, "MissingCapability").when(F.col("slots") == 0, "NoFreeSlot").when(busy, "WorktreeBusy").when(small, "InsufficientDisk").otherwise("")

    disk = F.least(F.col("disk") / (3.0 * F.greatest("est", F.lit(1))), F.lit(1.0))
    cache = F.when((F.col("nation") == F.col("project")) & F.col("cached").eqNullSafe(F.col("worktree")), 1.0).when(F.col("nation") == F.col("project"), 0.6).otherwise(0.0)
    score = W_DISK * disk + W_CPU * (1.0 - F.least(F.greatest("load", F.lit(0.0)), F.lit(1.0))) + W_CACHE * cache + W_IMAGE * F.when(F.col("w_image") == F.col("image"), 1.0).otherwise(0.0)
    return both.withColumns({"reason": first(busy), "plain": first(F.lit(False)), "score": score})


def options(queue: DataFrame, fleet: DataFrame) -> DataFrame:
    """KIND, worker and score (to six places) of the workers that may take a kind of task."""
    return scored(queue.select(*KIND).distinct(), fleet).filter("reason = ''").select(*KIND, "worker", F.round("score", 6).alias("score"))


def shortlist(pairs: DataFrame, kind: list[str]) -> DataFrame:
    """kind and worker of the four best of each kind, two of a project's place at most: so two stay, whichever place and worker don't count."""
    order = [F.desc(F.round("score", 6)), "worker"]
    two = pairs.filter("reason = ''").withColumn("_n", F.row_number().over(Window.partitionBy(*kind, "nation").orderBy(*order))).filter("_n <= 2")
    return two.withColumn("_n", F.row_number().over(Window.partitionBy(*kind).orderBy(*order))).filter("_n <= 4").select(*kind, "worker")


def best_two(queue: DataFrame, fleet: DataFrame) -> DataFrame:
    """KIND, first and second: the best workers of each kind, without scoring every kind against every worker.

    What a project and an image add to a score is theirs alone. So workers are ranked once for each architecture, estimate and need without either, then,
    by equality, those that have the image, and those where the project is; the best of a kind are among the few at the top of these lists.
    """
    kinds = queue.select(*KIND).distinct()
    types = {f.name: f.dataType for f in kinds.schema.fields}
    blank = lambda c: F.lit(None).cast(types[c]).alias(c)
    plain = kinds.select(*[blank(c) if c in ("project", "worktree", "image") else F.col(c) for c in KIND]).distinct()
    imaged = kinds.select(*[blank(c) if c in ("project", "worktree") else F.col(c) for c in KIND]).distinct()
    image = [*BASE, "image"]
    lists = [
        (shortlist(scored(plain, fleet), BASE), BASE), (shortlist(scored(imaged, fleet, F.col("image") == F.col("w_image")), image), image),
        (shortlist(scored(kinds, fleet, F.col("project") == F.col("nation")), KIND), KIND),
    ]
    rows = [with_kind(kinds, few, of).select(*KIND, "worker") for few, of in lists]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])
    tops = judged(found.distinct().join(fleet.withColumnRenamed("arch", "w_arch"), "worker")).filter("reason = ''")
    rank = F.row_number().over(Window.partitionBy(*KIND).orderBy(F.desc(F.round("score", 6)), "worker"))
    pick = lambda n: F.max(F.when(F.col("rank") == n, F.col("worker")))
    return tops.withColumn("rank", rank).filter("rank <= 2").groupBy(*KIND).agg(pick(1).alias("first"), pick(2).alias("second"))


def picked(queue: DataFrame, fleet: DataFrame) -> DataFrame:
    """task and its best worker, of equals that of the lowest id: the best of its kind, or the second best where it has tried that one."""
    # an image, a worktree or an architecture that isn't known is a value like others here
    return with_kind(queue, best_two(queue, fleet)).select("task", F.when(F.col("first").eqNullSafe(F.col("tried")), F.col("second")).otherwise(F.col("first")).alias("worker")).filter("worker IS NOT NULL")


def with_kind(queue: DataFrame, of: DataFrame, kind: list[str] = KIND) -> DataFrame:
    """Tasks joined to what `of` says of their kind."""
    on = F.lit(True)
    named = of.select(*[F.col(c).alias(f"_{c}") for c in kind], *[c for c in of.columns if c not in kind])
    for c in kind:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return queue.join(named, on).drop(*[f"_{c}" for c in kind])


def explained(queue: DataFrame, fleet: DataFrame) -> DataFrame:
    """task, reason and workers: how many workers each hard filter keeps from a task, the first that rejects counting; '*' where there is no worker at all.

    Workers that aren't online or are of another architecture are counted by architecture, all others by what a task needs, whatever its project. By
    equality, the workers where its project is then go over to the reason that this gives, and the one it has tried already to AlreadyTried.
    """
    ready = F.col("online") & known(F.col("arch"))
    total = lambda c: fleet.agg(c.cast("long").alias("n")).scalar()
    by_arch = fleet.filter(ready).groupBy(F.col("arch").alias("_arch")).agg(F.count("*").alias("own"))
    apart = F.when(known(F.col("arch")), total(F.count_if(ready)) - F.coalesce("own", F.lit(0))).otherwise(0)
    counts = F.array(F.struct(F.lit("NotOnline").alias("reason"), total(F.count_if(~F.col("online"))).alias("n")), F.struct(F.lit("ArchMismatch").alias("reason"), apart.alias("n")))
    of_arch = queue.join(by_arch, F.col("arch") == F.col("_arch"), "left").select("task", F.explode(counts).alias("x")).select("task", "x.reason", "x.n")
    kinds = queue.select(*KIND).distinct()
    types = {f.name: f.dataType for f in kinds.schema.fields}
    base = kinds.select(*[F.col(c) if c in BASE else F.lit(None).cast(types[c]).alias(c) for c in KIND]).distinct()
    rejected = scored(base, fleet).filter("reason <> ''").groupBy(*BASE, "reason").agg(F.count("*").alias("n"))
    of_kind = with_kind(queue, rejected, BASE).select("task", "reason", "n")
    step = lambda reason, n: F.struct(reason.alias("reason"), F.lit(n).cast("long").alias("n"))
    # what the project changes, for the workers that have it
    own = scored(kinds, fleet, F.col("project") == F.col("nation")).filter("reason <> plain").select(*KIND, F.explode(F.array(step(F.col("reason"), 1), step(F.col("plain"), -1))).alias("x"))
    of_project = with_kind(queue, own.select(*KIND, "x.reason", "x.n").groupBy(*KIND, "reason").agg(F.sum("n").alias("n"))).select("task", "reason", "n")
    meet = (F.col("tried") == F.col("worker")) & (~known(F.col("arch")) | ~known(F.col("w_arch")) | (F.col("arch") == F.col("w_arch")))
    tried = judged(queue.join(fleet.filter("online").withColumnRenamed("arch", "w_arch"), meet))
    moved = tried.select("task", F.explode(F.array(step(F.lit("AlreadyTried"), 1), step(F.col("reason"), -1))).alias("x")).select("task", "x.reason", "x.n")
    nobody = queue.filter(total(F.count("*")) == 0).select("task", F.lit("*").alias("reason"), F.lit(0).cast("long").alias("workers"))
    told = of_arch.unionAll(of_kind).unionAll(of_project).unionAll(moved).filter("reason <> ''").groupBy("task", "reason").agg(F.sum("n").alias("workers")).filter("workers > 0")
    return told.unionAll(nobody)


_KINDS = ", ".join(f"d.{c}" for c in KIND)


@query(f"WITH {_FLEET} SELECT DISTINCT {_KINDS}, worker, round({_SCORE}, 6) AS score FROM (SELECT DISTINCT {', '.join(KIND)}, -1 AS tried FROM d) d, w WHERE {_REASON} = ''")
def placement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every worker that may take a kind of task."""
    return options(demand(spark, sf_dir), fleet(spark, sf_dir))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 6) DESC, worker) AS rn FROM p WHERE reason = '') SELECT task, worker FROM r WHERE rn = 1")
def placement_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best worker of each task; of equals, the one of the lowest id."""
    return picked(demand(spark, sf_dir), fleet(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT task, reason, count(*) AS workers FROM p WHERE reason <> '' GROUP BY 1, 2")
def placement_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why workers can't take a task, by reason."""
    return explained(demand(spark, sf_dir), fleet(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_PAIRS}, best AS (SELECT task, list(worker ORDER BY round(score, 6) DESC, worker) AS ranked FROM p WHERE reason = '' GROUP BY 1), caps AS (SELECT map(list(worker), list(slots)) AS cap FROM w),
 q AS (SELECT d.arch, task, ranked, row_number() OVER (PARTITION BY d.arch ORDER BY task) AS pos FROM d JOIN best USING (task)),
 r(arch, pos, task, worker, used) AS (SELECT DISTINCT arch, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM q
  UNION ALL SELECT arch, pos, task, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
   SELECT q.arch, q.pos, q.task, r.used, list_filter(ranked, lambda x: len(list_filter(r.used, lambda y: y = x)) < cap[x])[1] AS pick FROM r JOIN q ON q.arch = r.arch AND q.pos = r.pos + 1 CROSS JOIN caps) s)
 SELECT task, arch, worker FROM r WHERE worker IS NOT NULL"""
)
def placement_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of each architecture served first come, first served: each task takes the best worker of those that may take it, while slots last."""
    return drained(demand(spark, sf_dir), fleet(spark, sf_dir))


def drained(queue: DataFrame, fleet: DataFrame) -> DataFrame:
    """task, arch and worker. Kinds are scored once against the fleet; what a task tried is set aside later. Only workers and tasks of known architecture take part."""
    able = options(queue, fleet).join(fleet.filter("arch <> ''").select("worker", "slots"), "worker")
    kind = F.to_json(F.struct(*KIND))
    return drain_scored(queue.filter("arch <> ''").select("arch", kind.alias("kind"), "task", "tried"), able.select(F.col("arch").alias("arch"), kind.alias("kind"), "worker", "slots", "score"))


@query("""WITH o AS (SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 10 <> 9 AND s_suppkey % 4 > 0),
 i AS (SELECT p_partkey, (SELECT r_name FROM region WHERE r_regionkey = p_size % 5) AS arch FROM part) SELECT p_partkey AS image, min(s_suppkey) AS builder FROM i LEFT JOIN o ON r_name = arch GROUP BY 1""")
def builder_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first worker, by id, that is online, free and of the image's architecture."""
    first = fleet(spark, sf_dir).filter("online AND slots > 0").groupBy("arch").agg(F.min("worker").alias("builder"))
    region = load(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("arch"))
    images = load(spark, sf_dir, "part").join(region, F.col("p_size") % 5 == F.col("r_regionkey"), "left")
    return images.join(first, "arch", "left").select(F.col("p_partkey").alias("image"), "builder")


@query(f"""WITH {TASKS}, r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT project AS p, worktree AS w, event_type AS e, min(id) AS first_ok FROM tasks WHERE status = 'done' AND result_kind IN ('success', 'compile_error') GROUP BY 1, 2, 3)
 SELECT id, CASE WHEN k < 3 THEN 'invalid' WHEN k % 17 = 0 THEN 'unapproved' WHEN n IS NULL THEN 'needs_blobs' WHEN first_ok < id AND k % 2 = 0 THEN 'cache_hit' WHEN status = 'running' THEN 'subscribed' ELSE 'queued' END AS admission
 FROM tasks LEFT JOIN r ON l_orderkey = id LEFT JOIN c ON project = p AND worktree = w AND event_type = e""")
def admission_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a submitted task, by the first rung that holds: validity, approval, blobs, cache, a running twin, the queue."""
    t = tasks(spark, sf_dir)
    key = ["project", "worktree", "event_type"]
    done = t.filter("status = 'done' AND result_kind IN ('success', 'compile_error')").groupBy(*key).agg(F.min("id").alias("first_ok"))
    refs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    rung = (
        F.when(F.col("k") < 3, "invalid").when(F.col("k") % 17 == 0, "unapproved").when(F.col("n").isNull(), "needs_blobs")
        .when((F.col("first_ok") < F.col("id")) & (F.col("k") % 2 == 0), "cache_hit").when(F.col("status") == "running", "subscribed").otherwise("queued")
    )
    return t.join(refs, "id", "left").join(done, key, "left").select("id", rung.alias("admission"))


@query(f"""WITH {TASKS}, a AS (SELECT *, row_number() OVER (PARTITION BY project, worktree ORDER BY at_us, id) AS attempt FROM tasks WHERE status = 'failed') SELECT id, attempt, attempt < 3 AND result_kind = 'infra_error' AS retry FROM a""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures for the fleet's fault are tried again, elsewhere, until the third attempt."""
    attempt = F.row_number().over(Window.partitionBy("project", "worktree").orderBy("at_us", "id"))
    return tasks(spark, sf_dir).filter("status = 'failed'").withColumn("attempt", attempt).select("id", "attempt", ((F.col("attempt") < 3) & (F.col("result_kind") == "infra_error")).alias("retry"))


@query(f"""WITH {TASKS}, f AS (SELECT project, row_number() OVER (ORDER BY min((at_us, id))) AS n FROM tasks WHERE event_type = 'signup' GROUP BY 1) SELECT f.project, n <= 64 AS admitted,
 coalesce((SELECT arg_max(CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'rejected' END, (at_us, id)) FROM tasks t WHERE t.project = f.project AND t.event_type = 'purchase'), 'pending') AS decision FROM f""")
def approval_queue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their latest decision, which asking again never changes; new ones are taken in the order in which they are first made, up to a cap."""
    t = tasks(spark, sf_dir)
    asked = t.filter("event_type = 'signup'").groupBy("project").agg(F.min(F.struct("at_us", "id")).alias("since"))
    decided = t.filter("event_type = 'purchase'").groupBy("project").agg(F.max_by(F.when(F.col("k") % 2 == 0, "approved").otherwise("rejected"), F.struct("at_us", "id")).alias("decision"))
    # the cap's last member is one value, so the requests needn't be ranked in one place
    last = asked.orderBy("since").limit(64).agg(F.max("since").alias("last")).scalar()
    return asked.join(decided, "project", "left").select("project", (F.col("since") <= last).alias("admitted"), F.coalesce("decision", F.lit("pending")).alias("decision"))
