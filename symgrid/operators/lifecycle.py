"""Snapshots and workspaces: listing, retention, staleness, impact of changes, choice of a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators.graph import closure
from symgrid.operators.history import merge_bases
from symgrid.schema import RELATIONSHIPS


def list_baselines(parts: DataFrame) -> DataFrame:
    """parts: solution_id, commit_sha, created_at, size_bytes (one row per file). Newest first."""
    return parts.groupBy("solution_id", "commit_sha").agg(F.max("created_at").alias("created_at"), F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files")).orderBy(F.desc("created_at"), "solution_id", "commit_sha")


def cleanup(baselines: DataFrame, protected: DataFrame, keep: int = 5, before=None) -> DataFrame:
    """baselines: solution_id, commit_sha, created_at, size_bytes; protected: commit_sha. Adds `removed`: not
    protected, older than `before` (if given), and not among the newest `keep` of its solution, in
    which protected ones count."""
    w = Window.partitionBy(F.lower(F.coalesce("solution_id", F.lit("")))).orderBy(F.desc("created_at"), "commit_sha")
    own = baselines.withColumn("__n", F.row_number().over(w))
    safe = protected.select(F.lower("commit_sha").alias("__c")).distinct().withColumn("__safe", F.lit(True))
    own = own.withColumn("__c", F.lower("commit_sha")).join(safe, "__c", "left")
    gone = (F.col("__n") > keep) & F.col("__safe").isNull()
    if before is not None:
        gone = gone & (F.col("created_at") < F.lit(before))
    return own.withColumn("removed", gone).drop("__n", "__c", "__safe")


def reclaimed(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count_if("removed").alias("n_removed"), F.count_if(~F.col("removed")).alias("n_kept"), F.coalesce(F.sum(F.when(F.col("removed"), F.col("size_bytes"))), F.lit(0)).alias("bytes_reclaimed"))


def workspaces(registry: DataFrame, heads: DataFrame) -> DataFrame:
    """registry: workspace_id, repo_id, base_commit, revision; heads: repo_id, head. Adds is_stale."""
    return registry.join(heads, "repo_id", "left").withColumn("is_stale", F.coalesce(F.col("base_commit") != F.col("head"), F.lit(False)))


def changed_files(committed: DataFrame, worktree: DataFrame) -> DataFrame:
    """path, change of a tree diff and a working tree; the working tree wins for a path (any case)."""
    both = committed.select("path", "change", F.lit(1).alias("__r")).unionByName(worktree.select("path", "change", F.lit(0).alias("__r")))
    w = Window.partitionBy(F.lower("path")).orderBy("__r", "path")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__r")


def touched_projects(changes: DataFrame, projects: DataFrame) -> DataFrame:
    """project, path of each change under a project's directory. A path is joined by each of its own
    leading directories, so the join is by equality."""
    p = F.regexp_replace(X.canonical_path(F.col("path")), "/[^/]*$", "")
    parts = F.split(F.lower(p), "/")
    dirs = changes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    return dirs.join(projects.select("project", F.lower("dir").alias("dir")), "dir").select("project", "path").distinct()


# Files that the build of every project reads.
GLOBAL_INPUTS = ["directory.build.props", "directory.build.targets", "directory.packages.props", "nuget.config", "global.json", ".editorconfig"]


def impact(changes: DataFrame, projects: DataFrame, depends: DataFrame, members: DataFrame) -> DataFrame:
    """solution: those with a project that changed, or that depends on one (depends: project, on); all if
    a file changed that every build reads."""
    whole = changes.filter(F.lower(F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)).isin(GLOBAL_INPUTS))
    if not whole.isEmpty():
        return members.select("solution").distinct()
    hit = touched_projects(changes, projects).select(F.col("project").alias("node")).distinct()
    reach = closure(depends.select(F.col("on").alias("node"), F.col("project").alias("next")), hit)
    return members.join(reach.select(F.col("node").alias("project")).distinct(), "project", "left_semi").select("solution").distinct()


def weighted_inputs(files: DataFrame, project_files: DataFrame, shared: DataFrame) -> DataFrame:
    """path, hash, weight: solution-wide inputs weigh 8, project files 5, sources 1; the heaviest counts."""
    every = shared.select("path", "hash", F.lit(8).alias("weight")).unionByName(project_files.select("path", "hash", F.lit(5).alias("weight"))).unionByName(files.select("path", "hash", F.lit(1).alias("weight")))
    best = every.groupBy(F.lower("path").alias("k")).agg(F.max_by(F.struct("path", "hash", "weight"), F.struct("weight", "path")).alias("b"))
    return best.select("b.path", "b.hash", "b.weight")


def similarity(target: DataFrame, candidates: DataFrame) -> DataFrame:
    """target: path, hash, weight; candidates: the same by candidate. Share of the weight (the greater of
    both sides) that lies on paths with equal hashes; 0 without inputs."""
    t = target.select(F.lower("path").alias("k"), F.col("hash").alias("th"), F.col("weight").alias("tw"))
    c = candidates.select("candidate", F.lower("path").alias("k"), F.col("hash").alias("ch"), F.col("weight").alias("cw"))
    both = c.join(t, "k").select("candidate", F.greatest("tw", "cw").alias("w"), "tw", "cw", (F.col("th") == F.col("ch")).alias("same"))
    whole = t.agg(F.coalesce(F.sum("tw"), F.lit(0)).alias("all_t")).withColumn("one", F.lit(1))
    mine = c.groupBy("candidate").agg(F.sum("cw").alias("all_c")).withColumn("one", F.lit(1))
    # The union's weight is both sides' weights less, on shared paths, the smaller of the two.
    shared = both.groupBy("candidate").agg(F.sum(F.col("tw") + F.col("cw") - F.col("w")).alias("twice"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0)).alias("equal"))
    out = mine.join(shared, "candidate", "left").join(F.broadcast(whole), "one")  # a single row
    total = F.col("all_t") + F.col("all_c") - F.coalesce("twice", F.lit(0))
    return out.select("candidate", F.when(total == 0, 0.0).otherwise(F.coalesce("equal", F.lit(0)) / total).alias("similarity"))


def best_seed(scored: DataFrame, least: float = 0.6) -> DataFrame:
    """target, candidate, similarity, relationship, changed_projects, published_at. An identical candidate
    wins; else the most similar of at least `least`, then the closer, the less changed, the newer."""
    rank = F.array_position(F.lit(RELATIONSHIPS), F.col("relationship"))
    w = Window.partitionBy("target").orderBy(F.desc(F.col("relationship") == "Identical"), F.desc("similarity"), rank, "changed_projects", F.desc("published_at"), "candidate")
    own = scored.filter((F.col("relationship") == "Identical") | (F.col("similarity") >= least))
    return own.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def visible(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """Rows of the generation that each repository's pointer names, where that generation is Ready."""
    ready = pointers.filter("state = 'Ready'").select("repo_id", "generation")
    return rows.join(ready, ["repo_id", "generation"], "left_semi")


def latest_request(requests: DataFrame) -> DataFrame:
    """Only the last pending request of a repository counts."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("seq"))
    return requests.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def one_target(projects: DataFrame) -> DataFrame:
    """One row per project file: its highest target framework."""
    w = Window.partitionBy("project").orderBy(F.desc("tfm_rank"), "tfm")
    return projects.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


# The states of a rolling index whose last generation can be read.
ROLLING_READABLE = ["UpToDate", "Checking", "Updating", "Stale", "Failed"]


def status(heads: DataFrame, manifests: DataFrame, registry: DataFrame, rolling: DataFrame | None = None) -> DataFrame:
    """repo_id, head, indexed (is the head published), n_snapshots, n_workspaces, n_stale. With rolling indexes
    (repo_id, solution_id, index_state, possibly_stale, updated_at), of a solution the last state counts,
    and there are also n_rolling, the solutions with one; possibly_stale, if any is; and indexed holds
    for a repository with a readable one too. heads may name a solution_id, whose index is then asked for."""
    have = manifests.groupBy("repo_id").agg(F.count_distinct("commit_sha").alias("n_snapshots"))
    at_head = heads.join(manifests.select("repo_id", F.col("commit_sha").alias("head")).distinct(), ["repo_id", "head"], "left_semi").select("repo_id", F.lit(True).alias("indexed")).distinct()
    spaces = workspaces(registry, heads.select("repo_id", "head").distinct()).groupBy("repo_id").agg(F.count("*").alias("n_workspaces"), F.count_if("is_stale").alias("n_stale"))
    out = heads.join(have, "repo_id", "left").join(at_head, "repo_id", "left").join(spaces, "repo_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    columns = ["repo_id", "head", F.coalesce("indexed", F.lit(False)).alias("indexed"), zero("n_snapshots"), zero("n_workspaces"), zero("n_stale")]
    if rolling is None:
        return out.select(*columns)
    last = rolling.groupBy("repo_id", "solution_id").agg(F.max_by(F.struct("index_state", "possibly_stale"), F.struct("updated_at", "index_state")).alias("s"))
    asked = ["repo_id"]
    readable = last.filter(F.col("s.index_state").isin(ROLLING_READABLE))
    if "solution_id" in heads.columns:
        asked, columns = ["repo_id", "solution_id"], [*columns[:1], "solution_id", *columns[1:]]
    readable = readable.select(*asked).distinct().withColumn("readable", F.lit(True))
    said = last.groupBy("repo_id").agg(F.count("*").alias("n_rolling"), F.bool_or("s.possibly_stale").alias("possibly_stale"))
    out = out.join(said, "repo_id", "left").join(readable, asked, "left")
    out = out.withColumn("indexed", F.coalesce("indexed", "readable"))
    return out.select(*columns, zero("n_rolling"), F.coalesce("possibly_stale", F.lit(False)).alias("possibly_stale"))


def seed_candidates(generations: DataFrame, target_compatibility: str, newest: int = 10) -> DataFrame:
    """generations: target, candidate, compatibility, published_at. The newest compatible ones of a target."""
    w = Window.partitionBy("target").orderBy(F.desc("published_at"), "candidate")
    own = generations.filter(F.col("compatibility") == target_compatibility)
    return own.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= newest).drop("__n")


def select_seed(generations: DataFrame, inputs: DataFrame, target_inputs: DataFrame, target_commit: str, compatibility: str, newest: int = 10, least: float = 0.6) -> DataFrame:
    """The snapshot from which a branch's first one starts: at most one row candidate, similarity, exact.

    generations: candidate, target, commit_sha, compatibility, published_at, relationship, changed_projects;
    inputs: candidate, path, hash, weight. A compatible generation of the same commit wins, the newest;
    else, of the `newest` compatible ones, the best of `best_seed`."""
    same = generations.filter((F.col("commit_sha") == target_commit) & (F.col("compatibility") == compatibility))
    exact = same.orderBy(F.desc("published_at"), "candidate").limit(1).select("candidate", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    if not exact.isEmpty():
        return exact
    few = seed_candidates(generations, compatibility, newest)
    scored = few.join(similarity(target_inputs, inputs.join(few.select("candidate"), "candidate", "left_semi")), "candidate")
    return best_seed(scored, least).select("candidate", "similarity", F.lit(False).alias("exact"))


def relationship(parents: DataFrame, candidate: str, head: str) -> str:
    """How a candidate commit lies to a head: Identical, Ancestor, MergeBase (they share one) or Divergent."""
    if candidate == head:
        return "Identical"
    shared = [r["commit_sha"] for r in merge_bases(parents, candidate, head).limit(2).collect()]
    return "Divergent" if not shared else "Ancestor" if candidate in shared else "MergeBase"


def running_savings(calls: DataFrame) -> DataFrame:
    """calls: session, seq, tokens_saved, cost. Adds running totals of both by session."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("total_tokens", F.sum("tokens_saved").over(w)).withColumn("total_cost", F.sum("cost").over(w))


def create_workspace(registry: DataFrame, workspace_id: str, repo_id: str, base_commit: str) -> DataFrame:
    """The registry with a workspace at revision 0; one of that name and repository is an error."""
    if not registry.filter((F.col("workspace_id") == workspace_id) & (F.col("repo_id") == repo_id)).isEmpty():
        raise ValueError(f"INVALID_ARGUMENT: workspace {workspace_id} exists")
    row = registry.sparkSession.createDataFrame([(workspace_id, repo_id, base_commit, 0)], "workspace_id string, repo_id string, base_commit string, revision int")
    return registry.select("workspace_id", "repo_id", "base_commit", "revision").unionByName(row)
