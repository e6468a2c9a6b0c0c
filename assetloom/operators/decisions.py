"""Keep and delete decisions, pending lists and the decision log."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import discard, materialize
from assetloom.operators.positions import with_position

DEFAULT_THRESHOLD = 0.4
UNDO_DEPTH = 10


def cluster_split(df: DataFrame) -> DataFrame:
    """``df`` with is_multi: whether its cluster has more than one image."""
    return df.withColumn("is_multi", F.count(F.lit(1)).over(W.partitionBy("cluster_id")) > 1)


def default_keeps(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("keep", F.col("rank") == 1)


def singleton_decisions(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return df.withColumn("keep", F.col("score") >= F.lit(threshold))


def keep_all(df: DataFrame) -> DataFrame:
    return df.withColumn("keep", F.lit(True))


def select_bad(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The threshold's decisions again, whatever was toggled before."""
    return singleton_decisions(df, threshold)


def singles_worst_first(singles: DataFrame) -> DataFrame:
    """``singles`` (asset_id, score, ...) with position: the lowest score first, then by id."""
    return with_position(singles, ["score", "asset_id"])


def threshold_sweep(df: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, n_keep) for thresholds 0, 1/steps, ... 1. Scores are counted by the step they reach, so the sweep
    reads them once and joins nothing."""
    reached = F.floor(F.col("score") * steps + 1e-9)
    counts = df.where(reached >= 0).groupBy(F.least(reached, F.lit(steps)).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    filled = every.join(counts, "step", "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy(F.desc("step")))  # one row per step
    return filled.select((F.col("step") / steps).alias("threshold"), above.alias("n_keep"))


def quality_bands(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, width: float = 0.1) -> DataFrame:
    """(band, n): bad, borderline, good; empty bands are absent."""
    band = F.when(F.col("score") < threshold, "bad").when(F.col("score") < threshold + width, "borderline").otherwise("good")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def score_delta(df: DataFrame) -> DataFrame:
    return df.withColumn("delta", F.col("score") - F.max("score").over(W.partitionBy("cluster_id")))


def toggle_overrides(df: DataFrame, toggles: DataFrame) -> DataFrame:
    """``df`` with keep flipped for each odd number of ``toggles`` (path, n_toggles)."""
    joined = df.join(toggles, "path", "left")
    return joined.withColumn("keep", F.col("keep") != (F.coalesce("n_toggles", F.lit(0)) % 2 == 1)).drop("n_toggles")


def keep_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster_id").agg(F.count_if("keep").alias("n_keep"), F.count_if(~F.col("keep")).alias("n_delete"))


def review_progress(order: DataFrame) -> DataFrame:
    """position and total over the cluster order."""
    return order.crossJoin(F.broadcast(order.agg(F.count(F.lit(1)).alias("total"))))


def state_summary(df: DataFrame, pending: DataFrame, threshold: float = DEFAULT_THRESHOLD, stack: DataFrame | None = None) -> DataFrame:
    """One row: clusters of several images, singletons, pending paths, threshold, whether the undo ``stack`` has an entry."""
    sizes = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.agg(F.count_if(F.col("n") > 1).alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    counts = counts.crossJoin(F.broadcast(pending.agg(F.count(F.lit(1)).alias("n_pending")))).withColumn("threshold", F.lit(float(threshold)))
    if stack is None:
        return counts.withColumn("undo_available", F.lit(False))
    return counts.crossJoin(F.broadcast(stack.agg((F.count(F.lit(1)) > 0).alias("undo_available"))))


def pending_append(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """The list after a batch is appended: paths on it already are skipped, repeats inside the batch stay."""
    return pending.select("path").unionByName(new_paths(pending, batch))


def new_paths(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """What an append adds; its count is the number reported."""
    return batch.select("path").join(pending.select("path"), "path", "left_anti")


def pending_remove(pending: DataFrame, paths: DataFrame) -> DataFrame:
    """The list without ``paths``: also a restore, which puts nothing back into the results."""
    return pending.select("path").join(paths.select("path"), "path", "left_anti")


def removed_paths(pending: DataFrame, paths: DataFrame) -> DataFrame:
    """What a removal takes off, repeated lines each; its count is the number reported."""
    return pending.select("path").join(paths.select("path").distinct(), "path", "left_semi")


def change_counts(pending: DataFrame, appended: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: n_new of an append and n_removed of a removal from the same list."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(new_paths(pending, appended), "n_new").crossJoin(F.broadcast(count(removed_paths(pending, removed), "n_removed")))


def confirm_batch(results: DataFrame, pending: DataFrame, delete_paths: DataFrame, all_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results without the confirmed images, pending list with the delete paths). Removed are ``all_paths`` if there are
    any, else the delete paths; without either the results stay as they are."""
    from assetloom.operators.ranking import rerank_after_removal

    removed = delete_paths if all_paths is None or all_paths.isEmpty() else all_paths
    after = results if removed.isEmpty() else rerank_after_removal(results, removed)
    return after, pending_append(pending, delete_paths)


def latest_decision(log: DataFrame, key: str = "path") -> DataFrame:
    """(key, op, seq): the last mark or restore of each key."""
    last = log.where(F.col("op").isin("mark", "restore")).groupBy(key).agg(F.max_by(F.struct("op", "seq"), "seq").alias("l"))
    return last.select(key, "l.op", "l.seq")


def _pushes(log: DataFrame) -> Column:
    """Whether a confirm leaves an undo entry: it does if it removes anything."""
    paths = ["delete_paths", *(c for c in ("all_paths",) if c in log.columns)]
    some = [F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())) > 0, F.lit(False)) for c in paths]
    return (F.col("op") == "confirm") & reduce(lambda a, b: a | b, some)


def _walk(depth: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walks the sorted rows of one partition. An entry that the walk has not seen pushed is named by its place in the
        stack before: -1 for the top, -2 below it. kind 0: an undo (seq) takes back ``entry``; kind 1: what is on the
        stack (seq: its place) after the rows of a project, whose first is ``first``."""
        project, first, stack, part = None, 0, [], 0
        rows: list[tuple] = []

        def close() -> None:
            rows.extend((1, project, k, e, first, part) for k, e in enumerate(stack))

        for pdf in batches:
            for p, seq, push, at in zip(pdf["project"].tolist(), pdf["seq"].tolist(), pdf["push"].tolist(), pdf["part"].tolist()):
                if project is None or p != project:
                    if project is not None:
                        close()
                    project, first, stack, part = p, seq, [-k for k in range(depth, 0, -1)], at
                if push:
                    stack = [*stack, seq][-depth:]
                elif stack:
                    rows.append((0, p, seq, stack.pop(), first, part))
            yield pd.DataFrame(rows, columns=["kind", "project", "seq", "entry", "first", "part"])
            rows = []
        if project is not None:
            close()
        yield pd.DataFrame(rows, columns=["kind", "project", "seq", "entry", "first", "part"])

    return of


def _chain(depth: int, schema: list[str]):
    def stacks(parts: list[tuple[int, list[int]]]) -> list[tuple]:
        """One project: the stack before each of its parts, from the stacks that the parts leave."""
        stack, out = [None] * depth, []
        for part, entries in parts:
            out += [(part, -k, stack[-k]) for k in range(1, depth + 1) if stack[-k] is not None]
            now = [e if e >= 0 else stack[e] for e in entries]
            stack = [None] * (depth - len(now)) + now
        return out + [(-1, -k, stack[-k]) for k in range(1, depth + 1) if stack[-k] is not None]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole projects in rows sorted by project, part and place; very many small ones share a batch."""
        project, parts, rows = None, [], []
        for pdf in batches:
            for p, part, entry in zip(pdf["project"].tolist(), pdf["part"].tolist(), pdf["entry"].tolist()):
                if project is None or p != project:
                    rows.extend((project, *r) for r in (stacks(parts) if parts else []))
                    project, parts = p, []
                if not parts or parts[-1][0] != part:
                    parts.append((part, []))
                parts[-1][1].append(entry)
            yield pd.DataFrame(rows, columns=schema)
            rows = []
        if parts:
            yield pd.DataFrame([(project, *r) for r in stacks(parts)], columns=schema)

    return of


def match_undos(log: DataFrame, depth: int = UNDO_DEPTH) -> tuple[DataFrame, DataFrame]:
    """((project, seq, confirm): the confirm that each undo takes back, (project, confirm): what can still be undone) of a log
    (project, seq, op, delete_paths[, all_paths]), seq 0 or more and unique in a project. An undo takes back the last entry of a stack of
    ``depth``. The log is sorted and walked part by part, a project of any length over several of them; a part hands on
    at most ``depth`` entries of each project, and those alone are put in order by project."""
    kind = dict(log.dtypes)["project"]
    moves = log.where(_pushes(log) | (F.col("op") == "undo")).select("project", "seq", (F.col("op") == "confirm").alias("push"))
    moves = moves.repartitionByRange("project", "seq").sortWithinPartitions("project", "seq").withColumn("part", F.spark_partition_id())
    walked = materialize(moves.mapInPandas(_walk(depth), f"kind int, project {kind}, seq long, entry long, first long, part int"), "undo-walk")
    # Parts are numbered in the order of the range.
    handed_on = walked.where("kind = 1").select("project", "part", "seq", "entry").repartition("project").sortWithinPartitions("project", "part", "seq")
    known = handed_on.mapInPandas(_chain(depth, ["project", "part", "entry", "confirm"]), f"project {kind}, part int, entry long, confirm long")
    known = materialize(known, "undo-chain")
    undos = walked.where("kind = 0")
    own = undos.where("entry >= 0").select("project", "seq", F.col("entry").alias("confirm"))
    handed = undos.where("entry < 0").join(known, ["project", "part", "entry"]).select("project", "seq", "confirm")
    return own.unionByName(handed), known.where("part = -1").select("project", "confirm")


def undo_fold(log: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """(project, path): what is pending after a log of confirm, undo and restore. An undo takes back the last confirm not
    undone yet, if it is among the last ``depth``, and drops its paths even if they were pending before. The last event
    of a path decides, so paths are folded by one aggregation."""
    last = _path_events(log, depth).groupBy("project", "path").agg(F.max_by("there", "at").alias("there"))
    return last.where("there").select("project", "path")


def _path_events(log: DataFrame, depth: int) -> DataFrame:
    """(project, path, at, there): at which events a path was put on the pending list or taken off."""
    undone, _ = match_undos(log, depth)
    added = log.where("op = 'confirm'").select("project", F.col("seq").alias("at"), "delete_paths")
    dropped = undone.join(added.withColumnRenamed("at", "confirm"), ["project", "confirm"]).select("project", F.col("seq").alias("at"), "delete_paths")
    restored = log.where("op = 'restore'").select("project", F.col("seq").alias("at"), "delete_paths")
    events = added.withColumn("there", F.lit(True)).unionByName(dropped.unionByName(restored).withColumn("there", F.lit(False)))
    return events.select("project", F.explode(F.array_distinct("delete_paths")).alias("path"), "at", "there")


def _removes(log: DataFrame) -> Column:
    """The paths that a confirm takes out of the results: all of them where it names any, else those to delete."""
    return F.when(F.size("all_paths") > 0, F.col("all_paths")).otherwise(F.col("delete_paths")) if "all_paths" in log.columns else F.col("delete_paths")


def removal_intervals(log: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """(project, path, since, until): a confirm at ``since`` took the path out of the results of its project, the undo of that
    confirm at ``until`` brought it back; null if none did."""
    undone, _ = match_undos(log, depth)
    back = undone.select("project", F.col("confirm").alias("since"), F.col("seq").alias("until"))
    taken = log.where("op = 'confirm'").select("project", F.col("seq").alias("since"), F.explode(F.array_distinct(_removes(log))).alias("path"))
    return taken.where("path is not null").join(back, ["project", "since"], "left").select("project", "path", "since", "until")


def results_as_of(results: DataFrame, log: DataFrame, asked: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """The results of many projects as they were after the events up to ``seq``, for each asked (project, seq): (project, seq,
    cluster_id, cluster_score, path, score, rank, best_image). results: (project, cluster_id, cluster_score, path, score, rank).
    The log is matched once, whatever is asked."""
    from assetloom.operators.ranking import rerank_after_removal

    intervals = removal_intervals(log, depth)
    out = (F.col("since") <= F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq")))
    gone = asked.distinct().join(intervals, "project").where(out).select("project", "seq", "path").distinct()
    return rerank_after_removal(results.join(asked.distinct(), "project"), gone, by=["project", "seq"])


def pending_as_of(log: DataFrame, asked: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """(project, seq, path): what was pending after the events up to ``seq``, for each asked (project, seq). A path's state
    holds from one of its events to the next."""
    events = _path_events(log, depth)
    until = F.lead("at").over(W.partitionBy("project", "path").orderBy("at"))
    spans = events.withColumn("until", until).where("there")
    held = (F.col("at") <= F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq")))
    return asked.distinct().join(spans, "project").where(held).select("project", "seq", "path")


def results_after(results: DataFrame, log: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """Results after the whole log: an undo brings back what its confirm removed, so removed are the paths of the confirms
    that stand, each in its own project. A restore brings nothing back. Results without a project column are those of one
    project, and the log may hold no other."""
    from assetloom.operators.ranking import rerank_after_removal

    gone = removal_intervals(log, depth).where("until is null").select("project", "path").distinct()
    if "project" in results.columns:
        return rerank_after_removal(results, gone, by=["project"])
    if log.select("project").distinct().limit(2).count() > 1:
        raise ValueError("a log of several projects needs results with their project")
    return rerank_after_removal(results, gone.select("path"))


def auto_keep_best(ranked: DataFrame, least: float) -> DataFrame:
    """(cluster_id, path, keep) of the clusters whose best score reaches ``least``: rank 1 is kept."""
    best = F.max("score").over(W.partitionBy("cluster_id"))
    return ranked.withColumn("__best", best).where(F.col("__best") >= least).select("cluster_id", "path", (F.col("rank") == 1).alias("keep"))


def matchup_pairs(ranked: DataFrame, adjacent: bool = True) -> DataFrame:
    """(cluster_id, path_a, path_b): images to compare. Neighbours in rank by default; all pairs of a cluster on demand."""
    a = ranked.select("cluster_id", F.col("rank").alias("ra"), F.col("path").alias("path_a"), F.col("asset_id").alias("a"))
    if adjacent:
        order = W.partitionBy("cluster_id").orderBy("ra")
        return a.select("cluster_id", "a", F.lead("a").over(order).alias("b"), "path_a", F.lead("path_a").over(order).alias("path_b")).where("b is not null")
    b = ranked.select("cluster_id", F.col("rank").alias("rb"), F.col("path").alias("path_b"), F.col("asset_id").alias("b"))
    return a.join(b, "cluster_id").where("ra < rb").select("cluster_id", "a", "b", "path_a", "path_b")


def matchup_wins(outcomes: DataFrame) -> DataFrame:
    """(winner, n_wins) from rows with a winner."""
    return outcomes.groupBy("winner").agg(F.count(F.lit(1)).alias("n_wins"))


def _strengths_of(prior: float, tolerance: float, max_rounds: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """One cluster: the same rounds over arrays."""
        items, codes = np.unique(pdf["item"].to_numpy(), return_inverse=True)
        other, n = np.searchsorted(items, pdf["other"].to_numpy()), pdf["n"].to_numpy(np.float64)
        wins, s = np.bincount(codes, pdf["won"], len(items)), np.ones(len(items))
        for _ in range(max_rounds):
            before, share = s, np.bincount(codes, n / (s[codes] + s[other]), len(items))
            s = (wins + prior) / (share + 2 * prior / (s + 1))
            s = s * np.exp(-(2 * s / (s + 1) - 1).sum() / (2 * s / (s + 1) ** 2).sum())
            if np.abs(s / before - 1).max() <= tolerance:
                break
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "item": items, "strength": s})

    return of


def _strength_rounds(pairs: DataFrame, prior: float, tolerance: float, max_rounds: int) -> DataFrame:
    """(cluster_id, item, strength) by written rounds over the pairs (cluster_id, item, other, n, won)."""
    s = F.col("strength")
    now = pairs.groupBy("cluster_id", "item").agg(F.sum("won").alias("n_wins")).withColumns({"strength": F.lit(1e0), "moved": F.lit(0e0)})
    now = materialize(now, "matchup-strength")
    for _ in range(max_rounds):
        other = now.select("cluster_id", F.col("item").alias("other"), s.alias("against"))
        met = pairs.join(now.select("cluster_id", "item", "strength"), ["cluster_id", "item"]).join(other, ["cluster_id", "other"])
        share = met.groupBy("cluster_id", "item").agg(F.sum(F.col("n") / (s + F.col("against"))).alias("share"))
        updated = (F.col("n_wins") + prior) / (F.col("share") + 2 * prior / (s + 1e0))
        step = materialize(now.join(share, ["cluster_id", "item"]).select("cluster_id", "item", "n_wins", s.alias("before"), updated.alias("strength")), "matchup-update")
        gap, slope = F.sum(2 * s / (s + 1e0) - 1e0), F.sum(2 * s / ((s + 1e0) * (s + 1e0)))
        scale = step.groupBy("cluster_id").agg(F.exp(-gap / slope).alias("scale"))
        scaled = s * F.col("scale")
        after = materialize(step.join(scale, "cluster_id").select("cluster_id", "item", "n_wins", scaled.alias("strength"), F.abs(scaled / F.col("before") - 1e0).alias("moved")), "matchup-strength")
        for table in (now, step):
            discard(table)
        now = after
        if (after.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return now.select("cluster_id", "item", "strength")


def matchup_strengths(outcomes: DataFrame, prior: float = 0.5, tolerance: float = 1e-7, max_rounds: int = 500, max_local: int = 200_000) -> DataFrame:
    """(cluster_id, item, n_games, n_wins, strength) from games (cluster_id, winner, loser): the Bradley-Terry strengths, by
    which x beats y with x / (x + y). Every item also wins and loses ``prior`` games against one of strength 1, so there is
    exactly one solution, whoever has met whom.

    A round is the minorise-maximise update of every item, and a step of the common scale of each cluster, which the
    update alone would move by little: the games between items cancel out of the sum of all conditions, and what is left fixes
    the scale. Rounds go on until no strength moves by more than ``tolerance`` of itself, or ``max_rounds`` were run. Games
    are counted by pair first. A cluster of up to ``max_local`` pairs is solved in a task, larger ones by distributed rounds."""
    games = outcomes.where("winner is not null and loser is not null and winner <> loser")
    ends = F.explode(F.array(F.struct(F.col("winner").alias("item"), F.col("loser").alias("other"), F.lit(1).alias("won")), F.struct(F.col("loser").alias("item"), F.col("winner").alias("other"), F.lit(0).alias("won"))))
    pairs = games.select("cluster_id", ends.alias("g")).groupBy("cluster_id", "g.item", "g.other").agg(F.count(F.lit(1)).alias("n"), F.sum("g.won").alias("won"))
    pairs = materialize(pairs, "matchup-pairs")
    kinds = dict(pairs.dtypes)
    large = pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max_local).select("cluster_id")
    local = pairs.join(large, "cluster_id", "left_anti").groupBy("cluster_id").applyInPandas(_strengths_of(prior, tolerance, max_rounds), f"cluster_id {kinds['cluster_id']}, item {kinds['item']}, strength double")
    rest = pairs.join(large, "cluster_id", "left_semi")
    found = local if rest.isEmpty() else local.unionByName(_strength_rounds(materialize(rest, "matchup-rest"), prior, tolerance, max_rounds))
    totals = pairs.groupBy("cluster_id", "item").agg(F.sum("n").alias("n_games"), F.sum("won").alias("n_wins"))
    return totals.join(found, ["cluster_id", "item"])
