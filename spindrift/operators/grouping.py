"""Groups: components of linked tracks, their type, members, best member and proposed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import display_title, filename, holds
from ..tables import HOT, ensure_checkpoints, rank_within

SEVERITY = ("EXACT_HASH", "EXACT_AUDIO", "ACOUSTIC_DUPLICATE", "POSSIBLE_DUPLICATE", "LOW_CONFIDENCE_REVIEW")
REVIEWED = ("POSSIBLE_DUPLICATE", "LOW_CONFIDENCE_REVIEW")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """node, label: the smallest node each node reaches. Minimum labels along edges, then a jump to the label's own label, checkpointed per round."""
    ensure_checkpoints(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    state = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node").checkpoint()
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = state.join(near, state.node == near.u).select("node", "label", F.least("label", "near").alias("low"))
        # the label of the present label falls too, which joins whole trees at once
        offers = low.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("label").alias("node"), "low"))).alias("o")).select("o.*")
        best = offers.groupBy("node").agg(F.min("low").alias("low"))
        jump = best.join(best.select(F.col("node").alias("low"), F.col("low").alias("further")), "low").select("node", F.least("low", "further").alias("label"))
        after = jump.checkpoint()
        changed = after.join(state.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        state = after
        if not changed:
            return state
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def severity(c: str) -> Column:
    out = F.lit(-1)
    for i, t in enumerate(SEVERITY):
        out = F.when(F.col(c) == t, i).otherwise(out)
    return out


def best_order() -> list[Column]:
    return [F.desc_nulls_last("quality_score"), F.desc_nulls_last("bitrate"), F.desc_nulls_last("filesize"), F.asc("filepath"), F.asc("id")]


def _rank_keys() -> Column:
    """The same order as a value whose maximum is the best: for max_by, which pre-aggregates."""
    return F.struct(F.coalesce("quality_score", F.lit(float("-inf"))), F.coalesce("bitrate", F.lit(-1)), F.coalesce("filesize", F.lit(-1)))


def groups(edges: DataFrame, tracks: DataFrame, a: str = "id_a", b: str = "id_b", key: str = "id", *, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of the linking edges.

    edges: the two ends, classification, confidence, requires_manual_review. tracks: one row per ``key``.
    groups: label, members, primary_type (the weakest edge), requires_manual_review, best_track_path, average_similarity (the
    highest confidence, as in the original), space_saving_bytes. members: label, key, filepath, rank, action.
    A member without a row in tracks is left out; a group needs two members. Groups of more than ``hot`` members are ranked in several tasks.
    """
    links = edges.filter(F.col("classification").isin(*SEVERITY))
    label = components(links, a, b)
    listed = label.join(tracks, label.node == tracks[key]).select("label", *[tracks[c] for c in dict.fromkeys((key, "id", "filepath", "filesize", "quality_score", "bitrate"))])
    sizes = listed.groupBy("label").agg(F.count("*").alias("members")).filter("members >= 2")
    typed = links.join(label.select(F.col("node").alias(a), "label"), a).groupBy("label").agg(
        F.max(severity("classification")).alias("worst"), F.bool_or(F.col("requires_manual_review") | F.col("classification").isin(*REVIEWED)).alias("requires_manual_review"), F.max("confidence").alias("average_similarity")
    )
    typed = typed.join(sizes, "label").withColumn("primary_type", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("worst") + 1)).drop("worst")
    members = rank_within(listed.join(typed.select("label", "requires_manual_review"), "label"), "label", best_order(), hot, label)
    members = members.withColumn("action", F.when(F.col("requires_manual_review"), "UNSET").when(F.col("rank") == 1, "KEEP").otherwise("DELETE"))
    totals = members.groupBy("label").agg(
        F.max(F.when(F.col("rank") == 1, F.col("filepath"))).alias("best_track_path"), F.max(F.when(F.col("rank") == 1, F.col("quality_score"))).alias("best_score"),
        F.coalesce(F.sum(F.when(F.col("action") == "DELETE", F.col("filesize"))), F.lit(0)).cast("bigint").alias("space_saving_bytes"),
    )
    out = typed.join(totals, "label").withColumn("best_track_reason", F.format_string("best_quality %.0f", F.bround(F.coalesce("best_score", F.lit(0.0)), 0))).drop("best_score")
    return out, members.select("label", *dict.fromkeys((key, "filepath")), "filesize", "rank", "action")


def numbered(groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id 'group_001'... in the order of each group's first path.

    The order is global but no task sees all groups: they are range-partitioned by first path, counted per partition, and numbered inside each
    from where the partitions before it end. Only one count per partition is summed up.
    """
    ensure_checkpoints(groups.sparkSession)
    first = members.groupBy("label").agg(F.min("filepath").alias("first_path"))
    placed = groups.join(first, "label").repartitionByRange("first_path", "label").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("first_path", "label")) + F.col("before")
    return placed.join(offset, "part").withColumn("group_id", F.format_string("group_%03d", n)).drop("part", "before", "first_path")


def prune(groups: DataFrame, members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Groups of an earlier session against the present library.

    groups: group_id, primary_type, best_track_path, requires_manual_review. members: group_id, filepath, action. Members
    without a file and repeated ones go; groups left with fewer than two go. POSSIBLE and LOW groups always need review.
    A best track that is no member gives way to the best by quality, bitrate, size. In review groups DELETE becomes UNSET,
    in the others the best becomes KEEP. Savings are recomputed. Result per group: group_id, primary_type, members, best_track_path,
    best_changed, requires_manual_review, space_saving_bytes.
    """
    m = members.filter("group_id IS NOT NULL AND filepath IS NOT NULL").groupBy("group_id", "filepath").agg(F.max("action").alias("action"))
    live = m.join(tracks.select("filepath", "filesize", "quality_score", "bitrate", "id"), "filepath")
    g = groups.select("group_id", "primary_type", F.col("best_track_path").alias("was"), (F.coalesce("requires_manual_review", F.lit(False)) | F.coalesce(F.col("primary_type").isin(*REVIEWED), F.lit(False))).alias("requires_manual_review"))
    j = live.join(g, "group_id")
    top = F.max(F.struct(_rank_keys().alias("k"), "filepath"))
    agg = j.groupBy("group_id").agg(F.count("*").alias("members"), F.bool_or(F.coalesce(F.col("filepath") == F.col("was"), F.lit(False))).alias("kept"), top.alias("top"), F.first("primary_type").alias("primary_type"), F.first("was").alias("was"), F.first("requires_manual_review").alias("requires_manual_review")).filter("members >= 2")
    # among equals the lowest path wins
    agg = agg.withColumn("k", F.col("top.k"))
    lowest = j.join(agg.select("group_id", "k"), "group_id").filter(_rank_keys() == F.col("k")).groupBy("group_id").agg(F.min("filepath").alias("best_now"))
    agg = agg.join(lowest, "group_id").withColumn("best_track_path", F.when(F.col("kept"), F.col("was")).otherwise(F.col("best_now")))
    acted = j.select("group_id", "filepath", "filesize", "action").join(agg.select("group_id", "best_track_path", "requires_manual_review"), "group_id")
    action = F.when(F.col("requires_manual_review") & (F.col("action") == "DELETE"), "UNSET").when(~F.col("requires_manual_review") & (F.col("filepath") == F.col("best_track_path")), "KEEP").otherwise(F.col("action"))
    saving = acted.withColumn("action", action).groupBy("group_id").agg(F.coalesce(F.sum(F.when(F.col("action") == "DELETE", F.col("filesize"))), F.lit(0)).cast("bigint").alias("space_saving_bytes"))
    return agg.join(saving, "group_id").select("group_id", "primary_type", "members", "best_track_path", (~F.col("kept")).alias("best_changed"), "requires_manual_review", "space_saving_bytes")


def recommend(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Actions the recommendations would set: KEEP for the best, DELETE for the rest of groups that need no review and have a best track."""
    g = groups.filter(~F.coalesce("requires_manual_review", F.lit(False)) & (F.coalesce("best_track_path", F.lit("")) != "")).select("group_id", "best_track_path")
    new = F.when(F.col("filepath") == F.col("best_track_path"), "KEEP").otherwise("DELETE")
    return members.filter("filepath IS NOT NULL").join(g, "group_id").select("group_id", "filepath", "action", new.alias("new_action")).distinct()


def toggled(action: str = "action") -> Column:
    return F.when(F.col(action) == "DELETE", "KEEP").otherwise("DELETE")


def summary(groups: DataFrame) -> DataFrame:
    """Totals by kind; groups of low confidence count in the total only."""
    t = F.col("primary_type")
    return groups.agg(F.count("*").alias("total_groups"), F.count_if(t.isin("EXACT_HASH", "EXACT_AUDIO")).alias("exact_groups"), F.count_if(t == "ACOUSTIC_DUPLICATE").alias("acoustic_groups"), F.count_if(t == "POSSIBLE_DUPLICATE").alias("possible_groups"), F.coalesce(F.sum("space_saving_bytes"), F.lit(0)).cast("bigint").alias("total_saving"))


def best_after_removal(groups: DataFrame, members: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups after files have gone: group_id, best_track_path, best_changed, members left. A best track that went gives way to the first remaining member by path."""
    left = members.filter("group_id IS NOT NULL AND filepath IS NOT NULL").select("group_id", "filepath").distinct().join(removed.select("filepath").distinct(), "filepath", "left_anti")
    there = left.join(groups.select("group_id", "best_track_path"), "group_id").groupBy("group_id").agg(
        F.count("*").alias("members"), F.min("filepath").alias("next"), F.max("best_track_path").alias("was"), F.bool_or(F.coalesce(F.col("filepath") == F.col("best_track_path"), F.lit(False))).alias("kept")
    )
    return there.select("group_id", F.when(F.col("kept"), F.col("was")).otherwise(F.col("next")).alias("best_track_path"), (~F.col("kept")).alias("best_changed"), "members")


def search(groups: DataFrame, members: DataFrame, tracks: DataFrame, text: str) -> DataFrame:
    """Groups of which any member's name, title, artist, album or format holds the text."""
    hit = holds(text, filename("filepath"), F.col("title"), F.col("artist"), F.col("album"), F.col("format"))
    found = members.select("group_id", "filepath").join(tracks.filter(hit).select("filepath"), "filepath", "left_semi")
    return groups.join(found.select("group_id").distinct(), "group_id", "left_semi") if text.strip() else groups


def ordered(groups: DataFrame, members: DataFrame, tracks: DataFrame, mode: str) -> DataFrame:
    """Groups in one of four orders: saving, similarity, size (high to low) or title (of the first member by path, low to high); ties by group_id."""
    if mode in ("saving", "similarity"):
        return groups.orderBy(F.desc_nulls_last({"saving": "space_saving_bytes", "similarity": "average_similarity"}[mode]), "group_id")
    known = members.filter("filepath IS NOT NULL").select("group_id", "filepath").distinct().join(tracks.select("filepath", F.lower(display_title()).alias("shown"), "filesize"), "filepath")
    facts = known.groupBy("group_id").agg(F.min_by("shown", "filepath").alias("first_title"), F.sum("filesize").alias("total_size"))
    return groups.join(facts, "group_id", "left").orderBy(F.asc_nulls_last("first_title") if mode == "title" else F.desc_nulls_last("total_size"), "group_id")


def totals(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: groups, their members, and the space to be saved."""
    m = members.filter("group_id IS NOT NULL AND filepath IS NOT NULL").select("group_id", "filepath").distinct().join(groups.select("group_id"), "group_id", "left_semi")
    rows = groups.select(F.lit(1).alias("g"), F.lit(0).alias("t"), F.col("space_saving_bytes").alias("s")).unionByName(m.select(F.lit(0).alias("g"), F.lit(1).alias("t"), F.lit(None).cast("bigint").alias("s")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(total("g").alias("groups"), total("t").alias("tracks"), total("s").alias("saving"))


def tab(groups: DataFrame, name: str) -> DataFrame:
    kinds = {"exact": ("EXACT_HASH", "EXACT_AUDIO"), "acoustic": ("ACOUSTIC_DUPLICATE",), "possible": ("POSSIBLE_DUPLICATE",)}
    return groups if name == "all" else groups.filter(F.col("primary_type").isin(*kinds[name]))
