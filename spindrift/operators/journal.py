"""File actions: planned as tables, journaled as appended states, executed by a driver loop that survives a crash."""

from __future__ import annotations

import datetime
import json
import os
import shutil
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN_STATES = ("PENDING", "FS_DONE")
_STATE_ORDER = {"PENDING": 0, "FS_DONE": 1, "COMPLETED": 2, "FAILED": 2, "ABORTED": 2}


def last_states(journal: DataFrame) -> DataFrame:
    """The present state of each operation: its last row by updated_at, a final state before an open one at the same time. Repeated rows count once."""
    order = F.lit(-1)
    for s, n in _STATE_ORDER.items():
        order = F.when(F.col("state") == s, n).otherwise(order)
    row = F.struct("filepath", "action", "target_path", "state", "created_at", "updated_at")
    key = F.struct(F.col("updated_at"), order.alias("o"), F.col("state"))
    return journal.filter("op_id IS NOT NULL").groupBy("op_id").agg(F.max_by(row, key).alias("r")).select("op_id", "r.*")


def pending(journal: DataFrame) -> DataFrame:
    return last_states(journal).filter(F.col("state").isin(*OPEN_STATES))


def reconcile(journal: DataFrame, files: DataFrame) -> DataFrame:
    """What each open operation comes to, given the files that exist now: op_id, outcome, purge (the catalogue row goes).

    A backup is COMPLETED if its source is gone and its target there, FAILED if both are gone, ABORTED while the source is
    there. Any other action is COMPLETED and purged if the file is gone, else ABORTED. ``files``: filepath.
    """
    there = files.select("filepath").distinct()
    p = pending(journal)
    j = p.join(there.withColumn("src", F.lit(True)), "filepath", "left").join(there.select(F.col("filepath").alias("target_path"), F.lit(True).alias("dst")), "target_path", "left")
    gone, moved = F.col("src").isNull(), F.col("dst").isNotNull()
    backup = F.upper("action").isin("BACKUP", "MOVE")
    outcome = F.when(~gone, "ABORTED").when(backup & ~moved, "FAILED").otherwise("COMPLETED")
    return j.select("op_id", "filepath", outcome.alias("outcome"), (outcome == "COMPLETED").alias("purge"))


def plan(groups: DataFrame, members: DataFrame, files: DataFrame, *, bypass_review: bool = False, folder: str = "") -> DataFrame:
    """One row per member marked DELETE: group_id, filepath, verdict, target_path.

    Verdicts: blocked (the group needs review and that is not bypassed), last_copy (no other member would stay), missing, planned. Targets in
    ``folder`` take _1, _2... where names collide, in path order.
    """
    m = members.filter("group_id IS NOT NULL AND filepath IS NOT NULL").groupBy("group_id", "filepath").agg(F.max("action").alias("action"))
    safe = m.groupBy("group_id").agg(F.bool_or(F.coalesce(F.col("action") != "DELETE", F.lit(True))).alias("has_other"))
    j = m.filter("action = 'DELETE'").join(safe, "group_id").join(groups.select("group_id", F.coalesce("requires_manual_review", F.lit(False)).alias("review")), "group_id", "left")
    j = j.join(files.select("filepath").distinct().withColumn("there", F.lit(True)), "filepath", "left")
    verdict = F.when(F.coalesce("review", F.lit(False)) & F.lit(not bypass_review), "blocked").when(~F.col("has_other"), "last_copy").when(F.col("there").isNull(), "missing").otherwise("planned")
    name = F.substring_index("filepath", "/", -1)
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    n = F.row_number().over(Window.partitionBy("verdict", "name").orderBy("filepath", "group_id")) - 1
    j = j.withColumns({"verdict": verdict, "name": name}).withColumn("n", n)
    target = F.when(F.col("verdict") == "planned", F.concat(F.lit(folder.rstrip("/") + "/"), stem, F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), ext))
    return j.select("group_id", "filepath", "verdict", target.alias("target_path"))


def status(success: str = "success", failed: str = "failed", blocked: str = "blocked", partial: str = "partial") -> Column:
    s, f, b, p = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in (success, failed, blocked, partial))
    return F.when(p | (s & f), "PARTIAL_FAILURE").when(s & b, "PARTIAL_SUCCESS").when(f, "FAILED").when(b, "BLOCKED").otherwise("SUCCESS")


def cli_label(review: str = "requires_manual_review", best: str = "is_best") -> Column:
    return F.when(F.col(review), "REVISAR").when(F.col(best), "CONSERVAR").otherwise("ELIMINAR")


class Journal:
    """Append-only JSON lines; a state is on disk before the step that it announces."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def append(self, op_id: str, filepath: str, action: str, target_path: str, state: str, created_at: str | None = None) -> str:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        row = {"op_id": op_id, "filepath": filepath, "action": action, "target_path": target_path, "state": state, "created_at": created_at or now, "updated_at": now}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return row["created_at"]


def trash(source: str, folder: str | None = None) -> str:
    """Move a file to the trash folder (the user's, in the layout of the desktop standard, unless one is given) and return where it went."""
    root = folder or os.path.join(os.environ.get("XDG_DATA_HOME", os.path.expanduser("~/.local/share")), "Trash")
    for d in ("files", "info"):
        os.makedirs(os.path.join(root, d), exist_ok=True)
    stem, ext = os.path.splitext(os.path.basename(source))
    n, target = 0, os.path.join(root, "files", stem + ext)
    while os.path.exists(target):
        n += 1
        target = os.path.join(root, "files", f"{stem}_{n}{ext}")
    with open(os.path.join(root, "info", os.path.basename(target) + ".trashinfo"), "w", encoding="utf-8") as f:
        f.write(f"[Trash Info]\nPath={os.path.abspath(source)}\nDeletionDate={datetime.datetime.now().isoformat(timespec='seconds')}\n")
    shutil.move(source, target)
    return target


def execute(steps: Iterable[tuple[str, str]], journal: Journal, action: str = "BACKUP") -> dict:
    """Move (BACKUP), put in the trash (TRASH) or delete planned files one by one. Nothing is touched whose PENDING row could not be written."""
    out = {"success": 0, "failed": 0, "logs": []}
    for source, target in steps:
        op = uuid.uuid4().hex
        try:
            created = journal.append(op, source, action, target or "", "PENDING")
        except OSError as e:
            out["failed"] += 1
            out["logs"].append(f"journal: {e}")
            continue
        try:
            if action == "BACKUP":
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.move(source, target)
            elif action == "TRASH":
                target = trash(source)
            else:
                os.remove(source)
            journal.append(op, source, action, target or "", "FS_DONE", created)
            journal.append(op, source, action, target or "", "COMPLETED", created)
            out["success"] += 1
        except OSError as e:
            journal.append(op, source, action, target or "", "FAILED", created)
            out["failed"] += 1
            out["logs"].append(f"{source}: {e}")
    return out
