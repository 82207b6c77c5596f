"""Bounded loops: generate, validate, try again; tokens and time added up over the attempts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators import reward
from arbolita.operators.nodes import bt_trees
from arbolita.operators.reward import told
from arbolita.operators.validate import scored
from arbolita.session import cut


def semantic_faults(xml: Column, mission: Column) -> Column:
    """What a document of this mission's class lacks, joined by "; "; empty where nothing."""
    kind = reward.negated_class(mission)
    has = lambda w: F.contains(xml, F.lit(w))
    inspect = kind != "transport"
    return F.array_join(F.array_compact(F.array(
        F.when(inspect & ~xml.rlike(r'type_to_be_checked="1[0-4]"'), "no inspection step type"), F.when(inspect & ~has("ManageMeasurements"), "ManageMeasurements is missing"),
        F.when((kind == "inspection_avec_controle") & ~has("AnalyseMeasurements"), "AnalyseMeasurements is missing"), F.when(~inspect & has("ManageMeasurements"), "ManageMeasurements in a transport"),
    )), "; ")


def retried(missions: DataFrame, generate: Callable[[DataFrame, int], DataFrame], most: int = 3, target: float | None = None, strict_semantic: bool = False) -> DataFrame:
    """``id, mission, xml, valid, score, faults, iterations, tokens, latency_s``: the outcome of every mission after at most ``most`` attempts.

    ``generate(pending, attempt)`` gets ``id, mission, faults`` (of the attempt before, null at first) and returns ``id, xml, tokens,
    latency_s``; it may be a model behind ``mapInArrow`` or a table of outputs. A mission is done when its document is valid (and, with
    ``strict_semantic``, has no semantic fault; and, with ``target``, scores that much). Only what is pending is tried again, and each
    attempt is written, so that a lost executor repeats none. Tokens and seconds are summed over attempts; the last attempt's
    document is kept. A mission for which ``generate`` returns nothing has a null document.
    """
    pending = missions.select(F.col("id").cast("string").alias("id"), "mission", F.lit(None).cast("string").alias("faults"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("latency_s"))
    done: DataFrame | None = None
    for attempt in range(1, most + 1):
        made = generate(pending.select("id", "mission", "faults"), attempt).select("id", "xml", F.col("tokens").alias("__t"), F.col("latency_s").alias("__s"))
        tried = pending.drop("faults").join(made, "id", "left").withColumns({"tokens": F.col("tokens") + F.coalesce("__t", F.lit(0)), "latency_s": F.col("latency_s") + F.coalesce("__s", F.lit(0.0))})
        judged = scored(bt_trees(tried, "id", "xml", keep=("mission", "xml", "tokens", "latency_s")))
        lacks = F.coalesce(semantic_faults(F.col("xml"), F.col("mission")), F.lit(""))
        ok = F.col("valid") & ((lacks == "") if strict_semantic else F.lit(True)) & (F.lit(True) if target is None else F.col("score") >= target)
        faults = F.array_join(F.filter(F.array(told(F.col("issues"), "error"), lacks), lambda x: x != ""), "\n")
        row = judged.select(F.col("tree_id").alias("id"), "mission", "xml", "valid", "score", faults.alias("faults"), F.lit(attempt).alias("iterations"), "tokens", "latency_s", ok.alias("__ok"))
        row = cut(row, "attempt")
        over = row if attempt == most else row.where("__ok")
        done = over.drop("__ok") if done is None else done.unionByName(over.drop("__ok"))
        pending = row.where("not __ok").select("id", "mission", "faults", "tokens", "latency_s")
        if attempt < most and not pending.limit(1).count():
            break
    return done


def backing_off(action: Callable[[], object], most: int = 5, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The result of an action of the driver; after the k-th failure it waits k x ``wait`` seconds, after the last it raises."""
    for k in range(1, most + 1):
        try:
            return action()
        except Exception:
            if k == most:
                raise
            sleep(k * wait)
