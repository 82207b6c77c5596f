"""Mission classes, coherence, rewards and feedback of completions; all total: no completion fails a job.

Two rewards are kept apart: ``rewards`` (hallucinations by occurrence, floors at 0, nothing enriched) and ``feedback`` (default
ports put in first, distinct hallucinations, floors at -1, other keywords). A completion without a document scores -1 in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolita.operators import catalog as C
from arbolita.operators import facts
from arbolita.operators.validate import _in

WEIGHTS = {"parse": 0.3, "structure": 0.2, "semantic": 0.2, "coherence": 0.2, "hallucination": 0.1}
INSPECTION = ("inspection", "inspecter", "mesure", "releve", "controle")
CONTROL = ("verifier", "controler", "analyser", "qualite", "correction", "corriger")
SIMULATION = ("simulation", "simuler")


def some(text: Column, words) -> Column:
    """Whether any of the words occurs in the text (false for null)."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return F.coalesce(found, F.lit(False))


def mission_class(mission: Column, inspection=INSPECTION, control=CONTROL, simulation=SIMULATION) -> Column:
    """Four ordered classes by keywords of the lower-case mission; accents are not folded."""
    low = F.lower(mission)
    return (
        F.when(some(low, simulation), "simulation").when(some(low, inspection) & some(low, control), "inspection_avec_controle").when(some(low, inspection), "inspection_sans_controle").otherwise("transport")
    )


NO_MEASURE = ("pas de mesure", "sans mesure", "pas d'inspection", "sans inspection", "simple transport", "pas de contrôle", "pas de controle")
NO_CONTROL = ("sans contrôle", "sans être contrôl", "à la volée", "sans controle", "sans etre control")


def negated_class(mission: Column) -> Column:
    """Three classes with negations heard: transport, inspection_sans_controle, inspection_avec_controle."""
    low = F.lower(mission)
    inspect = ~some(low, NO_MEASURE) & ~some(low, ("correction", "corriger")) & some(low, ("inspection", "inspecter", "mesure", "vérifier", "contrôler", "défaut"))
    return F.when(inspect & some(low, NO_CONTROL), "inspection_sans_controle").when(inspect, "inspection_avec_controle").otherwise("transport")


_MOVES = (("move", 0), ("deccelerate", 1), ("reach_and_stop", 2), ("pass", 3), ("reach_stop_no_wait", 4))
_INSPECTIONS = (("move_and_inspect", 10), ("deccel_and_inspect", 11), ("reach_stop_inspecting", 12), ("pass_stop_inspecting", 13), ("reach_stop_inspect_no_wait", 14))


def motion_subtrees(mission: Column) -> Column:
    """The motion subtrees that a mission of its class asks for, as name(type) separated by commas."""
    listed = lambda rows: ", ".join(f"{n}({t})" for n, t in rows)
    return F.when(negated_class(mission) == "transport", listed(_MOVES)).otherwise(listed((*_MOVES, *_INSPECTIONS)))


def browser_class(mission: Column) -> Column:
    """Six classes as the browser shows them."""
    low = F.lower(mission)
    inspect = mission.rlike("(?iu)inspect|mesure|rail|ballast|caténaire|aiguillage|appareil de voie|traverse|éclisse|tirefond|soudure|défaut")
    return (
        F.when(some(low, ("simulation",)), "simulation").when(some(low, ("correction", "anomalie", "correcti")), "correction_anomalie").when(some(low, ("arrêts multiples", "arrets multiples")), "transport_arrêts_multiples")
        .when(inspect, "inspect-ctrl").when(some(low, ("autoris",)), "inspect+ctrl").otherwise("transport_simple")
    )


def coherence(xml: Column, kind: Column) -> Column:
    """How well the document suits the mission's class: 1/.5, 1/.7/.3, 1/.8/.3, 1/.5."""
    manage, analyse = F.contains(xml, F.lit("ManageMeasurements")), F.contains(xml, F.lit("AnalyseMeasurements"))
    return (
        F.when(kind == "transport", F.when(~manage, 1.0).otherwise(0.5))
        .when(kind == "inspection_avec_controle", F.when(manage & analyse, 1.0).when(manage, 0.7).otherwise(0.3))
        .when(kind == "inspection_sans_controle", F.when(manage & ~analyse, 1.0).when(manage, 0.8).otherwise(0.3))
        .when(kind == "simulation", F.when(F.contains(xml, F.lit("SimulationStarted")), 1.0).otherwise(0.5)).otherwise(0.5)
    )


def coherence_rich(xml: Column, mission: Column) -> Column:
    """The other table: 1/.4, 1/.6/.2, 1/.7/.3, without a class of simulations."""
    low = F.lower(mission)
    manage, analyse = F.contains(xml, F.lit("ManageMeasurements")), F.contains(xml, F.lit("AnalyseMeasurements"))
    inspect, control = some(low, ("inspection", "inspecter", "mesure", "controle")), some(low, ("verifier", "controler", "analyser", "qualite", "corriger"))
    return (
        F.when(~inspect, F.when(~manage, 1.0).otherwise(0.4)).when(control, F.when(manage & analyse, 1.0).when(manage, 0.6).otherwise(0.2))
        .otherwise(F.when(manage & ~analyse, 1.0).when(manage, 0.7).otherwise(0.3))
    )


def extracted(completion: Column) -> Column:
    """The first whole document; where it isn't closed what follows its start; null where there is none."""
    whole = F.nullif(F.regexp_extract(completion, r"(?s)<root.*?</root>", 0), F.lit(""))
    return F.coalesce(whole, F.when(F.contains(completion, F.lit("<root")), F.substr(completion, F.locate("<root", completion))))


def extracted_rich(completion: Column) -> Column:
    return F.nullif(F.regexp_extract(completion, r"(?is)<root.*?</root\s*>", 0), F.lit(""))


def _weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.lit(w) * F.col(f"r_{k}")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))


def rewards(df: DataFrame, catalog: C.Catalog = C.DEFAULT, weights: dict[str, float] = WEIGHTS, id_col: str = "id", mission_col: str = "mission", completion_col: str = "completion") -> DataFrame:
    """``id, kind, r_parse .. r_hallucination, reward`` of every completion; its parts are null and the reward -1 where it has no document."""
    df = df.select(F.col(id_col).cast("string").alias("id"), F.col(mission_col).alias("mission"), extracted(F.col(completion_col)).alias("xml"))
    df = df.withColumn("kind", mission_class(F.col("mission"))).select("id", "xml", "kind", coherence(F.col("xml"), F.col("kind")).alias("r_coherence"), F.col("xml").isNotNull().alias("there"))
    parts = facts.judged(df, catalog, id_col="id", keep=("kind", "r_coherence", "there")).select(
        F.col("tree_id").alias("id"), "kind", "there", F.when(F.col("score") > 0, 1.0).otherwise(-1.0).alias("r_parse"), F.when(F.col("score") > 0, F.col("score")).otherwise(-0.5).alias("r_structure"),
        F.greatest(F.lit(0.0), 1.0 - 0.1 * F.col("n_warnings")).alias("r_semantic"), "r_coherence",
        F.when(~F.col("parsed"), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.5 * F.col("n_stray"))).alias("r_hallucination"),
    )
    there = F.col("there")
    return parts.select("id", "kind", *[F.when(there, F.col(f"r_{k}")).alias(f"r_{k}") for k in WEIGHTS], F.when(there, _weighted(weights)).otherwise(-1.0).alias("reward"))


def told(issues: Column, severity: str) -> Column:
    """Findings of one severity, one a line: [L2] code: detail."""
    line = lambda x: F.concat(F.lit("[L"), x["level"].cast("string"), F.lit("] "), x["code"], F.coalesce(F.concat(F.lit(": "), x["detail"]), F.lit("")))
    return F.array_join(F.transform(F.filter(issues, lambda x: x["severity"] == severity), line), "\n")


def feedback(df: DataFrame, catalog: C.Catalog = C.DEFAULT, weights: dict[str, float] = WEIGHTS, id_col: str = "id", mission_col: str = "mission", completion_col: str = "completion") -> DataFrame:
    """``id, dense_score, raw_score, valid, r_*, errors_text, warnings_text, skills_used, hallucinated, prompt_text`` of every completion."""
    df = df.select(F.col(id_col).cast("string").alias("id"), F.col(mission_col).alias("mission"), extracted_rich(F.col(completion_col)).alias("xml"))
    used = F.array_sort(F.array_distinct(F.regexp_extract_all("xml", F.lit(r'<(?:Action|Condition)[^>]*\bID="([^"]+)"'), 1)))
    df = df.select("id", "xml", coherence_rich(F.col("xml"), F.col("mission")).alias("r_coherence"), used.alias("skills_used"), F.col("xml").isNotNull().alias("there"))
    s = facts.judged(df, catalog, enriched=True, lines=True, id_col="id", keep=("r_coherence", "skills_used", "there"))
    s = s.withColumn("hallucinated", F.filter("skills_used", lambda x: ~_in(x, catalog.names())))
    there = F.col("there")
    component = lambda c, otherwise: F.when(there, c).otherwise(otherwise)
    s = s.select(
        F.col("tree_id").alias("id"), "there", component(F.col("score"), 0.0).alias("raw_score"), component(F.col("valid"), False).alias("valid"), component(F.lit(1.0), -1.0).alias("r_parse"),
        component(F.when(F.col("valid"), F.col("score")).otherwise(-0.5), -0.5).alias("r_structure"), component(F.greatest(F.lit(-1.0), 1.0 - 0.1 * F.col("n_warnings")), 0.0).alias("r_semantic"),
        component(F.col("r_coherence"), 0.0).alias("r_coherence"), component(F.greatest(F.lit(-1.0), 1.0 - 0.5 * F.size("hallucinated")), 0.0).alias("r_hallucination"),
        component(F.col("errors_text"), "No <root> document in the completion").alias("errors_text"), component(F.col("warnings_text"), "").alias("warnings_text"),
        F.coalesce("skills_used", F.array().cast("array<string>")).alias("skills_used"), F.coalesce("hallucinated", F.array().cast("array<string>")).alias("hallucinated"),
    )
    s = s.withColumn("dense_score", F.when(there, _weighted(weights)).otherwise(-1.0))
    return s.withColumn("prompt_text", prompt_text(F.col("raw_score"), F.col("valid"), F.col("errors_text"), F.col("warnings_text"), F.col("hallucinated"))).drop("there")


def prompt_text(score: Column, valid: Column, errors: Column, warnings: Column, hallucinated: Column, lines: int = 6, names: int = 8) -> Column:
    """The feedback as a prompt tells it: the first ``lines`` lines of errors and of warnings, the first ``names`` unknown skills."""
    first = lambda text: F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    parts = F.array(
        F.concat(F.lit("Score: "), F.format_string("%.2f", score), F.lit(" (valid="), F.when(valid, "True").otherwise("False"), F.lit(")")),
        F.when(errors != "", F.concat(F.lit("Errors:\n"), first(errors))), F.when(warnings != "", F.concat(F.lit("Warnings:\n"), first(warnings))),
        F.when(F.size(hallucinated) > 0, F.concat(F.lit("Skills outside the catalog: "), F.array_join(F.slice(hallucinated, 1, names), ", "))),
    )
    return F.array_join(parts, "\n")
