"""The skill catalog as small dimensions, and rule constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BB = "bb_var"
#: family, skill, tag, ports as (name, type, default, allowed values)
SKILLS: list[tuple[str, str, str, list[tuple[str, str, str, str | None]]]] = [
    ("preparation", "LoadMission", "Action", [("mission_file_path", BB, "{mission_file_path}", None)]),
    ("preparation", "MissionStructureValid", "Condition", []),
    ("preparation", "UpdateCurrentGeneratedActivity", "Action", [(p, BB, d, None) for p, d in (("type", "{type}"), ("origin_sph", "{origin_sph}"), ("target_sph", "{target_sph}"), ("forbidden_atoms_out", "{forbidden_atoms}"))]),
    ("preparation", "ProjectPointOnNetwork", "Action", [(p, BB, f"{{{p}}}", None) for p in ("point_in", "point_out")]),
    ("preparation", "CreatePath", "Action", [(p, BB, f"{{{p}}}", None) for p in ("origin", "target", "forbidden_atoms", "path")]),
    ("preparation", "AgregatePath", "Action", [("path", BB, "{path}", None)]),
    ("preparation", "MissionFullyTreated", "Condition", [("type", BB, "{type}", None)]),
    ("preparation", "PassAdvancedPath", "Action", [("adv_path", BB, "{adv_path}", None)]),
    ("preparation", "PassMission", "Action", [("mission", BB, "{mission}", None)]),
    ("preparation", "GenerateMissionSequence", "Action", [(p, BB, f"{{{p}}}", None) for p in ("mission", "mission_sequence")]),
    ("preparation", "GenerateCorrectiveSubSequence", "Action", [("defects", BB, "{defects}", None)]),
    ("preparation", "InsertCorrectiveSubSequence", "Action", []),
    ("motion", "MissionTerminated", "Condition", []),
    ("motion", "CheckCurrentStepType", "Condition", [("type_to_be_checked", "int_literal", "0", "0,1,2,3,4,10,11,12,13,14")]),
    ("motion", "PassMotionParameters", "Action", [("motion_params", BB, "{motion_params}", None)]),
    ("motion", "Move", "Action", [("threshold_type", "int_literal", "1", "1,3"), ("motion_params", BB, "{motion_params}", None)]),
    ("motion", "UpdateCurrentExecutedStep", "Action", []),
    ("motion", "Deccelerate", "Action", [("motion_params", BB, "{motion_params}", None)]),
    ("motion", "MoveAndStop", "Action", [("motion_params", BB, "{motion_params}", None)]),
    ("motion", "SignalAndWaitForOrder", "Action", [("message", "string_literal", "waiting_for_order", None)]),
    ("motion", "IsRobotPoseProjectionActive", "Condition", [(p, BB, f"{{{p}}}", None) for p in ("adv_path", "pub_proj")]),
    ("motion", "Pause", "Action", [("duration", "float_literal", "2.0", None)]),
    ("inspection", "ManageMeasurements", "Action", []),
    ("inspection", "AnalyseMeasurements", "Action", []),
    ("inspection", "MeasurementsQualityValidated", "Condition", []),
    ("inspection", "PassDefectsLocalization", "Action", [("defects", BB, "{defects}", None)]),
    ("inspection", "MeasurementsEnforcedValidated", "Condition", []),
    ("simulation", "SimulationStarted", "Condition", []),
    ("simulation", "ChangeSimulationStatus", "Action", []),
    ("simulation", "PassGraphicalPreliminaryPathDescription", "Action", [("graphical_path", BB, "{graphical_path}", None)]),
    ("simulation", "FinalizeAndPublishGraphicalPathDescription", "Action", [("graphical_path", BB, "{graphical_path}", None)]),
]
PREREQUISITES = [
    ("MissionStructureValid", "LoadMission"), ("CreatePath", "ProjectPointOnNetwork"), ("AgregatePath", "CreatePath"), ("GenerateMissionSequence", "LoadMission"),
    ("FinalizeAndPublishGraphicalPathDescription", "PassGraphicalPreliminaryPathDescription"),
]
VALID_TAGS = ("root", "BehaviorTree", "Action", "Condition", "SubTreePlus", "Sequence", "Fallback", "ReactiveFallback", "Parallel", "Repeat")
LOOP_CONDITIONS = ("MissionTerminated", "MissionFullyTreated", "MeasurementsQualityValidated", "MeasurementsEnforcedValidated")
PRODUCERS, CONSUMERS = ("PassMotionParameters",), ("Move", "Deccelerate", "MoveAndStop")
MAX_DEPTH, MAX_SKILLS, MIN_FALLBACK = 12, 80, 2




@dataclass(frozen=True)
class Port:
    name: str
    kind: str = "bb_var"
    required: bool = False
    default: str | None = None
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Skill:
    name: str
    family: str
    tag: str = "Action"
    ports: tuple[Port, ...] = ()
    prerequisites: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Catalog:
    """Skills, what a document may hold, and its limits; small, so it travels in plans as literals."""

    skills: tuple[Skill, ...]
    prerequisites: tuple[tuple[str, str], ...] = ()
    control: tuple[str, ...] = VALID_TAGS[5:]
    tags: tuple[str, ...] = VALID_TAGS
    max_depth: int = MAX_DEPTH
    max_skills: int = MAX_SKILLS
    min_fallback: int = MIN_FALLBACK
    version: str = "?"

    def names(self) -> list[str]:
        return sorted(s.name for s in self.skills)

    def conditions(self) -> list[str]:
        return sorted(s.name for s in self.skills if s.tag == "Condition")

    def actions(self) -> list[str]:
        return sorted(s.name for s in self.skills if s.tag != "Condition")

    def families(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.skills:
            out.setdefault(s.family, []).append(s.name)
        return out

    def defaults(self) -> dict[str, dict[str, str]]:
        found = {s.name: {p.name: p.default for p in s.ports if p.default is not None} for s in self.skills}
        return {k: v for k, v in found.items() if v}

    def limits(self) -> dict[str, int]:
        return {"max_depth": self.max_depth, "max_skills": self.max_skills, "min_fallback_children": self.min_fallback}

    def summary(self) -> str:
        """Families, their skills with tag, and ports (a star where required)."""
        lines = [f"Skills catalog (v{self.version})", ""]
        for family, names in self.families().items():
            lines.append(f"## {family.upper()} ({len(names)} skills)")
            for s in self.skills:
                if s.family == family:
                    ports = ", ".join(f"{p.name}{'*' if p.required else ''}:{p.kind}" for p in s.ports)
                    lines.append(f"  - {s.name} ({'Condition' if s.tag == 'Condition' else 'Action'})" + (f" [{ports}]" if ports else ""))
            lines.append("")
        return "\n".join(lines)

    def reference(self) -> str:
        """A call of the builder for every skill, by family, with its ports and description."""
        out = []
        for family in sorted(self.families()):
            out.append(f"# {family}")
            for s in sorted((s for s in self.skills if s.family == family), key=lambda s: s.name):
                args = "".join(f", {p.name}={p.default!r}" for p in s.ports)
                out.append(f'{"condition" if s.tag == "Condition" else "action"}("{s.name}"{args})' + (f"  # {s.description}" if s.description else ""))
        return "\n".join(out)


@dataclass(frozen=True)
class Rule:
    name: str
    title: str
    text: str
    level: str
    enforcement: tuple[str, ...] = ()
    blocking: bool = True


def rules_of(rules: list[Rule], level: str | None = None, blocking: bool | None = None, enforcement: str | None = None) -> list[Rule]:
    """The rules of a level, that block or not, that are enforced in a place."""
    return [r for r in rules if (level is None or r.level == level) and (blocking is None or r.blocking == blocking) and (enforcement is None or enforcement in r.enforcement)]


def rule_text(rules: list[Rule]) -> str:
    """The rules that a prompt states, one a line."""
    return "\n".join(["SAFETY RULES:", "", *(f"- [{r.name}] {r.title}: {r.text.strip()}" for r in rules_of(rules, enforcement="prompt"))])


DEFAULT = Catalog(
    tuple(Skill(s, f, t, tuple(Port(p, k, True, d, tuple(a.split(",")) if a else None) for p, k, d, a in ports)) for f, s, t, ports in SKILLS),
    tuple(PREREQUISITES),
)


def dim_skill(spark: SparkSession, catalog: Catalog = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(s.family, s.name, s.tag) for s in catalog.skills], "family string, skill_id string, bt_tag string")


def dim_port(spark: SparkSession, catalog: Catalog = DEFAULT) -> DataFrame:
    rows = [(s.name, p.name, p.kind, p.required, p.default, list(p.allowed) if p.allowed else None) for s in catalog.skills for p in s.ports]
    return spark.createDataFrame(rows, "skill_id string, port string, kind string, required boolean, default_value string, allowed array<string>")


def dim_prereq(spark: SparkSession, catalog: Catalog = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(catalog.prerequisites), "skill_id string, prerequisite string")
