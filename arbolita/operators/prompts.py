"""Prompts of missions: eight modes in three formats, refinement from earlier attempts, and rows for training."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbolita.operators import catalog as C

SYSTEM = "You write behavior trees as XML for the mission that is described. Use only skills of the catalog, give every port, answer with the XML alone."
CODE_SYSTEM = "You write a script against the builder's calls below that makes the behavior tree of the mission. Answer with the script alone."
MODES = ("zero_shot", "few_shot", "schema_guided", "chain_of_thought", "sft", "program_of_thoughts", "react_pot_agent", "react_base_agent")
INNER = ("zero_shot", "few_shot", "schema_guided", "chain_of_thought")
FORMATS = ("chat", "no_system", "inst")
_TURN = "array<struct<role:string,content:string>>"


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def system_text(mode: str, rules: list[C.Rule] = ()) -> str:
    """The system part: that of code modes or of XML modes, with the rules that are for prompts."""
    base = CODE_SYSTEM if mode in ("program_of_thoughts", "react_pot_agent") else SYSTEM
    return base + ("\n\n" + C.rule_text(list(rules)) if rules else "")


def user_text(mode: str, mission: Column, catalog: C.Catalog | None = C.DEFAULT, history: Column | None = None) -> Column:
    """The user's part of a mode. ``history`` is an array of (code, error, validator) of earlier attempts, oldest first."""
    said = F.concat(F.lit("Mission: "), mission)
    if mode in ("zero_shot", "few_shot", "sft"):
        return said
    if mode == "schema_guided":
        return F.concat(F.lit(f"Skills:\n{catalog.summary() if catalog else '(no catalog)'}\n\n"), said)
    if mode == "chain_of_thought":
        return F.concat(said, F.lit("\n\nThink first: 1. the kind of mission, 2. the skills it needs, 3. their order, 4. the conditions and loops. Then write the XML."))
    if mode in ("program_of_thoughts", "react_pot_agent"):
        first = F.concat(F.lit(f"Calls:\n{catalog.reference() if catalog else '(no catalog)'}\n\n"), said)
        if mode == "program_of_thoughts" or history is None:
            return first
        last = F.try_element_at(history, F.lit(-1))
        again = F.concat(
            first, F.lit("\n\nAttempt "), F.size(history).cast("string"), F.lit(":\n"), F.coalesce(last["code"], F.lit("")), F.lit("\nError: "), F.coalesce(last["error"], F.lit("none")),
            F.lit("\nValidator: "), F.coalesce(last["validator"], F.lit("none")), F.lit("\nWrite the whole script again without these faults."),
        )
        return F.when(F.size(F.coalesce(history, F.array().cast("array<struct<code:string,error:string,validator:string>>"))) > 0, again).otherwise(first)
    raise ValueError(f"mode {mode!r}")


def prompt(
    mode: str, mission: Column, form: str = "chat", catalog: C.Catalog | None = C.DEFAULT, rules: list[C.Rule] = (), examples: list[tuple[str, str]] = (), history: Column | None = None,
    inner: str = "chain_of_thought",
) -> Column:
    """The prompt of a mission: an array of (role, content) for ``chat`` and ``no_system``, a string for ``inst``.

    ``no_system`` puts the system text before the first user turn. ``react_base_agent`` is one of the ``INNER`` modes with the last
    attempt (array of (xml, score, errors, warnings)) behind it.
    """
    if mode not in MODES or form not in FORMATS:
        raise ValueError(f"mode {mode!r}, form {form!r}")
    if mode == "react_base_agent":
        if inner not in INNER:
            raise ValueError(f"inner mode {inner!r}")
        whole = prompt(inner, mission, form, catalog, rules, examples)
        if history is None:
            return whole
        last = F.try_element_at(history, F.lit(-1))
        few = lambda c, what: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{what}: "), F.array_join(F.slice(c, 1, 5), "; "))).otherwise("")
        footer = F.concat(
            F.lit("Last attempt (score="), F.format_string("%.2f", last["score"]), F.lit("):\n```xml\n"), F.coalesce(F.nullif(F.trim(last["xml"]), F.lit("")), F.lit("(no XML)")), F.lit("\n```"),
            few(last["errors"], "Errors"), few(last["warnings"], "Warnings"), F.lit("\nWrite the whole tree again without these faults, as one <root> block."),
        )
        some = F.size(history) > 0
        if form == "inst":
            return F.when(some, F.concat(whole, F.lit("\n\n"), footer)).otherwise(whole)
        return F.when(some, F.concat(whole, F.array(_turn("user", footer)))).otherwise(whole)
    system = system_text(mode, rules)
    before = F.lit(system + "\n\n")
    asked = user_text(mode, mission, catalog, history)
    shown = [(F.lit(f"Mission: {m}"), x) for m, x in (examples if mode == "few_shot" else ())]
    if form == "inst":
        if mode != "few_shot":
            return F.concat(F.lit("[INST] "), before, asked, F.lit(" [/INST]"))
        turns = [F.concat(F.lit("<s>[INST] "), before if k == 0 else F.lit(""), m, F.lit(f" [/INST] {x} </s>")) for k, (m, x) in enumerate(shown)]
        last = F.concat(F.lit("<s>[INST] "), before if not shown else F.lit(""), asked, F.lit(" [/INST]"))
        return F.array_join(F.array(*turns, last), "\n")
    turns = []
    for m, x in shown:
        turns += [_turn("user", m), _turn("assistant", F.lit(x))]
    turns.append(_turn("user", asked))
    if form == "chat":
        return F.array(_turn("system", F.lit(system)), *turns).cast(_TURN)
    head = F.concat(before, shown[0][0] if shown else asked)
    return F.array(_turn("user", head), *turns[1:]).cast(_TURN)


def training_row(mission: Column, xml: Column, form: str = "chat", rules: list[C.Rule] = ()) -> Column:
    """A whole example: the ``sft`` prompt with the answer."""
    asked = prompt("sft", mission, form, rules=rules)
    return F.concat(asked, F.lit(" "), xml) if form == "inst" else F.concat(asked, F.array(_turn("assistant", xml)))


def navigation_catalog(skills: list[tuple[str, str, list[tuple[str, str, bool]]]]) -> str:
    """The second dialect's catalog, one compact line a skill; optional parameters in brackets."""
    return "\n".join(f"{s}({', '.join(f'{p}:{k}' if r else f'[{p}:{k}]' for p, k, r in ps)}) -> <{t}>" for s, t, ps in skills)


def navigation_row(mission: Column, skills, reference: str = "") -> Column:
    """The second dialect's prompt: catalog, a reference tree where there is one, mission."""
    head = f"[INST] Allowed nodes:\n{navigation_catalog(skills)}\n" + (f"Reference tree:\n{reference}\n" if reference else "")
    return F.concat(F.lit(head + "Mission: "), mission, F.lit(" [/INST]"))
