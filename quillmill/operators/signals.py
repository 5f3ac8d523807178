"""Signals of a scenario and its demands (Q3), and whether a question measures what it is about (Q4). Words are rule tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X

#: A pattern that is found nowhere.
NOTHING = r"[^\s\S]"


@dataclass(frozen=True)
class Scenario:
    """Patterns on lower-case text. ``stances``: pairs of positions that people take against each other; ``relations``: facts
    that pull in two directions; each a name and the patterns that must all be found. A name may stand in both."""

    quantified: str = NOTHING
    incident: str = NOTHING
    artifact: str = NOTHING
    actor: str = NOTHING
    dilemma: str = NOTHING
    conflict: str = NOTHING
    stances: dict[str, tuple[str, ...]] = field(default_factory=dict)
    relations: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _found(c: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Names of the rules of which every pattern is found, in order."""
    every = lambda patterns: reduce(and_, [c.rlike(p) for p in patterns])
    return F.array_compact(F.array(*[F.when(every(p), F.lit(n)) for n, p in rules.items()])) if rules else F.array().cast("array<string>")


def scenario_signals(df: DataFrame, text: Column, v: Scenario) -> DataFrame:
    """Q3: adds what makes a scenario concrete: ``quantified_fact, incident, actor_action, artifact_count`` (distinct ones), ``dilemma, concrete_fact``, ``stances`` and ``relations`` (names).

    Sources that differ (``conflict``) are an incident and a dilemma; opposed
    stances are an actor's act and a dilemma; a relation is a dilemma and a
    concrete fact by itself. Else a number with an incident or artifact, an act,
    or two artifacts with an incident are concrete. Null is an empty text.
    """
    held = df.withColumn("__t", F.lower(X.text_or_empty(text)))
    c = F.col("__t")
    held = held.withColumn("stances", _found(c, v.stances)).withColumn("relations", _found(c, v.relations)).withColumn("artifact_count", F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(v.artifact), F.lit(0)))))
    opposed, related, conflict, n = F.size("stances") > 0, F.size("relations") > 0, c.rlike(v.conflict), F.col("artifact_count")
    held = held.withColumn("quantified_fact", c.rlike(v.quantified)).withColumn("incident", c.rlike(v.incident) | conflict).withColumn("actor_action", c.rlike(v.actor) | opposed).withColumn("dilemma", c.rlike(v.dilemma) | opposed | conflict | related)
    concrete = (F.col("quantified_fact") & (F.col("incident") | (n > 0))) | F.col("actor_action") | ((n >= 2) & F.col("incident")) | related
    return held.withColumn("concrete_fact", concrete).drop("__t")


@dataclass(frozen=True)
class Demands:
    """Patterns on lower-case text. ``sentence``: what a demanding sentence holds; ``asks``: question words; ``action``: what an
    asked slot is about; ``nominal``: nouns that are asked for; ``families`` and ``outputs``: kinds of work and of results."""

    sentence: str
    asks: str
    action: str
    nominal: str
    families: dict[str, str]
    outputs: dict[str, str]
    slots: int = 5
    kinds: int = 4
    reach: int = 50
    long: tuple[int, int, int, int] = (320, 150, 2, 4)


def demand_overload(df: DataFrame, text: Column, v: Demands) -> DataFrame:
    """Q3: adds ``demand_slots, demand_families, demand_outputs`` (counts), ``demand_length`` and ``overload_warning``.

    Only sentences that demand are read. A slot is a question word with the first
    action within ``reach`` characters behind it, else with the next word; equal
    slots count once; the nouns asked for stand in where they are more. It is too
    much at ``slots`` slots of ``kinds`` families, or in a ``long`` text (its length, that
    of its demands, families, outputs at least).
    """
    held = df.withColumn("__t", F.lower(X.text_or_empty(text)))
    sentences = F.filter(F.regexp_extract_all("__t", F.lit(r"[^.?!\n]+[.?!\n]?"), F.lit(0)), lambda s: s.rlike(v.sentence))
    held = held.withColumn("__d", F.trim(F.array_join(sentences, " ")))
    c = F.col("__d")
    behind = F.lit(rf"({v.asks})(?=([\s\S]{{0,{v.reach}}}))")
    asked = F.arrays_zip(F.regexp_extract_all(c, behind, F.lit(1)).alias("cue"), F.regexp_extract_all(c, behind, F.lit(2)).alias("tail"))
    about = lambda x: F.when(x["tail"].rlike(v.action), F.regexp_extract(x["tail"], f"({v.action})", 1)).otherwise(F.regexp_extract(x["tail"], r"([0-9\p{L}]{2,20})", 1))
    slots = F.size(F.array_distinct(F.transform(asked, lambda x: F.concat_ws(":", x["cue"], about(x)))))
    nouns = F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(v.nominal), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))))
    kinds = lambda rules: F.size(_found(c, {n: (p,) for n, p in rules.items()}))
    out = held.withColumn("demand_slots", F.greatest(slots, nouns)).withColumn("demand_families", kinds(v.families)).withColumn("demand_outputs", kinds(v.outputs)).withColumn("demand_length", F.length(c))
    whole, part, families, outputs = v.long
    dense = (F.length("__t") >= whole) & (F.col("demand_length") >= part) & (F.col("demand_families") >= families) & (F.col("demand_outputs") >= outputs)
    return out.withColumn("overload_warning", ((F.col("demand_slots") >= v.slots) & (F.col("demand_families") >= v.kinds)) | dense).drop("__t", "__d")


@dataclass(frozen=True)
class Relation:
    """An act on an object: groups of markers that must all occur, and how far apart an object and an act may stand."""

    objects: tuple[tuple[str, ...], ...]
    actions: tuple[tuple[str, ...], ...]
    distance: int = 100
    same_clause: bool = False


def _marks(group: tuple[str, ...]) -> str:
    return "|".join(re.escape("".join(m.lower().split())) for m in group)


def relation_hit(c: Column, r: Relation, negation: str = NOTHING, clauses: str = r"[.!?]+") -> Column:
    """Q4: whether a marker of an act that is not taken back stands on, or at most ``distance`` characters from, one of an object; white space is not counted.

    ``negation`` is a pattern of what, right behind an act, takes it back. In one
    clause, where ``same_clause``. One pattern with a bounded gap is sought each way, and one for markers that overlap, so no lists of places are held.
    """
    if not r.objects or not r.actions or r.distance < 0:
        return F.lit(False)
    stays = f"(?!{negation})"
    objects, actions = (f"(?:{_marks(sum(g, ()))})" for g in (r.objects, r.actions))
    actions += stays
    gap = f".{{0,{r.distance}}}"
    over = [rf"(?={re.escape(m)}).{{0,{len(m) - 1}}}{actions}" for m in ("".join(x.lower().split()) for g in r.objects for x in g) if m]
    over += [rf"(?={re.escape(m)}{stays}).{{0,{len(m) - 1}}}{objects}" for m in ("".join(x.lower().split()) for g in r.actions for x in g) if m]
    near = "(?s)" + "|".join([objects + gap + actions, actions + gap + objects, *over])

    def hit(t: Column) -> Column:
        out = t.rlike(near)
        for g in r.objects:
            out &= t.rlike(_marks(g))
        for g in r.actions:
            out &= t.rlike(f"(?:{_marks(g)}){stays}")
        return out

    low = F.lower(X.text_or_empty(c))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return F.exists(F.transform(F.split(low, clauses), bare), hit) if r.same_clause else hit(bare(low))


@dataclass(frozen=True)
class Measurement:
    """What a question must show. ``methods``: groups of markers of a method's task; ``kinds``: groups, by kind of factor, that
    stand beside its name; ``relations``: acts by method that will do instead of all groups; ``asks``: how an answer is asked for;
    ``shallow``: what only restates the factor; ``report``: what does so right behind its name; ``idle``: words of a name that tell nothing."""

    methods: dict[str, tuple[tuple[str, ...], ...]]
    kinds: dict[str, tuple[tuple[str, ...], ...]]
    asks: str
    relations: dict[str, Relation] = field(default_factory=dict)
    negation: str = NOTHING
    shallow: str = NOTHING
    report: str = NOTHING
    idle: tuple[str, ...] = ()
    least: int = 40
    words: int = 2


CHECKS = (
    "has_question", "has_supported_method", "focus_visible", "ksa_type_operationalized", "observable_task", "elicits_response",
    "sufficient_task_detail", "not_ksa_restatement", "evidence_linked",
)


def measurement(df: DataFrame, question: Column, method: Column, focus: Column, kind: Column, evidence: Column, required: Column, v: Measurement) -> DataFrame:
    """Q4: adds ``group_hits`` (of the method's groups), ``issues`` (names of the nine checks that fail, in order) and ``passed``.

    The focus is visible as a whole without white space, or by ``words`` of its
    words (all, if it has fewer); without words or name it is not. A kind that is
    empty or unknown asks for nothing. Evidence is asked for only where
    ``required``; nulls are empty, or false.
    """
    bare = lambda c: F.lower(F.regexp_replace(X.text_or_empty(c), r"[\s\x01]+", ""))
    held = df.withColumns({"__q": F.lower(F.trim(X.text_or_empty(question))), "__b": bare(question), "__f": bare(focus), "__m": F.trim(X.text_or_empty(method)), "__k": X.text_or_empty(kind)})
    q, b, f, m, k = (F.col(c) for c in ("__q", "__b", "__f", "__m", "__k"))
    hits = lambda c, groups: [c.rlike(_marks(g)) for g in groups]
    group_hits, whole_task, shown = F.array().cast("array<boolean>"), F.lit(False), F.lit(True)
    for name, groups in v.methods.items():
        group_hits = F.when(m == name, F.array(*hits(b, groups))).otherwise(group_hits)
    for name, r in v.relations.items():
        whole_task |= (m == name) & relation_hit(q, r, v.negation)
    rest = F.when(f != "", F.replace(b, f, F.lit(""))).otherwise(b)
    for name, groups in v.kinds.items():
        shown = F.when(k == name, F.forall(F.array(*hits(rest, groups)), lambda x: x)).otherwise(shown)
    named = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(X.text_or_empty(focus)), F.lit(r"[0-9\p{L}]{2,}"), F.lit(0))), lambda w: ~w.isin(*v.idle) if v.idle else F.lit(True))
    seen = F.size(F.filter(named, lambda w: F.contains(b, w)))
    visible = (f != "") & (F.contains(b, f) | ((F.size(named) > 0) & (seen >= F.least(F.lit(v.words), F.size(named)))))
    behind = (f != "") & F.exists(F.slice(F.split(F.replace(b, f, F.lit("\x01")), "\x01"), 2, 1 << 30), lambda t: t.rlike(f"^(?:{v.report})"))
    held = held.withColumn("group_hits", group_hits)
    checks = dict(zip(CHECKS, (
        q != "", m.isin(*v.methods), visible, shown, ((F.size("group_hits") > 0) & F.forall("group_hits", lambda x: x)) | whole_task, q.rlike(v.asks),
        F.length(b) >= v.least, ~q.rlike(v.shallow) & ~behind, ~F.coalesce(required, F.lit(False)) | (F.trim(X.text_or_empty(evidence)) != ""),
    )))
    issues = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in checks.items()]))
    return held.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0).drop("__q", "__b", "__f", "__m", "__k")
