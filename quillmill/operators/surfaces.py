"""What a task is called in public (X16): the noun phrase of a factor, or of what stands in for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import hangul, text as X


@dataclass(frozen=True)
class Phrases:
    """What is put behind a noun phrase, by kind.

    ``rules``: for each kind ordered (pattern, replacement), the first whose
    pattern is found rewrites the phrase; ``default``: what is put behind one
    that no rule fits; ``elements``: behind an element's name; ``competencies``: behind
    a competency's; ``fallback``: the whole surface where nothing is of use. A
    kind that is missing takes the entry of the empty name.
    """

    rules: dict[str, tuple[tuple[str, str], ...]]
    default: dict[str, str]
    elements: dict[str, str]
    competencies: dict[str, str]
    fallback: dict[str, str]
    labels: str = r"\s*\((?:지식|기술|태도)\)$"
    least: int = 3
    most: int = 80


def _by_kind(kind: Column, values: dict[str, str]) -> Column:
    out = F.lit(values.get("", ""))
    for name, v in values.items():
        out = F.when(kind == name, F.lit(v)).otherwise(out)
    return out


def _rewritten(phrase: Column, kind: Column, p: Phrases) -> Column:
    out = F.concat(phrase, _by_kind(kind, p.default))
    for name, rules in p.rules.items():
        fitted = F.concat(phrase, F.lit(p.default.get(name, p.default.get("", ""))))
        for pattern, put in reversed(rules):
            fitted = F.when(phrase.rlike(pattern), F.regexp_replace(phrase, pattern, put)).otherwise(fitted)
        out = F.when(kind == name, fitted).otherwise(out)
    return F.when(phrase != "", out)


def task_objects(df: DataFrame, factor: Column, kind: Column, element: Column, definition: Column, competency: Column, p: Phrases) -> DataFrame:
    """Adds ``surface`` and its ``tag``: factor_repair, element_name, competency_definition, competency_name or safe_fallback.

    A clause is turned into a noun phrase by the transducer of endings. A surface
    is of use if its length is within bounds and it does not repeat the factor's
    own name. Nulls and blanks are skipped. The only Python is one pass over the
    factors and the definitions.
    """
    blank = lambda c: F.trim(F.regexp_replace(X.text_or_empty(c), r"\s+", " "))
    own = lambda c: F.trim(F.regexp_replace(blank(c), p.labels, ""))
    nouns = hangul.nominaliser()
    held = df.withColumn("__factor", blank(factor)).withColumn("__kind", X.text_or_empty(kind)).withColumn("__f", nouns(own(factor))["text"]).withColumn("__d", nouns(own(definition))["text"])
    k, name, known = F.col("__kind"), blank(competency), blank(element)
    useful = lambda c: F.length(c).between(p.least, p.most) & (X.squeezed(c) != X.squeezed(F.col("__factor")))
    candidates = [
        ("factor_repair", _rewritten(F.col("__f"), k, p)), ("element_name", F.when(known != "", F.concat(known, _by_kind(k, p.elements)))),
        ("competency_definition", F.when(F.col("__d") != "", F.concat(F.col("__d"), _by_kind(k, p.default)))), ("competency_name", F.when(name != "", F.concat(name, _by_kind(k, p.competencies)))),
    ]
    chosen = X.first_useful(candidates, useful, ("safe_fallback", _by_kind(k, p.fallback)))
    return held.withColumn("__s", chosen).withColumn("surface", F.col("__s.surface")).withColumn("tag", F.col("__s.tag")).drop("__s", "__factor", "__kind", "__f", "__d")
