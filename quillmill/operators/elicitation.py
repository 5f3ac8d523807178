"""Whether a prompt asks for what its evaluation points score (Q6): atoms of points against demands of clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X

#: What an atom is whose text fits no kind.
OTHER = "unclassified"


@dataclass(frozen=True)
class Kinds:
    """Patterns by which atoms and demands are told; all on lower-case text.

    ``kinds``: name to pattern, the first that fits is an atom's; ``traits``:
    what nobody can observe; ``split``: between the atoms of a point; ``clauses``:
    between the clauses of a prompt; ``one`` and ``some``: a clause that asks for
    one of several, or leaves open how many; ``number``: a pattern whose first
    group is how many are asked for. What a quantifier speaks of stands behind it.
    """

    kinds: dict[str, str]
    traits: str = r"^$"
    split: str = r"\s*[,/;]\s*| and "
    clauses: str = r"[.?!;\n]+"
    one: str = r"\b(?:one of|either)\b"
    some: str = r"\b(?:which of|some of)\b"
    number: str = r"\b([0-9]+) of\b"


def _told(c: Column, kinds: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in kinds.items()]))


def elicitation(df: DataFrame, key: str, points: str, prompts: str, v: Kinds, count: int | None = 4, anchors: str | None = None) -> DataFrame:
    """Q6: for each item the state of its atoms and the decision.

    ``points`` and ``prompts`` are arrays of texts. Points are split into atoms and
    prompts into clauses; an atom is matched by a clause of its kind, and one of
    no kind by a clause that shares a word with it. Of a point of several atoms
    those that only a clause asking for fewer of them matches are out of the
    quantifier's scope; where all its clauses leave open how many, it is to be
    reviewed. A trait is never matched. Anchors (an array of texts) may tell no kinds
    that neither points nor prompts do. ``count`` points are asked for (null: any number).

    Atoms and clauses of one item meet inside its row, so nothing is joined.
    Null arrays are empty. Returns ``key, atoms, matched, review, unmatched, issues`` (sorted codes)
    and ``decision``: fail, review or pass.
    """
    none = F.array().cast("array<string>")
    texts = lambda c: F.filter(F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(F.trim(X.text_or_empty(x)))), lambda x: x != "")
    parts = lambda x: F.filter(F.transform(F.split(x, v.split), lambda a: F.trim(a)), lambda a: a != "")
    clauses = F.filter(F.transform(F.flatten(F.transform(texts(prompts), lambda x: F.split(x, v.clauses))), lambda x: F.trim(x)), lambda x: x != "")

    def demand(x: Column) -> Column:
        asked = F.regexp_extract(x, v.number, 1)
        how = F.when(asked != "", v.number).when(x.rlike(v.one), v.one).when(x.rlike(v.some), v.some)
        behind = F.when(how.isNull(), "").when(asked != "", F.regexp_extract(x, rf"(?:{v.number})(.*)$", 2)).when(x.rlike(v.one), F.regexp_extract(x, rf"(?:{v.one})(.*)$", 1)).otherwise(F.regexp_extract(x, rf"(?:{v.some})(.*)$", 1))
        # how many are asked for: null is all, 0 is open
        n = F.when(asked != "", asked.cast("int")).when(x.rlike(v.one), 1).when(x.rlike(v.some), 0)
        return F.struct(_told(x, v.kinds).alias("kinds"), X.tokens(x).alias("words"), n.cast("int").alias("n"), _told(behind, v.kinds).alias("n_kinds"), X.tokens(behind).alias("n_words"))

    items = df.select(key, texts(points).alias("__points"), F.transform(clauses, demand).alias("__demands"), (texts(anchors) if anchors else none).alias("__anchors"))
    each = items.select(key, "__demands", F.explode("__points").alias("__p")).select(key, "__demands", parts(F.col("__p")).alias("__parts"))
    atoms = each.select(key, "__demands", F.size("__parts").alias("__of"), F.explode("__parts").alias("__a"))
    kind = F.coalesce(F.get(_told(F.col("__a"), v.kinds), 0), F.lit(OTHER))
    atoms = atoms.withColumn("__kind", kind).withColumn("__words", X.tokens(F.col("__a"))).withColumn("__trait", F.col("__a").rlike(v.traits) & (F.col("__kind") == OTHER))
    other = F.col("__kind") == OTHER
    fits = lambda kinds, words: F.when(other, F.arrays_overlap(words, "__words")).otherwise(F.array_contains(kinds, F.col("__kind")))
    near = F.filter("__demands", lambda d: fits(d["kinds"], d["words"]))
    # how many of the point's atoms each matching clause asks for: null is all
    asked = F.transform(near, lambda d: F.when(d["n"].isNotNull() & fits(d["n_kinds"], d["n_words"]), d["n"]))
    state = (
        F.when(F.col("__trait"), "unobservable_trait").when(F.size("__asked") == 0, "unelicited_atom")
        .when((F.col("__of") > 1) & F.forall("__asked", lambda n: F.coalesce((n > 0) & (n < F.col("__of")), F.lit(False))), "quantifier_scope_mismatch")
        .when((F.col("__of") > 1) & F.forall("__asked", lambda n: F.coalesce(n == 0, F.lit(False))), "ambiguous_quantifier_scope").otherwise("matched")
    )
    judged = atoms.withColumn("__asked", asked).withColumn("__state", state)
    n = lambda *s: F.count_if(F.col("__state").isin(*s))
    facts = judged.groupBy(key).agg(
        F.count("*").alias("atoms"), n("matched").alias("matched"), n("ambiguous_quantifier_scope").alias("review"),
        n("unobservable_trait", "unelicited_atom", "quantifier_scope_mismatch").alias("unmatched"), F.collect_set(F.when(F.col("__state") != "matched", F.col("__state"))).alias("__issues"),
        F.collect_set(F.when(~F.col("__trait"), F.col("__kind"))).alias("__kinds"),
    )
    out = items.join(facts, key, "left")
    told = F.array_union(F.coalesce("__kinds", none), F.flatten(F.transform("__demands", lambda d: d["kinds"])))
    drift = F.exists("__anchors", lambda a: F.size(F.array_except(_told(a, v.kinds), told)) > 0)
    own = F.array(
        F.when(F.lit(count is not None) & (F.size("__points") != F.lit(count or 0)), "point_count_mismatch"), F.when(F.size("__demands") == 0, "missing_demand"), F.when(drift, "guide_scope_drift"),
    )
    issues = F.array_sort(F.array_union(F.array_compact(own), F.coalesce("__issues", none)))
    hard = F.size(F.array_except("issues", F.array(F.lit("ambiguous_quantifier_scope")))) > 0
    decision = F.when(hard, "fail").when(F.size("issues") > 0, "review").otherwise("pass")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.withColumn("issues", issues).select(key, zero("atoms"), zero("matched"), zero("review"), zero("unmatched"), "issues", decision.alias("decision"))
