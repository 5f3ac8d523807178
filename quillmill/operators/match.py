"""Resolution of labels against a catalogue, coverage and evidence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.functions.udfs import ratio_reaches, sequence_ratio
from quillmill.operators.automaton import occurrences
from quillmill.operators.nearness import met, numbered_letters, posted
from quillmill.operators.rows import first_wins
from quillmill.sources.staging import stage


def resolve_details(terms: DataFrame, term: str, term_order: str, catalogue: DataFrame, name: str, code: str, order: str, aliases: DataFrame | None = None, alias: str = "alias", target: str = "target", most: int | None = None) -> DataFrame:
    """Terms to catalogue rows by equal keys; a term's aliases count only if its own name found nothing.

    Each code once, for the first term that found it.
    """
    asked = terms.select(F.col(term), F.col(term_order).alias("__t"), X.catalogue_key(F.col(term)).alias("__k")).filter("__k <> ''")
    stock = catalogue.withColumn("__ck", X.catalogue_key(F.col(name)))
    exact = asked.join(stock, F.col("__k") == F.col("__ck")).withColumn("via_alias", F.lit(False))
    if aliases is not None:
        left = asked.join(exact.select("__k").distinct(), "__k", "left_anti")
        named = aliases.select(X.catalogue_key(F.col(alias)).alias("__k"), X.catalogue_key(F.col(target)).alias("__a")).distinct()
        more = left.join(named, "__k").join(stock, F.col("__a") == F.col("__ck")).drop("__a").withColumn("via_alias", F.lit(True))
        exact = exact.unionByName(more.select(*exact.columns))
    kept = first_wins(exact, [F.col(code)], [F.col("__t"), F.col(order)])
    return (kept.orderBy("__t", order).limit(most) if most else kept).drop("__k", "__ck", "__t")


#: Characters of terms up to which they are sent to every task; more are shuffled.
MOST_SENT = 1_000_000


def holding(texts: DataFrame, text: str, terms: DataFrame, term: str, n: int = 2, most_heads: int = 0, most_sent: int = MOST_SENT) -> DataFrame:
    """Each text beside each term that it holds, also inside a word, by an equi-join on the term's first ``n`` characters.

    Terms of fewer characters are left out. Where the terms are a dictionary,
    ``most_heads`` lets their beginnings, if they are no more than that, be
    sought in a text one by one; the result is the same. Terms are measured
    first and sent to every task if they have up to ``most_sent`` characters.
    The texts' pieces never are, whatever size Spark expects of them: it does
    not count that they are many to a text.
    """
    asked = terms.filter(F.length(term) >= n).withColumn("__piece", F.substring(term, 1, n))
    pieces = X.pieces(F.col(text), n)
    if most_heads:
        heads = [r[0] for r in asked.select("__piece").distinct().limit(most_heads + 1).collect()]  # at most that many
        if len(heads) <= most_heads:
            pieces = F.filter(F.array(*[F.lit(h) for h in heads]).cast("array<string>"), lambda h: F.col(text).contains(h))
    size = asked.agg(F.coalesce(F.sum(F.length(term)), F.lit(0))).collect()[0][0]
    sought = F.broadcast(asked) if size <= most_sent else asked.hint("merge")
    return texts.withColumn("__piece", F.explode(pieces)).join(sought, "__piece").filter(F.col(text).contains(F.col(term))).drop("__piece")


def suggestions(terms: DataFrame, term: str, catalogue: DataFrame, name: str, unit: str) -> DataFrame:
    """Catalogue rows whose name or unit holds a term, by their keys, with flags for exact detail and unit names."""
    asked = terms.select(F.col(term), X.catalogue_key(F.col(term)).alias("__k")).distinct()
    stock = catalogue.select("*", F.concat_ws("\n", X.catalogue_key(F.col(name)), X.catalogue_key(F.col(unit))).alias("__text"))
    hits = holding(stock, "__text", asked, "__k").withColumn("exact_detail", X.catalogue_key(F.col(name)) == F.col("__k")).withColumn("exact_unit_name", X.catalogue_key(F.col(unit)) == F.col("__k"))
    return hits.drop("__text", "__k").distinct()


def lookup_class(terms: DataFrame, term: str, classes: DataFrame, name: str, code: str, order: str, least: int = 4, ratio: float = 0.8) -> DataFrame:
    """Equal keys first (confidence 1), else names of similar length that hold or are held (0.85); first in order.

    Containment is tried only for terms without an equal key, against classes
    that share a 4-character piece, so it is an equi-join.
    """
    asked = terms.select(F.col(term), X.label_key(F.col(term)).alias("__k")).filter("__k <> ''").distinct()
    stock = classes.select(F.col(name), F.col(code), F.col(order).alias("__o"), X.label_key(F.col(name)).alias("__c")).filter("__c <> ''")
    exact = asked.join(stock, F.col("__k") == F.col("__c")).withColumn("confidence", F.lit(1.0))
    piece = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(c, i, F.lit(least)))
    open_ = asked.join(exact.select("__k").distinct(), "__k", "left_anti").filter(F.length("__k") >= least).withColumn("__p", F.explode(F.array_distinct(piece(F.col("__k")))))
    long_ = stock.filter(F.length("__c") >= least).withColumn("__p", F.explode(F.array_distinct(piece(F.col("__c")))))
    near = F.least(F.length("__k"), F.length("__c")) / F.greatest(F.length("__k"), F.length("__c")) >= ratio
    held = open_.join(long_, "__p").filter((F.col("__c").contains(F.col("__k")) | F.col("__k").contains(F.col("__c"))) & near).drop("__p").distinct().withColumn("confidence", F.lit(0.85))
    both = exact.unionByName(held.select(*exact.columns))
    best = F.row_number().over(Window.partitionBy("__k").orderBy(F.desc("confidence"), "__o"))
    return both.withColumn("__rn", best).filter("__rn = 1").select(term, code, name, "confidence")


def _contained(asked: DataFrame, stock: DataFrame) -> DataFrame:
    """Pairs (__k, __c) of distinct keys of which one holds the other, by automata in both directions."""
    terms, names = asked.select("__k").distinct(), stock.select("__c").distinct()
    held = occurrences(terms, "__k", F.col("__k"), names, F.col("__c")).select("__k", F.col("name").alias("__c"))
    holding_ = occurrences(names, "__c", F.col("__c"), terms, F.col("__k")).select(F.col("name").alias("__k"), "__c")
    return held.unionByName(holding_).distinct()


def fuzzy_classes(terms: DataFrame, term: str, term_order: str, classes: DataFrame, name: str, code: str, order: str, least: float = 0.62, bars: tuple[float, ...] = (0.9, 0.8, 0.7)) -> DataFrame:
    """The best class of each term by 1 (equal), 0.86 (containment) or the sequence ratio; each code once.

    Equal keys are joined and contained ones found by automata. The rest is
    sought at falling ``bars``: an index of rare letters yields all classes whose
    ratio can reach the bar, so a term that has a score as high is settled and
    goes no further down. Neither side is limited in size.
    """
    asked = terms.select(F.col(term), F.col(term_order).alias("__t"), X.label_key(F.col(term)).alias("__k")).filter("__k <> ''")
    stock = classes.select(F.col(name), F.col(code), F.col(order).alias("__o"), X.label_key(F.col(name)).alias("__c")).filter("__c <> ''")
    number = lambda df, c, n: stage(df.select(F.lit("").alias("s"), F.col(c).alias("t")).distinct().withColumn("id", F.monotonically_increasing_id()).withColumn("o", F.col("id")), n)
    queries, known = number(asked, "__k", "fuzzy-terms"), number(stock, "__c", "fuzzy-names")
    scored = stage(_contained(asked, stock).withColumn("score", F.when(F.col("__k") == F.col("__c"), 1.0).otherwise(0.86)), "fuzzy-contained")
    top = scored.groupBy("__k").agg(F.max("score").alias("top"))
    for bar in [*(b for b in bars if b > least), least]:
        open_ = stage(queries.join(top.filter(F.col("top") >= bar), F.col("t") == F.col("__k"), "left_anti"), "fuzzy-open")
        shares = bar / (2 - bar)
        pairs = met(*posted(open_, known, numbered_letters("t"), shares), shares, False)
        full = pairs.join(open_.select("id", F.col("t").alias("__k")), "id").join(known.select(F.col("id").alias("other"), F.col("t").alias("__c")), "other")
        near = full.filter(ratio_reaches("__k", "__c", F.lit(bar))).select("__k", "__c", F.round(sequence_ratio("__k", "__c"), 6).alias("score"))
        # a pair of which one holds the other has its fixed score
        new = stage(near.join(scored.select("__k", "__c"), ["__k", "__c"], "left_anti"), "fuzzy-near")
        scored = scored.unionByName(new)
        top = stage(scored.groupBy("__k").agg(F.max("score").alias("top")), "fuzzy-top")
    pairs = asked.join(scored.filter(F.col("score") >= least), "__k").join(stock, "__c").withColumnRenamed("score", "confidence")
    best = pairs.groupBy(term, "__t").agg(F.max_by(F.struct(code, name, "confidence"), F.struct("confidence", -F.col("__o"))).alias("b"))
    return first_wins(best.select(term, "__t", "b.*"), [F.col(code)], [F.col("__t")]).drop("__t")


def pick_classes(terms: DataFrame, term: str, classes: DataFrame, name: str, code: str) -> DataFrame:
    """Classes equal to a term (1.0) or holding or held by one (0.8), by automata in both directions."""
    asked = terms.select(X.label_key(F.col(term)).alias("__k")).filter("__k <> ''").distinct()
    stock = classes.select(F.col(name), F.col(code), X.label_key(F.col(name)).alias("__c")).filter("__c <> ''")
    best = _contained(asked, stock).groupBy("__c").agg(F.max(F.when(F.col("__k") == F.col("__c"), 1.0).otherwise(0.8)).alias("confidence"))
    return stock.join(best, "__c").groupBy(code, name).agg(F.max("confidence").alias("confidence"))


def coverage(requested: DataFrame, term: str, order: str, items: DataFrame, columns: list[str]) -> DataFrame:
    """Each requested term, first of equal keys, and whether any of the columns covers it."""
    asked = first_wins(requested, [X.coverage_key(F.col(term))], [F.col(order)]).withColumn("__k", X.coverage_key(F.col(term)))
    covered = items.select(F.explode(F.array(*[X.coverage_key(F.col(c)) for c in columns])).alias("__k")).filter("__k <> ''").distinct().withColumn("__c", F.lit(True))
    return asked.join(covered, "__k", "left").withColumn("matched", F.coalesce("__c", F.lit(False))).drop("__k", "__c")


def top_up(planned: DataFrame, term: str, units: DataFrame, detail: str, chosen: DataFrame, unit: str, order: str) -> DataFrame:
    """For each planned term that no chosen unit covers, the first candidate unit."""
    key = X.coverage_key
    have = units.join(chosen.select(unit), unit, "left_semi").select(key(F.col(detail)).alias("__k")).distinct()
    missing = planned.select(F.col(term), key(F.col(term)).alias("__k")).distinct().join(have, "__k", "left_anti")
    first = units.withColumn("__k", key(F.col(detail))).groupBy("__k").agg(F.min_by(unit, order).alias(unit))
    return missing.join(first, "__k").select(term, unit)


def pick_round_robin(requests: DataFrame, detail: str, offset: str, pool: DataFrame, pool_detail: str, tier: str, unit: str, order: str) -> DataFrame:
    """The unit at offset mod n of the best tier of each detail's pool."""
    best = pool.withColumn("__b", F.min(tier).over(Window.partitionBy(pool_detail))).filter(F.col(tier) == F.col("__b"))
    numbered = best.withColumn("__i", F.row_number().over(Window.partitionBy(pool_detail).orderBy(order)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(pool_detail)))
    sized = numbered.groupBy(F.col(pool_detail).alias("__d")).agg(F.max("__n").alias("__size"))
    asked = requests.join(sized, F.col(detail) == F.col("__d")).withColumn("__want", F.col(offset) % F.col("__size"))
    return asked.join(numbered.select(F.col(pool_detail).alias("__pd"), "__i", unit), (F.col("__pd") == F.col("__d")) & (F.col("__i") == F.col("__want"))).drop("__d", "__pd", "__i", "__want", "__size")


def _parts(keys: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """Each key beside its distinct substrings ``__part`` of the given lengths."""
    sized = keys.withColumn("__l", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(key))))
    cut = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - F.col("__l") + 1), lambda i: F.array_join(F.slice(chars, i, F.col("__l")), ""))
    all_ = F.get(F.transform(F.array(F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0))), cut), F.lit(0))
    return sized.withColumn("__part", F.explode(F.array_distinct(all_))).drop("__l")


def _lengths(keys: DataFrame, key: str) -> list[int]:
    """The distinct lengths of keys: no more than the longest key has characters."""
    return sorted(r[0] for r in keys.select(F.length(key)).distinct().collect())


def attach_evidence(questions: DataFrame, q_id: str, q_code: str, q_label: str, preferred: str, evidence: DataFrame, e_id: str, e_code: str, e_text: str, order: str, most: int = 3) -> DataFrame:
    """Up to ``most`` rows of evidence of the question's code: its own id, then texts that hold or are held by its label, then the rest.

    Questions never meet all the evidence of their code. If a question has k
    rows of its own id and k < ``most``, at most k of the rows that hold its
    label, or of all, are among those; so the first ``most`` that fit a (code,
    label), and the first ``most`` of a code, are enough to go on with. Labels
    and texts that hold one another are found by equal substrings.
    """
    asked = questions.withColumn("__a", X.surface_key(F.col(q_label)))
    known = evidence.withColumn("__b", X.surface_key(F.col(e_text)))
    columns = [*questions.columns, *evidence.columns]
    own = F.coalesce(F.col(e_id) == F.col(preferred), F.lit(False))
    held = (F.col("__a") != "") & (F.col("__b") != "") & (F.col("__a").contains(F.col("__b")) | F.col("__b").contains(F.col("__a")))

    def firsts(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__rn") <= most).drop("__rn")

    # names apart from the questions' own, whatever these are called
    labels = asked.select(F.col(q_code).alias("__qc"), F.col("__a").alias("__qa")).filter("__qc is not null and __qa <> ''").distinct()
    stock = firsts(known.filter("__b <> ''"), e_code, "__b")
    texts = stock.select(F.col(e_code).alias("__ec"), F.col("__b").alias("__eb")).filter("__ec is not null").distinct()
    short, long_ = _lengths(texts, "__eb"), _lengths(labels, "__qa")
    reach = max(long_, default=0)
    within = _parts(labels, "__qa", [n for n in short if n <= reach]).join(texts.hint("merge"), (F.col("__qc") == F.col("__ec")) & (F.col("__part") == F.col("__eb")))
    # equal keys are found above
    around = _parts(texts, "__eb", long_).filter(F.length("__part") < F.length("__eb")).join(labels.hint("merge"), (F.col("__qc") == F.col("__ec")) & (F.col("__part") == F.col("__qa")))
    pairs = within.select("__qc", "__qa", "__eb").unionByName(around.select("__qc", "__qa", "__eb"))
    fitting = firsts(pairs.join(stock.hint("merge"), (F.col("__qc") == F.col(e_code)) & (F.col("__eb") == F.col("__b"))), "__qc", "__qa").drop("__eb")

    same = F.col(q_code) == F.col(e_code)
    zero = asked.join(known.hint("merge"), same & (F.col(preferred) == F.col(e_id))).select(*columns, F.lit(0).alias("tier"))
    one = asked.join(fitting.hint("merge"), (F.col(q_code) == F.col("__qc")) & (F.col("__a") == F.col("__qa"))).filter(~own).select(*columns, F.lit(1).alias("tier"))
    rest = asked.join(firsts(known, e_code).hint("merge"), same).filter(~own & ~held).select(*columns, F.lit(2).alias("tier"))
    rn = F.row_number().over(Window.partitionBy(q_id).orderBy("tier", order))
    return zero.unionAll(one).unionAll(rest).withColumn("place", rn).filter(F.col("place") <= most)


def merge_order(ranked: DataFrame, code: str, rank: str, external: DataFrame, position: str) -> DataFrame:
    """Rows by their position in an external list, the others behind it by rank; the list is short."""
    return ranked.join(external.select(code, F.col(position).alias("__p")), code, "left").orderBy(F.col("__p").isNull(), "__p", rank)


def member_map(docs: DataFrame, doc: str, text: str, header: str, label: Column) -> DataFrame:
    """Members of an archive text, cut at header lines, and the labels found in each: label to its members in order."""
    from quillmill.operators.documents import lines

    rows = lines(docs, doc, text).withColumn("__m", F.nullif(F.regexp_extract("content", header, 1), F.lit("")))
    filled = rows.withColumn("member", F.last("__m", ignorenulls=True).over(Window.partitionBy(doc).orderBy("line"))).withColumn("label", label)
    hits = filled.filter("member is not null and label is not null and __m is null").groupBy(doc, "label", "member").agg(F.min("line").alias("at"))
    return hits.groupBy(doc, "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda x: x["member"]), "; ").alias("members"))


def gap_class(details: DataFrame, detail: str, specialised: DataFrame, canonical: DataFrame, unit_names: DataFrame, known: DataFrame, suggested: DataFrame) -> DataFrame:
    """T10d: the first diagnosis that fits an unmatched label; each reference set has a ``name`` column."""
    out = details.withColumn("__k", X.gap_key(F.col(detail)))
    # Names of the diagnoses, in order.
    names = ["specialized_label", "catalog_gap_verified_source_label", "unit_name_only", "known_manual_review_catalog_gap", "semantic_suggestion_unverified"]
    for i, ref in enumerate((specialised, canonical, unit_names, known, suggested)):
        keys = ref.select(X.gap_key(F.col("name")).alias("__k")).distinct().withColumn(f"__{i}", F.lit(True))
        out = out.join(keys, "__k", "left")
    diagnosis = F.lit("catalog_gap_or_nonstandard_source_label")
    for i in range(4, -1, -1):
        diagnosis = F.when(F.col(f"__{i}"), names[i]).otherwise(diagnosis)
    return out.withColumn("diagnosis", diagnosis).drop("__k", *[f"__{i}" for i in range(5)])


def match_diagnostics(terms: DataFrame, term: str, resolved: DataFrame, code: str, suggested: DataFrame, name: str) -> DataFrame:
    """T11d: for each label its exact codes and, beside them, the names suggested."""
    exact = resolved.groupBy(term).agg(F.array_join(F.sort_array(F.collect_set(F.col(code).cast("string"))), "; ").alias("codes"))
    near = suggested.groupBy(term).agg(F.array_join(F.sort_array(F.collect_set(name)), "; ").alias("suggested"))
    status = F.when(F.col("codes").isNotNull(), "exact").when(F.col("suggested").isNotNull(), "suggested").otherwise("unmatched")
    return terms.select(term).distinct().join(exact, term, "left").join(near, term, "left").withColumn("status", status)
