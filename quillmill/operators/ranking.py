"""Windows, ranking and top-k. Greedy loops are written in their closed window forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.sources.staging import stage


def stratified_sample(df: DataFrame, stratum: str, kind: str, order: list[Column], per_cell: int, strata: int) -> DataFrame:
    """The first rows of each (stratum, kind) within the first strata."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(stratum, kind).orderBy(*order)))
    cut = ranked.filter(F.col("__rn") <= per_cell)
    # one row for each stratum: the numbering never gathers the table
    numbers = df.select(stratum).distinct().orderBy(stratum).limit(strata)
    return cut.join(F.broadcast(numbers), stratum, "left_semi").drop("__rn")


#: Distinct grams up to which their weights are sent to every task; more are shuffled.
MOST_GRAMS = 200_000


def tfidf(docs: DataFrame, doc_id: str, text: Column, query: DataFrame, query_text: Column, low: int = 2, high: int = 4, keep: tuple[str, ...] = (), most_grams: int = MOST_GRAMS) -> DataFrame:
    """Cosine of character n-gram TF-IDF between one query row and every document.

    tf = 1 + ln(count), idf = ln((N + 1) / (df + 1)) + 1; query grams that no
    document holds are left out; documents are normed over all their grams.
    Returns ``doc_id, sim`` and the columns ``keep`` for every document, 0
    without a common gram. Equal texts are weighed once; a text's grams stay in
    the task that has the text, and only the grams' counts are shuffled. Sizes
    are counted first, since Spark does not expect a text to have many grams.
    """
    named = docs.select(doc_id, *keep, X.label_key(text).alias("__t"))
    texts = named.groupBy("__t").agg(F.count("*").alias("__n"))
    # grouped by text and gram, rows stay where the texts were grouped
    terms = texts.select("__t", "__n", F.explode(X.char_ngrams(F.col("__t"), low, high)).alias("g")).groupBy("__t", "g").agg(F.max("__n").alias("__n"), (1 + F.log(F.count("*"))).alias("tf"))
    total = docs.agg(F.count("*").alias("n_docs"))
    idf = stage(terms.groupBy("g").agg(F.sum("__n").alias("df")).crossJoin(F.broadcast(total)).select("g", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    few = idf.count() <= most_grams
    asked = (
        query.select(F.explode(X.char_ngrams(query_text, low, high)).alias("g")).groupBy("g").agg((1 + F.log(F.count("*"))).alias("qtf"))
        .join(idf, "g").select("g", (F.col("qtf") * F.col("idf")).alias("qw"))
    )
    query_norm = asked.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    weighed = idf.join(asked, "g", "left").select("g", "idf", "qw")
    # norm and product of a text in one pass over its grams
    weights = terms.join(F.broadcast(weighed) if few else weighed.hint("merge"), "g").withColumn("w", F.col("tf") * F.col("idf"))
    sums = weights.groupBy("__t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = sums.filter("dot is not null").crossJoin(F.broadcast(query_norm)).select("__t", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("sim"))
    return named.join(scored, "__t", "left").select(doc_id, *keep, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Min-max scale; without a range a value in 0..1 stays, another positive one is 1, else 0."""
    flat = F.when(score.between(0, 1), score).when(score > 0, 1.0).otherwise(0.0)
    return F.when(high > low, (score - low) / (high - low)).otherwise(flat)


def rank_units(df: DataFrame, sim: str, source: str, preferred: Column, weight: float = 0.88, penalty: float = 0.15, digits: int = 6, base: DataFrame | None = None) -> DataFrame:
    """Mixed score of similarity and scaled source score, less a penalty outside the preferred class.

    Adds ``source_norm`` and ``score`` (rounded); ``unit_order`` ranks the rows.
    ``base`` is a table with the same source scores, so that their range is
    found without computing similarities once more.
    """
    bounds = (base if base is not None else df).agg(F.min(source).alias("__low"), F.max(source).alias("__high"))
    scaled = df.crossJoin(F.broadcast(bounds)).withColumn("source_norm", min_max(F.col(source), F.col("__low"), F.col("__high")))
    mixed = weight * F.col(sim) + (1 - weight) * F.col("source_norm") - F.when(preferred, 0.0).otherwise(penalty)
    return scaled.withColumn("score", F.round(mixed, digits)).drop("__low", "__high")


def unit_order(sim: str, ordinal: str, digits: int = 6) -> list[Column]:
    """The rank of units: rounded score, rounded similarity and source score descending, then input order."""
    return [F.desc("score"), F.desc(F.round(F.col(sim), digits)), F.desc("source_norm"), F.col(ordinal)]


def top(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows, numbered: only they meet in one task."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def class_cap(k: int, classes: int) -> int:
    return k if classes <= 1 else min(4, max(1, -(-k // classes)))


def diversified(df: DataFrame, group: str, sim: str, order: list[Column], k: int, cap: int, min_sim: float = 0.02) -> DataFrame:
    """W3 (CF1): top k in three passes: similar under the class cap, the rest under the cap, no cap."""
    weak = F.col(sim) < min_sim
    rn = F.row_number().over(Window.partitionBy(group).orderBy(weak, *order))
    tiers = df.withColumn("tier", F.when(rn > cap, 3).when(weak, 2).otherwise(1))
    return tiers.orderBy("tier", *order).limit(k)


def rank_factors(df: DataFrame, unit: str, kind: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """W4 (CF2): per-unit cap with a slot kept for each type not yet seen, then the first n."""
    typed = F.coalesce(F.trim(F.col(kind)), F.lit("")) != ""
    first = typed & (F.row_number().over(Window.partitionBy(unit, kind).orderBy(*order)) == 1)
    marked = df.withColumn("__first", first).withColumn("__kinds", F.count_if("__first").over(Window.partitionBy(unit)))
    by = Window.partitionBy(unit, "__first").orderBy(*order)
    counted = marked.withColumn("__no", F.row_number().over(by))
    room = F.when(F.col("__first"), F.lit(cap)).otherwise(F.greatest(F.lit(0), F.lit(cap) - F.col("__kinds")))
    return counted.filter(F.col("__no") <= room).drop("__no", "__kinds", "__first").orderBy(*order).limit(n)


def balanced(df: DataFrame, kind: str, order: str, kinds: list[str], limit: int) -> DataFrame:
    """W5 (CF3): round robin over the types in their order, untyped rows last."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.coalesce(F.col(kind), F.lit("")))
    rn = F.row_number().over(Window.partitionBy(place).orderBy(order))
    return df.withColumn("__place", place).withColumn("__turn", rn).orderBy(F.col("__place") == 0, F.when(F.col("__place") == 0, F.lit(0)).otherwise(F.col("__turn")), "__place", order).limit(limit).drop("__place", "__turn")


def interleaved(df: DataFrame, element: str, element_order: str, order: str) -> DataFrame:
    """First rows of all elements, then the second ones, and so on; adds ``turn``."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(element).orderBy(order))).orderBy("turn", element_order)


def within_margin(df: DataFrame, group: list[str], confidence: str, order: str, least_confidence: float, margin: float, most: int, least: int) -> DataFrame:
    """Rows near the best confidence, at most ``most`` and at least ``least`` for each group."""
    by = Window.partitionBy(*group)
    rn = F.row_number().over(by.orderBy(F.desc(confidence), order))
    bar = F.greatest(F.lit(least_confidence), F.max(confidence).over(by) - margin)
    return df.withColumn("__rn", rn).withColumn("__bar", bar).filter(((F.col(confidence) >= F.col("__bar")) & (F.col("__rn") <= most)) | (F.col("__rn") <= least)).drop("__rn", "__bar")


def merge_candidates(df: DataFrame, key: str, confidence: str, order: str, most: int) -> DataFrame:
    """First position of each key, its most confident row; reading ends at the key that fills the list."""
    firsts = df.groupBy(key).agg(F.min(order).alias("position"))
    kept = firsts.orderBy("position").limit(most)
    full = kept.agg(F.when(F.count("*") >= most, F.max("position")).alias("__end"))
    read = df.crossJoin(F.broadcast(full)).filter(F.col("__end").isNull() | (F.col(order) <= F.col("__end")))
    best = read.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(confidence), -F.col(order))).alias("best"))
    return kept.join(best, key).select("position", "best.*")


def keyword_overlap(df: DataFrame, doc_id: str, text: Column, keywords: list[str], bonus: Column, extra: Column, limit: int) -> DataFrame:
    """Number of keywords in the text plus a bonus; by score, ``extra`` and id descending."""
    wanted = F.array(*[F.lit(k.lower()) for k in keywords])
    hits = F.size(F.filter(wanted, lambda k: F.lower(X.text_or_empty(text)).contains(k)))
    return df.select(F.col(doc_id), (hits + bonus).cast("double").alias("score"), extra.alias("extra")).orderBy(F.desc("score"), F.desc("extra"), F.desc(doc_id)).limit(limit)


def local_mapper(df: DataFrame, name: Column, keywords: Column, text: Column, order: str, limit: int) -> DataFrame:
    """0.9 if the text holds the name, else 0.5 and 0.15 for each keyword (0.85 at most), else 0.2."""
    hits = F.size(F.filter(keywords, lambda k: text.contains(k)))
    score = F.when(text.contains(name), 0.9).when(hits > 0, F.least(F.lit(0.5) + hits * F.lit(0.15), F.lit(0.85))).otherwise(0.2)
    return df.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), order).limit(limit)


def allocate_counts(labels: DataFrame, order: str, total: int) -> DataFrame:
    """``total`` dealt evenly over labels, the first ones get one more; labels beyond ``total`` go."""
    kept = labels.orderBy(order).limit(total)
    n = kept.agg(F.count("*").alias("__n"))
    rn = F.row_number().over(Window.orderBy(order))  # at most ``total`` rows
    return kept.withColumn("__i", rn - 1).crossJoin(F.broadcast(n)).withColumn("allocated", (F.floor(F.lit(total) / F.col("__n")) + F.when(F.col("__i") < F.lit(total) % F.col("__n"), 1).otherwise(0)).cast("int")).drop("__i", "__n")


def expand_plan(items: DataFrame, label: str, count: str, order: str, cap: int = 50, per_item: int = 10, enabled: Column | None = None) -> DataFrame:
    """Each enabled item of a distinct label as often as it asks for, ``cap`` slots in all; adds ``slot``."""
    from quillmill.operators.rows import first_wins

    usable = items.filter(enabled if enabled is not None else F.lit(True))
    kept = first_wins(usable, [X.dedup_key(F.col(label))], [F.col(order)]).withColumn("__c", X.clamp(F.col(count), 0, per_item).cast("int")).filter("__c > 0")
    # no more than ``cap`` items can have a slot, so the numbering sees few rows
    few = kept.orderBy(order).limit(cap).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__c")))).drop("__c")
    return few.withColumn("slot", F.row_number().over(Window.orderBy(order, "copy"))).filter(F.col("slot") <= cap)


def batches(slots: DataFrame, slot: str, size: int = 5) -> DataFrame:
    """Fixed-size batches of a sequence."""
    return slots.withColumn("batch", F.floor((F.col(slot) - 1) / size).cast("int"))


def newest_unique(df: DataFrame, group: list[str], text: Column, order: str, ring: int = 500) -> DataFrame:
    """The newest ``ring`` rows of each group, then of equal texts the newest."""
    recent = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))).filter(F.col("__rn") <= ring).drop("__rn")
    by = Window.partitionBy(*group, "__key").orderBy(F.desc(order))
    return recent.withColumn("__key", X.question_key(text)).filter("__key <> ''").withColumn("__rn", F.row_number().over(by)).filter("__rn = 1").drop("__rn", "__key")


def nearest_first(df: DataFrame, index: str, targets: list[int], limit: int = 8) -> DataFrame:
    """Targets first, then by distance to the nearest target, then by index."""
    wanted = F.array(*[F.lit(t) for t in targets])
    return df.withColumn("__far", F.array_min(F.transform(wanted, lambda t: F.abs(F.col(index) - t)))).orderBy(F.when(F.col("__far") == 0, 0).otherwise(1), "__far", index).limit(limit).drop("__far")


def line_context(lines: DataFrame, doc: str, line: str, anchor: Column, section: Column) -> DataFrame:
    """Whether a line stands near an anchor (1 before to 8 after it) or a section line (2 either way)."""
    by = Window.partitionBy(doc).orderBy(line)
    return lines.withColumn("near_anchor", F.max(anchor.cast("int")).over(by.rowsBetween(-8, 1)) == 1).withColumn("near_section", F.max(section.cast("int")).over(by.rowsBetween(-2, 2)) == 1)


def context_points(lines: DataFrame, doc: str, line: str, label: str, anchor: Column, section: Column, most: int = 6) -> DataFrame:
    """3 points near an anchor (5 lines), 2 near a section (3), else 1, for each line and label; ``most`` at most."""
    by = Window.partitionBy(doc).orderBy(line).rangeBetween
    near = lines.withColumn("points", F.when(F.max(anchor.cast("int")).over(by(-5, 5)) == 1, 3).when(F.max(section.cast("int")).over(by(-3, 3)) == 1, 2).otherwise(1))
    hit = near.filter(F.col(label).isNotNull()).select(doc, line, label, "points").distinct()
    return hit.groupBy(doc, label).agg(F.least(F.sum("points"), F.lit(most)).alias("score"), F.slice(F.array_sort(F.collect_list(line)), 1, 3).alias("evidence"))


def split_terms(lines: DataFrame, doc: str, line: str, text: Column, dictionary: DataFrame, term: str) -> DataFrame:
    """Dictionary terms broken over two or three lines; three lines win."""
    by = Window.partitionBy(doc).orderBy(line)
    key = X.dedup_key(text)
    wide = lines.withColumn("__1", key).withColumn("__2", F.lead(key, 1).over(by)).withColumn("__3", F.lead(key, 2).over(by))
    spans = wide.select(doc, line, F.explode(F.array(F.struct(F.lit(3).alias("width"), F.concat("__1", "__2", "__3").alias("k")), F.struct(F.lit(2).alias("width"), F.concat("__1", "__2").alias("k")))).alias("s")).select(doc, line, "s.*").filter("k is not null")
    terms = dictionary.select(F.col(term), X.dedup_key(F.col(term)).alias("k")).filter("k <> ''")
    found = spans.join(terms, "k")
    best = F.row_number().over(Window.partitionBy(doc, line).orderBy(F.desc("width"), term))
    return found.withColumn("__rn", best).filter("__rn = 1").select(doc, line, "width", term)


def expand_family(direct: DataFrame, family: DataFrame, key: str, group: str, confidence: str, least: float = 0.6, most: int = 2) -> DataFrame:
    """If there is exactly one direct candidate, add the most confident mentioned members of its family."""
    one = direct.agg(F.count("*").alias("__n"), F.first(group).alias("__g"), F.first(key).alias("__k")).filter("__n = 1")
    more = family.join(F.broadcast(one), F.col(group) == F.col("__g")).filter((F.col(key) != F.col("__k")) & (F.col(confidence) >= least)).orderBy(F.desc(confidence), key).limit(most)
    return direct.unionByName(more.select(*direct.columns))


def assign_slots(slots: DataFrame, slot: str, label: str, methods: list[str], pool: DataFrame, pool_label: str, unit: str, pool_order: str) -> DataFrame:
    """Methods in turn over all slots; units of the slot's label in turn; a slot without a pool keeps a null unit."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(slot)) - 1
    method = F.element_at(F.array(*[F.lit(m) for m in methods]), ((F.col(slot) - 1) % len(methods) + 1).cast("int"))
    sized = pool.groupBy(pool_label).agg(F.array_sort(F.collect_list(F.struct(F.col(pool_order).alias("o"), F.col(unit).alias("u")))).alias("__pool"))
    joined = slots.withColumn("method", method).withColumn("__turn", turn).join(sized, F.col(label) == F.col(pool_label), "left")
    return joined.withColumn("unit", F.when(F.size("__pool") > 0, F.get(F.col("__pool"), (F.col("__turn") % F.size("__pool")).cast("int"))["u"])).drop("__pool", "__turn", pool_label)
