"""Documents to tables: HTML pages, sentences, markdown sections, notice windows, dictionary scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.operators.automaton import occurrences
from quillmill.operators.match import holding

#: The entities that pages use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_text(html: Column) -> Column:
    """Visible text with a line for each block; runs of blanks and blank lines collapse."""
    t = X.replace_closed(X.text_or_empty(html), r"(?is)<(script|style)\b.*?</(script|style)>", ("</script>", "</style>"), " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table)>", "\n")
    t = unescape(X.replace_closed(t, r"<[^>]+>", (">",), " "))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def html_title(html: Column) -> Column:
    """The first heading, else the title."""
    h1, title = (F.nullif(F.trim(unescape(F.regexp_extract(X.text_or_empty(html), p, 1))), F.lit("")) for p in (r"(?is)<h1[^>]*>([^<]*)</h1>", r"(?is)<title[^>]*>([^<]*)</title>"))
    return F.coalesce(h1, title)


def links(pages: DataFrame, page: str, html: Column, pattern: str = r'href="([^"]+)"', within: str | None = None) -> DataFrame:
    """Distinct links of each page, the first of equal ones, with their position; ``within`` scopes them to its first match."""
    scope = F.regexp_extract(X.text_or_empty(html), within, 0) if within else X.text_or_empty(html)
    found = pages.select(page, F.posexplode(F.regexp_extract_all(scope, F.lit(pattern), F.lit(1))).alias("pos", "href"))
    return found.groupBy(page, "href").agg(F.min("pos").alias("pos"))


def requirements(df: DataFrame, doc: str, text: str, markers: tuple[str, ...], most: int | None = 30, longest: int = 180) -> DataFrame:
    """Sentences as items with a weight: 0.2, 0.3 more with a marker, 0.2 more beyond 35 characters; heaviest first."""
    items = df.select(doc, F.posexplode(X.sentences(F.col(text))).alias("pos0", "sentence")).withColumn("item", F.substring("sentence", 1, longest)).withColumn("pos", F.col("pos0") + 1)
    weight = F.lit(0.2) + F.when(X.contains_any(F.col("item"), markers), 0.3).otherwise(0.0) + F.when(F.length("item") > 35, 0.2).otherwise(0.0)
    out = items.withColumn("weight", F.round(F.least(weight, F.lit(1.0)), 4))
    if most is not None:
        out = out.withColumn("__rn", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("weight"), "pos"))).filter(F.col("__rn") <= most).drop("__rn")
    return out.select(doc, "pos", "item", "weight")


def lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Non-blank lines with their number in the text."""
    return df.select(doc, F.posexplode(F.split(X.text_or_empty(F.col(text)), "\n")).alias("line", "content")).withColumn("content", F.trim("content")).filter("content <> ''")


def sections(df: DataFrame, doc: str, text: str, heading: Column) -> DataFrame:
    """T1d: each line under the heading before it, the first of equal lines of a section; headings are not rows."""
    marked = lines(df, doc, text).withColumn("__h", heading)
    filled = marked.withColumn("section", F.last("__h", ignorenulls=True).over(Window.partitionBy(doc).orderBy("line")))
    body = filled.filter("__h is null and section is not null").withColumn("__k", X.document_key(F.col("content")))
    return body.groupBy(doc, "section", "__k").agg(F.min(F.struct("line", "content")).alias("r")).select(doc, "section", "r.line", "r.content")


def notice_windows(df: DataFrame, doc: str, text: str, anchor: Column, heading: Column, span: int = 9, longest: int = 2200, most: int = 4) -> DataFrame:
    """T3d: windows of ``span`` lines at most from each anchor line, cut before the next heading unless it follows at once."""
    marked = lines(df, doc, text).withColumn("__a", F.coalesce(anchor, F.lit(False))).withColumn("__h", F.coalesce(heading, F.lit(False)))
    by = Window.partitionBy(doc).orderBy("line")
    numbered = marked.withColumn("__no", F.row_number().over(by))
    ahead = by.rowsBetween(0, span - 1)
    window = numbered.withColumn("__w", F.collect_list(F.struct("content", "__h")).over(ahead)).filter("__a")
    stop = F.array_position(F.transform(F.slice("__w", 3, span), lambda x: x["__h"]), True)
    cut = F.when(stop > 0, F.slice("__w", 1, (stop + 1).cast("int"))).otherwise(F.col("__w"))
    found = window.withColumn("window", F.substring(F.array_join(F.transform(cut, lambda x: x["content"]), "\n"), 1, longest)).withColumn("__k", X.document_key(F.col("window")))
    first = found.groupBy(doc, "__k").agg(F.min(F.struct("line", "window")).alias("r")).select(doc, "r.line", "r.window")
    return first.withColumn("__rn", F.row_number().over(Window.partitionBy(doc).orderBy("line"))).filter(F.col("__rn") <= most).drop("__rn")


def table_cells(df: DataFrame, doc: str, text: str) -> DataFrame:
    """T2d: cells of pipe tables under the header cell of their column; a line of dashes follows the header."""
    rows = lines(df, doc, text).filter(F.col("content").contains("|")).withColumn("cells", F.transform(F.split(F.regexp_replace("content", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))
    by = Window.partitionBy(doc).orderBy("line")
    rule = F.col("content").rlike(r"^[|:\- ]+$")
    marked = rows.withColumn("__rule", rule).withColumn("__head", F.when(F.lead("__rule").over(by), F.col("cells")))
    filled = marked.withColumn("__head", F.last("__head", ignorenulls=True).over(by)).filter("not __rule and __head is not null and __head <> cells")
    return filled.select(doc, "line", F.posexplode("cells").alias("column", "value"), "__head").select(doc, "line", "column", F.get("__head", F.col("column")).alias("header"), "value").filter("value <> ''")


def dictionary_scores(df: DataFrame, doc: str, text: str, dictionary: DataFrame, alias: str, label: str, official: str, anchor: Column, section: Column, scale: float = 4.5, hints: Column | None = None, filename: Column | None = None) -> DataFrame:
    """T4d, T5d: labels scored by their aliases' occurrences in each line.

    1.2 for an official name, 0.9 for an alias, each occurrence in a line
    without its white space, so also inside compounds and spelled apart, plus
    0.9 on an anchor line or 0.5 on a section line. A label that occurs gains
    0.8 for each alias among the document's ``hints`` (an array) and 0.6 for
    each that its ``filename`` holds. Confidence = score / ``scale`` within
    0.62 to 1. Aliases of one character are left out.
    """
    content = lines(df, doc, text).withColumn("__bonus", F.when(anchor, 0.9).when(section, 0.5).otherwise(0.0)).withColumn("__low", X.squeezed(F.col("content")))
    terms = dictionary.withColumn("__alias", X.squeezed(F.col(alias)))
    hits = holding(content, "__low", terms, "__alias", most_heads=100).withColumn("times", X.occurrences(F.col("__low"), F.col("__alias")))
    each = F.sum(F.col("times") * (F.when(F.col(official), 1.2).otherwise(0.9) + F.col("__bonus")))
    found = hits.groupBy(doc, label).agg(each.alias("score"))
    if hints is not None or filename is not None:
        told = F.transform(hints, lambda x: X.squeezed(x)) if hints is not None else F.array().cast("array<string>")
        named = X.squeezed(filename) if filename is not None else F.lit("")
        about = df.select(doc, told.alias("__hints"), named.alias("__file"))
        aliases = terms.filter("__alias <> ''").groupBy(label).agg(F.collect_set("__alias").alias("__aliases"))  # a dictionary's aliases of one label
        gain = F.aggregate("__aliases", F.lit(0.0), lambda a, x: a + F.when(F.array_contains("__hints", x), 0.8).otherwise(0.0) + F.when(F.col("__file").contains(x), 0.6).otherwise(0.0))
        found = found.join(about, doc).join(aliases, label).select(doc, label, (F.col("score") + F.coalesce(gain, F.lit(0.0))).alias("score"))
    return found.withColumn("score", F.round("score", 4)).withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.62), F.col("score") / scale)), 4))


def contextual_labels(df: DataFrame, doc: str, text: Column, rules: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """T13d: labels of which every group of terms has a hit."""
    low = F.lower(X.text_or_empty(text))
    found = []
    for label, groups in rules.items():
        ok = F.lit(True)
        for g in groups:
            ok &= X.contains_any(low, g)
        found.append(F.when(ok, F.lit(label)))
    return df.select(doc, F.explode(F.array_compact(F.array(*found))).alias("label"))


#: What stands in a cell that is meant to be empty.
BLANK = r"^[\s\-–—_./·|]*$"


def absence_states(df: DataFrame, doc: str, text: str, header: str, table: str, declared: str, sound: Column, found: Column | None = None) -> DataFrame:
    """T9d: why a document has no label, by the states that its lines go through.

    A line is read as cells. A cell that fits ``header`` opens a column (or, as
    ``header: value``, gives a value); the cells after it, or in its column on
    later rows, are values until the next header. States, in the order in which
    they are reached: ``saw_table`` (a row fits ``table``), ``saw_header``,
    ``declared_no_mapping`` (a line fits ``declared``), ``blank_cell`` and
    ``unsound_value`` (a value is empty, or ``sound`` of the column ``value`` is
    false), ``value``. The ``reason`` is that of the state that decides: a value,
    else a declaration, else a value that is unsound, a blank cell, a header
    without any value, a table without a header, an empty document, or nothing
    of all that. ``found`` (a column of ``df``) marks documents that have a label.
    """
    rows = lines(df, doc, text)
    cells = F.when(F.col("content").contains("|"), F.transform(F.split(F.regexp_replace("content", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))).otherwise(F.transform(F.split("content", r"\s*[:：]\s*", 2), lambda x: F.trim(x)))
    at = F.array_position(F.transform("cells", lambda x: x.rlike(header)), True).cast("int") - 1
    by = Window.partitionBy(doc).orderBy("line")
    marked = rows.filter(~(F.col("content").contains("|") & F.col("content").rlike(r"^[|:\- ]+$"))).withColumn("cells", cells).withColumn("__at", F.when(at >= 0, at)).withColumn("__declared", F.col("content").rlike(declared))
    marked = marked.withColumn("__pipe", F.col("content").contains("|")).withColumn("__column", F.last(F.when(F.col("__pipe"), F.col("__at")), ignorenulls=True).over(by))
    none = F.array().cast("array<string>")
    beside = F.slice("cells", F.col("__at") + 2, F.greatest(F.size("cells") - F.col("__at") - 1, F.lit(0)))
    under = F.array(F.get("cells", F.least(F.col("__column"), F.size("cells") - 1)))
    values = F.when(F.col("__declared"), none).when(F.col("__at").isNotNull(), beside).when(F.col("__pipe") & F.col("__column").isNotNull(), under).otherwise(none)
    marked = marked.withColumn("__values", values)
    events = F.array_compact(F.array(F.when(F.col("content").rlike(table) & F.col("__pipe"), "saw_table"), F.when(F.col("__at").isNotNull(), "saw_header"), F.when(F.col("__declared"), "declared_no_mapping")))
    told = marked.select(doc, "line", F.posexplode(events).alias("pos", "state"))
    each = marked.select(doc, "line", F.posexplode("__values").alias("pos", "value"))
    judged = each.select(doc, "line", (F.col("pos") + 3).alias("pos"), F.when(F.col("value").rlike(BLANK), "blank_cell").when(sound, "value").otherwise("unsound_value").alias("state"))
    first = told.unionByName(judged).groupBy(doc, "state").agg(F.min(F.struct("line", "pos")).alias("at"))
    states = first.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "state"))), lambda x: x["state"]).alias("states"))
    out = df.select(doc, (X.squeezed(F.col(text)) == "").alias("__empty"), (F.coalesce(found, F.lit(False)) if found is not None else F.lit(False)).alias("__found")).join(states, doc, "left").withColumn("states", F.coalesce("states", none))
    has = lambda state: F.array_contains("states", state)
    reason = (
        F.when(F.col("__found") | has("value"), "has_label").when(has("declared_no_mapping"), "declared_no_mapping").when(has("unsound_value"), "unsound_value").when(has("blank_cell"), "blank_cell")
        .when(has("saw_header"), "header_without_value").when(has("saw_table"), "table_without_header").when(F.col("__empty"), "empty_document").otherwise("no_sign")
    )
    return out.select(doc, "states", reason.alias("reason"))


def small_classes(df: DataFrame, doc: str, text: str, dictionary: DataFrame, anchor: Column, in_table: Column, synergy: float = 2.0, threshold: float = 3.0, most: int = 5) -> DataFrame:
    """T4d: dictionary scores, more for labels that also stand in a table; those above the threshold, the best ``most``."""
    scored = dictionary_scores(df, doc, text, dictionary, "alias", "label", "official", anchor, F.lit(False)).drop("confidence")
    cells = lines(df, doc, text).filter(in_table).select(doc, X.squeezed(F.col("content")).alias("__low"))
    cells = holding(cells, "__low", dictionary.withColumn("__alias", X.squeezed(F.col("alias"))), "__alias", most_heads=100).select(doc, "label").distinct().withColumn("__t", F.lit(synergy))
    merged = scored.join(cells, [doc, "label"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("__t", F.lit(0.0)), 4)).drop("__t").filter(F.col("score") >= threshold)
    return merged.withColumn("__rn", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "label"))).filter(F.col("__rn") <= most).drop("__rn")


def catalogue_counts(df: DataFrame, doc: str, text: str, names: DataFrame, name: str, hints: Column | None = None, aliases: DataFrame | None = None, most: int | None = None, shortest: int = 2) -> DataFrame:
    """T6d: catalogue names by how often they stand in a text, both without white space and in lower case.

    The score is the number of occurrences. A hint of the document (``hints``,
    an array) that is an ``alias`` of ``aliases`` (alias, target) gives its target 0.95 if
    the catalogue has it. Confidence is a third of a score above 1, else the score, within
    0.62 to 1. Of a name's scores the highest counts; the ``most`` highest stay,
    longer names first among equals. Names of fewer than ``shortest`` characters are left out.
    """
    stock = names.select(F.col(name).alias("__name"), X.squeezed(F.col(name)).alias("__n")).filter(F.length("__n") >= shortest).distinct()
    found = occurrences(df, doc, X.squeezed(F.col(text)), stock, F.col("__n"))
    scored = found.join(stock, F.col("name") == F.col("__n")).select(doc, "__name", "times", F.col("times").cast("double").alias("score"))
    if hints is not None and aliases is not None:
        targets = aliases.select(X.squeezed(F.col("alias")).alias("__a"), X.squeezed(F.col("target")).alias("__t")).distinct().join(stock, F.col("__t") == F.col("__n"))
        told = df.select(doc, F.explode(F.array_distinct(F.transform(hints, lambda h: X.squeezed(h)))).alias("__a")).filter("__a <> ''")
        named = told.join(targets, "__a").select(doc, "__name", F.lit(0).cast("long").alias("times"), F.lit(0.95).alias("score"))
        scored = scored.unionByName(named)
    best = scored.groupBy(doc, F.col("__name").alias(name)).agg(F.max("times").alias("times"), F.max("score").alias("score"))
    if most is not None:
        place = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), F.desc(F.length(name)), name))
        best = best.withColumn("__rn", place).filter(F.col("__rn") <= most).drop("__rn")
    raw = F.when(F.col("score") > 1, F.col("score") / 3).otherwise(F.col("score"))
    return best.select(doc, name, "times", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.62), raw)), 4).alias("confidence"))


def anchor_labels(df: DataFrame, doc: str, text: str, anchor: str, value: str) -> DataFrame:
    """T7d: the value on an anchor line, or the next line if the anchor stands alone."""
    by = Window.partitionBy(doc).orderBy("line")
    rows = lines(df, doc, text).withColumn("__next", F.lead("content").over(by)).filter(F.col("content").rlike(anchor))
    own = F.nullif(F.trim(F.regexp_extract("content", value, 1)), F.lit(""))
    return rows.select(doc, "line", F.coalesce(own, F.col("__next")).alias("label"))


#: A line of a table of contents: leaders or a gap, and a page number.
CONTENTS = r"(?:[.·…‥]{2,}|\s{3,}|\t)\s*[0-9]{1,4}\s*$"


def method_sections(df: DataFrame, doc: str, text: str, method: Column, signals: list[Column], fields: list[Column], term: str, other: Column | None = None, longest: int = 180, terms: int = 3) -> DataFrame:
    """T12d: what a document says about each method that it names.

    A line on which ``method`` is told starts a section if it passes the anchor
    test: no longer than ``longest`` and no line of a table of contents. A section ends at the
    next such line, or where ``other`` (a heading of something else) holds. Its
    score is one for each signal and two for each field that occurs on a line of
    it, and one for each distinct match of the pattern ``term``, ``terms`` at most. If two
    methods of a document (or its only one) have a section that scores, each method
    gets its scoring sections, or all of its own if none scores
    (``low_signal``), or the whole document if it has none; else all get the
    whole document (``full_document``).

    Returns ``doc, method, origin, sections, n_lines, score`` (the highest).
    """
    rows = lines(df, doc, text).withColumn("__m", method)
    rows = rows.withColumn("__anchor", F.coalesce((F.length("content") <= longest) & ~F.col("content").rlike(CONTENTS), F.lit(False)))
    stop = F.coalesce(other, F.lit(False)) if other is not None else F.lit(False)
    start = F.when(F.col("__anchor") & F.col("__m").isNotNull(), F.col("__m")).when(F.col("__anchor") & stop, F.lit(""))
    by = Window.partitionBy(doc).orderBy("line")
    numbered = rows.withColumn("__start", start).withColumn("__no", F.count("__start").over(by))
    found = F.regexp_extract_all("content", F.lit(term), F.lit(0))
    score = sum((F.max(s.cast("int")) for s in signals), F.lit(0)) + sum((2 * F.max(f.cast("int")) for f in fields), F.lit(0))
    # the terms of a section: a set of a few words of one document
    score += F.least(F.lit(terms), F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(found))))))
    cut = numbered.filter("__no > 0").groupBy(doc, "__no").agg(F.max("__start").alias("method"), F.count("*").alias("n"), score.alias("score")).filter("method <> ''")
    own = cut.groupBy(doc, "method").agg(F.count("*").alias("all_n"), F.sum("n").alias("all_lines"), F.count_if(F.col("score") > 0).alias("good_n"), F.sum(F.when(F.col("score") > 0, F.col("n"))).alias("good_lines"), F.max("score").alias("score"))
    named = rows.filter("__m is not null").select(doc, F.col("__m").alias("method")).distinct()
    whole = rows.groupBy(doc).agg(F.count("*").alias("doc_lines"))
    every = Window.partitionBy(doc)
    joined = named.join(own, [doc, "method"], "left").join(whole, doc)
    reliable = F.count_if(F.coalesce(F.col("good_n"), F.lit(0)) > 0).over(every) >= F.least(F.lit(2), F.count("*").over(every))
    origin = F.when(~F.col("__ok") | F.col("all_n").isNull(), "full_document").when(F.col("good_n") > 0, "document_section").otherwise("low_signal")
    pick = lambda full, good, low: F.when(F.col("origin") == "full_document", full).when(F.col("origin") == "document_section", good).otherwise(low)
    out = joined.withColumn("__ok", reliable).withColumn("origin", origin)
    return out.select(doc, "method", "origin", pick(F.lit(1), F.col("good_n"), F.col("all_n")).cast("long").alias("sections"), pick(F.col("doc_lines"), F.col("good_lines"), F.col("all_lines")).cast("long").alias("n_lines"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
