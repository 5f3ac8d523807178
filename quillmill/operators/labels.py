"""Labels from tables and anchors of documents, and the bundle of class candidates built from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as X
from quillmill.operators import documents as T
from quillmill.operators import match as M
from quillmill.sources.staging import stage

HTML, PIPE = "html", "pipe"
RULE = r"^[|:\- ]+$"


def _any(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def table_rows(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows of pipe and HTML tables as ``cells``: kind, number of the table in the text, row and cells.

    Pipe rows that follow one another are a table (rules of dashes are no
    rows); its number and row are line numbers. Rows without any text are left
    out. A text without tables has no rows.
    """
    ruled = T.lines(df, doc, text).filter(F.col("content").contains("|"))
    apart = F.col("line") - F.row_number().over(Window.partitionBy(doc).orderBy("line"))
    split = F.transform(F.split(F.regexp_replace("content", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    pipe = ruled.withColumn("tbl", apart.cast("int")).filter(~F.col("content").rlike(RULE)).select(doc, F.lit(PIPE).alias("kind"), "tbl", F.col("line").alias("row"), split.alias("cells"))
    whole = df.select(doc, F.posexplode(X.extract_closed(X.text_or_empty(F.col(text)), r"(?is)<table[^>]*>(.*?)</table>", "</table>")).alias("tbl", "__t"))
    each = whole.select(doc, "tbl", F.posexplode(X.extract_closed(F.col("__t"), r"(?is)<tr[^>]*>(.*?)</tr>", "</tr>")).alias("row", "__r"))
    bare = lambda x: F.trim(F.regexp_replace(T.unescape(X.replace_closed(x, r"<[^>]+>", (">",), " ")), r"\s+", " "))
    cells = F.transform(X.extract_closed(F.col("__r"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", "</td>", "</th>"), bare)
    html = each.select(doc, F.lit(HTML).alias("kind"), "tbl", "row", cells.alias("cells"))
    return pipe.unionByName(html).filter(F.exists("cells", lambda x: x != ""))


def table_values(df: DataFrame, doc: str, text: str, wanted: str, labels: str, merged: str | None = None, longest: int = 80) -> DataFrame:
    """T2d: values that tables hold for the label ``wanted`` (a pattern on a cell), the first of equal ones, by position.

    On the label's own row they are the cells after it; on the rows below, the
    cell in its column. A pipe header is carried on over other lines and tables
    until the next one; a short pipe row gives its last cell. An HTML header
    holds to the end of its table, or until a row with other ``labels`` only; a
    row with fewer cells than the header (cells that span rows) is shifted by
    the difference. A header cell that fits ``merged`` names two columns, and
    the values stand in the second. Labels, and values of one character, of
    more than ``longest`` or without a letter are no values.
    """
    label = lambda x: x.rlike(wanted) | x.rlike(labels)
    html = F.col("kind") == HTML
    rows = table_rows(df, doc, text)
    found = F.array_position(F.transform("cells", lambda x: x.rlike(wanted)), True).cast("int") - 1
    own = F.when(found >= 0, found + (F.when(F.get("cells", found).rlike(merged), 1).otherwise(0) if merged else 0))
    last = F.array_max(F.transform("cells", lambda x, i: F.when(label(x), i + (F.when(x.rlike(merged), 1).otherwise(0) if merged else 0))))
    marked = rows.withColumn("__scope", F.when(html, F.col("tbl")).otherwise(-1)).withColumn("__at", F.when(found >= 0, found)).withColumn("__own", own).withColumn("__last", last)
    by = Window.partitionBy(doc, "kind", "__scope").orderBy("row")
    carried = marked.withColumn("__head", F.last(F.when(F.col("__own").isNotNull(), F.struct("__own", "__last")), ignorenulls=True).over(by))
    ended = F.max(html & F.col("__last").isNotNull() & F.col("__own").isNull() & F.col("__head").isNotNull()).over(by)
    n, at = F.size("cells"), F.col("__head.__own")
    shift = F.greatest(F.lit(0), F.col("__head.__last") - (n - 1))
    column = F.when(html, F.when(at < n, at).otherwise(at - shift)).otherwise(F.least(at, n - 1))
    beside = F.slice("cells", F.col("__at") + 2, F.greatest(n - F.col("__at") - 1, F.lit(0)))
    under = F.when((column >= 0) & (column < n), F.array(F.get("cells", column))).otherwise(F.array().cast("array<string>"))
    picked = F.when(F.col("__own").isNotNull(), beside).when(F.col("__last").isNotNull() | F.col("__head").isNull(), F.array().cast("array<string>")).otherwise(under)
    numbered = lambda x: F.regexp_replace(x, r"(?<=\S)\s+(?=[0-9]+\s*\.\s)", "\n")
    items = F.flatten(F.transform(F.filter(picked, lambda x: ~label(x)), lambda x: X.composite_labels(numbered(x))))
    values = carried.withColumn("__end", ended).filter(~_any(F.col("__end"))).select(doc, "kind", "tbl", "row", F.posexplode(items).alias("__pos", "value"))
    plausible = F.length("value").between(2, longest) & F.col("value").rlike(r"\p{L}") & ~label(F.col("value"))
    keyed = values.filter(plausible).withColumn("__k", X.label_key(F.col("value"))).filter("__k <> ''")
    first = keyed.groupBy(doc, "__k").agg(F.min(F.struct(F.col("kind") == HTML, "tbl", "row", "__pos", "kind", "value")).alias("r"))
    return first.select(doc, "r.kind", "r.tbl", "r.row", "r.value")


def canonical_names(raw: DataFrame, text: str, names: DataFrame, label: str, order: str) -> DataFrame:
    """For each distinct raw text its catalogue name and a bonus: 5 if equal but for case and dots, 3 if one holds the other, else itself and 0.

    Of names within the raw text the longest counts, of names around it the
    first. Texts of one character match only as a whole.
    """
    dots = lambda c: F.regexp_replace(c, "[‧⋅∙･·․]", "·")
    # counted and read more than once
    asked = stage(raw.select(F.col(text).alias("__raw"), dots(F.col(text)).alias("__a")).distinct(), "raw-labels")
    stock = names.select(F.col(label).alias("__name"), F.col(order).cast("long").alias("__o"), dots(F.col(label)).alias("__n")).filter("__n <> ''")
    equal = asked.join(stock, F.lower("__a") == F.lower("__n")).groupBy("__raw").agg(F.min_by("__name", F.struct(F.col("__a") != F.col("__n"), "__o")).alias("__equal"))
    inner = M.holding(asked, "__a", stock, "__n").groupBy("__raw").agg(F.max_by("__name", F.struct(F.length("__n"), -F.col("__o"))).alias("__inner"))
    outer = M.holding(stock, "__n", asked, "__a").groupBy("__raw").agg(F.min_by("__name", "__o").alias("__outer"))
    joined = asked.join(equal, "__raw", "left").join(inner, "__raw", "left").join(outer, "__raw", "left")
    bonus = F.when(F.col("__equal").isNotNull(), 5).when(F.coalesce("__inner", "__outer").isNotNull(), 3).otherwise(0)
    return joined.select("__raw", F.coalesce("__equal", "__inner", "__outer", "__raw").alias("label"), bonus.alias("bonus"))


def canonical(raws: DataFrame, text: str, names: DataFrame, label: str, order: str, most_names: int = 100) -> DataFrame:
    """``raws`` with the ``label`` and ``bonus`` that ``canonical_names`` gives, in the row itself if there are up to ``most_names`` names."""
    dots = lambda c: F.regexp_replace(c, "[‧⋅∙･·․]", "·")
    stock = names.select(F.col(label).alias("name"), F.col(order).cast("long").alias("o"), dots(F.col(label)).alias("n")).filter("n <> ''")
    few = stock.limit(most_names + 1).collect()  # at most that many
    if len(few) > most_names:
        return raws.join(canonical_names(raws, text, names, label, order), F.col(text) == F.col("__raw"))
    listed = lambda rows: F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.n).alias("n"), F.lower(F.lit(r.n)).alias("low")) for r in rows]).cast("array<struct<name:string,n:string,low:string>>")
    first = lambda rows, ok: F.get(F.filter(listed(rows), ok), F.lit(0))["name"]
    in_order = sorted(few, key=lambda r: (r.o is None, r.o))
    longest = sorted((r for r in in_order if len(r.n) >= 2), key=lambda r: -len(r.n))
    keyed = raws.withColumn("__a", dots(F.col(text))).withColumn("__low", F.lower("__a"))
    equal = F.coalesce(first(in_order, lambda x: x["n"] == F.col("__a")), first(in_order, lambda x: x["low"] == F.col("__low")))
    around = F.when(F.length("__a") >= 2, first(in_order, lambda x: x["n"].contains(F.col("__a"))))
    found = keyed.withColumn("__equal", equal).withColumn("__held", F.coalesce(first(longest, lambda x: F.col("__a").contains(x["n"])), around))
    bonus = F.when(F.col("__equal").isNotNull(), 5).when(F.col("__held").isNotNull(), 3).otherwise(0)
    return found.withColumn("label", F.coalesce("__equal", "__held", text)).withColumn("bonus", bonus).drop("__a", "__low", "__equal", "__held")


def anchor_classes(df: DataFrame, doc: str, text: str, names: DataFrame, label: str, order: str, anchor: str, headers: tuple[str, ...], section: str, ahead: int = 3, reach: int = 3, near_anchor: int = 3, near_section: int = 5, cap: int = 10, longest: int = 30, synergy: int = 2, threshold: int = 3, most: int = 5, most_names: int = 100) -> DataFrame:
    """T4d: small classes by three strategies, their scores summed by label; the ``most`` best, and ``best`` for the first if it reaches the threshold.

    Anchor lines give what follows the anchor, else the first of the next
    ``ahead`` lines before another anchor that is no header; anchor cells of
    tables give the first cell to the right and the first below. Each counts 1
    and its catalogue bonus, 1 less if a cell is longer than ``longest``. Each
    line that holds a name counts 3 near an anchor line, 2 near a section line,
    else 1, at most ``cap`` for a name. A label of both kinds gains ``synergy``.
    Ties go by label. A text's lines are held against one another in the text's
    own row; what they give is shuffled once, by text, and only of tables more.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[\s:：·\-|>]+|[\s:：·\-|<]+$", ""))
    usable = lambda c: (clean(c) != "") & ~clean(c).isin(*headers)
    split = F.transform(F.split(X.text_or_empty(F.col(text)), "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("content")))
    marked = F.transform(F.filter(split, lambda x: x["content"] != ""), lambda x: F.struct(x["line"].alias("line"), x["content"].alias("content"), x["content"].rlike(anchor).alias("anchor"), x["content"].rlike(section).alias("section")))

    def below(x: Column, k: Column) -> Column:
        follow = F.filter(F.slice("__lines", k + 2, F.lit(ahead)), lambda y: y["line"] <= x["line"] + ahead)
        stop = lambda f: F.array_position(F.transform(f, lambda y: y["anchor"]), True)
        until = lambda f: F.when(stop(f) > 0, F.slice(f, F.lit(1), (stop(f) - 1).cast("int"))).otherwise(f)
        return F.get(F.filter(F.transform(until(follow), lambda y: y["content"]), usable), F.lit(0))

    def around(x: Column, k: Column, what: str, w: int) -> Column:
        return F.exists(F.slice("__lines", F.greatest(k + 1 - w, F.lit(1)), F.lit(2 * w + 1)), lambda y: y[what] & F.abs(y["line"] - x["line"]).between(0, w))

    def weighed_line(x: Column, k: Column) -> Column:
        w = F.when(around(x, k, "anchor", near_anchor), 3).when(around(x, k, "section", near_section), 2).otherwise(1)
        return F.struct(x["content"].alias("content"), x["anchor"].alias("__anchor"), F.when(x["anchor"], below(x, k)).alias("__below"), w.alias("__w"))

    rows = df.select(doc, marked.alias("__lines")).select(doc, F.explode(F.transform("__lines", weighed_line)).alias("r")).select(doc, "r.*")
    after = F.regexp_replace("content", rf"^.*?(?:{anchor})", "")
    from_lines = rows.filter("__anchor").select(doc, F.when(usable(after), after).otherwise(F.col("__below")).alias("raw"), F.lit(1).alias("base"))

    grid = table_rows(df, doc, text)
    downward = F.collect_list("cells").over(Window.partitionBy(doc, "kind", "tbl").orderBy("row").rowsBetween(1, reach))
    spots = grid.withColumn("__down", downward).select(doc, "cells", "__down", F.posexplode("cells").alias("__c", "__cell")).filter(F.col("__cell").rlike(anchor))
    right = F.get(F.filter(F.slice("cells", F.col("__c") + 2, F.lit(reach)), usable), F.lit(0))
    ragged = F.array_position(F.transform("__down", lambda r: F.size(r) <= F.col("__c")), True)
    full = F.when(ragged > 0, F.slice("__down", F.lit(1), (ragged - 1).cast("int"))).otherwise(F.col("__down"))
    down = F.get(F.filter(F.transform(full, lambda r: F.get(r, F.col("__c"))), usable), F.lit(0))
    from_cells = spots.select(doc, F.explode(F.array(right, down)).alias("raw")).withColumn("base", F.when(F.length("raw") > longest, 0).otherwise(1))

    raws = from_lines.unionByName(from_cells).withColumn("raw", clean(F.col("raw"))).filter("raw <> ''")
    none = F.lit(None).cast("long")
    told = canonical(raws, "raw", names, label, order, most_names).select(doc, "label", (F.col("base") + F.col("bonus")).cast("long").alias("__told"), none.alias("__seen"))
    hits = M.holding(rows.select(doc, "content", "__w"), "content", names.select(F.col(label).alias("label")).distinct(), "label", most_heads=100).select(doc, "label", none.alias("__told"), F.col("__w").cast("long").alias("__seen"))
    sums = told.unionByName(hits).repartition(doc).groupBy(doc, "label").agg(F.sum("__told").alias("__told"), F.sum("__seen").alias("__seen"))
    seen = F.when(F.col("__seen").isNotNull(), F.least("__seen", F.lit(cap)))  # least() alone leaves nulls out
    both = sums.withColumn("__seen", seen).withColumn("score", F.coalesce("__told", F.lit(0)) + F.coalesce("__seen", F.lit(0)) + F.when(F.col("__told").isNotNull() & F.col("__seen").isNotNull(), synergy).otherwise(0))
    rn = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "label"))
    return both.withColumn("rank", rn).filter(F.col("rank") <= most).select(doc, "label", F.col("score").cast("long").alias("score"), "rank", ((F.col("rank") == 1) & (F.col("score") >= threshold)).alias("best"))


def candidate_bundle(docs: DataFrame, doc: str, text: str, terms: Column, filename: Column, classes: DataFrame, code: str, name: str, family: str, aliases: DataFrame, alias: str, official: str, anchor: Column, section: Column, manual: Column | None = None, show_direct: bool = True, most: int = 8, keep: int = 4, least_keep: int = 1, margin: float = 0.18, least: float = 0.62, most_names: int = 5000) -> DataFrame:
    """T8d: class candidates of each document as lists ``direct``, ``reverse``, ``merged`` and ``verified`` of (position, code, confidence).

    ``direct`` looks the document's terms up (J9); if they name one class only,
    up to two mentioned classes of its family with confidence 0.6 join it (W19).
    ``reverse`` are the dictionary's scores (T5d). ``merged`` joins both (W8), or
    counts the catalogue's names (T6d) where both are empty. ``verified`` are the
    looked-up classes if there are any and ``show_direct``, else the merged ones
    within the margin (W7): one of confidence 0.95 for a single direct class,
    the family with margin 0.45 for a single term's family, unless there are
    ``manual`` terms. The lists are short arrays of one row for each document;
    more than ``most_names`` classes are refused, as T6d does.
    """
    none = F.array().cast("array<string>")
    extra = F.coalesce(manual, none) if manual is not None else none
    base = docs.select(doc, F.col(text), F.coalesce(terms, none).alias("__terms"), extra.alias("__manual"), filename.alias("__file"))
    kinds = classes.select(F.col(code).alias("code"), X.text_or_empty(F.col(name)).alias("name"), F.col(family).alias("family"))
    few = kinds.select("code", "name").filter("trim(name) <> ''").limit(most_names + 1).collect()  # at most that many
    if len(few) > most_names:
        raise ValueError(f"name counting is for catalogues of at most {most_names} names")
    listed_kinds = F.from_json(F.lit(json.dumps([r.asDict() for r in few])), f"array<struct<code:{kinds.schema['code'].dataType.simpleString()},name:string>>")

    asked = base.select(doc, F.posexplode("__terms").alias("__pos", "__term")).withColumn("__key", X.label_key(F.col("__term"))).filter("__key <> ''")
    looked = M.lookup_class(asked.select("__term").distinct(), "__term", classes, name, code, code)
    looked = looked.select(X.label_key(F.col("__term")).alias("__key"), F.col(code).alias("code"), F.col("confidence"))
    scored = T.dictionary_scores(base, doc, text, aliases, alias, code, official, anchor, section, hints=F.concat("__terms", "__manual"), filename=F.col("__file")).withColumnRenamed(code, "code")
    row = F.struct("code", "confidence", "name", "family")
    firsts = asked.join(looked, "__key").groupBy(doc, "code").agg(F.min_by("confidence", "__pos").alias("confidence"), F.min("__pos").alias("__pos")).join(kinds, "code")
    # a document's terms and a dictionary's labels bound these arrays
    direct = firsts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", row.alias("r")))), lambda x: x["r"]).alias("__direct"))
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("score")).alias("b"), F.col("code").alias("c"), row.alias("r"))
    reverse = scored.join(kinds, "code").groupBy(doc).agg(F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["r"]), 1, most).alias("__reverse"))

    typed = kinds.schema
    empty = F.array().cast(f"array<struct<code:{typed['code'].dataType.simpleString()},confidence:double,name:string,family:{typed['family'].dataType.simpleString()}>>")
    wide = base.join(direct, doc, "left").join(reverse, doc, "left")
    wide = wide.withColumn("__direct", F.coalesce("__direct", empty)).withColumn("__reverse", F.coalesce("__reverse", empty)).withColumn("__low", X.squeezed(F.col(text)))
    one = F.get("__direct", F.lit(0))
    kin = F.filter("__reverse", lambda x: (x["family"] == one["family"]) & (x["code"] != one["code"]) & (x["confidence"] >= 0.6) & (X.squeezed(x["name"]) != "") & F.col("__low").contains(X.squeezed(x["name"])))
    wide = wide.withColumn("__expanded", F.when(F.size("__direct") == 1, F.concat("__direct", F.slice(kin, 1, 2))).otherwise(F.col("__direct")))
    wide = wide.withColumn("__listed", F.concat("__expanded", "__reverse"))
    wide = wide.withColumn("__all", F.transform("__listed", lambda x: x["code"])).withColumn("__codes", F.slice(F.array_distinct("__all"), 1, most))
    read = F.when(F.size("__codes") == most, F.slice("__listed", F.lit(1), F.array_position("__all", F.element_at("__codes", -1)).cast("int"))).otherwise(F.col("__listed"))
    pair = lambda c, v: F.struct(c.alias("code"), v.cast("double").alias("confidence"))
    wide = wide.withColumn("__read", read)
    merged = F.transform("__codes", lambda c: pair(c, F.array_max(F.transform(F.filter("__read", lambda x: x["code"] == c), lambda x: x["confidence"]))))
    whole = F.lower(X.text_or_empty(F.col(text)))
    times = F.transform(listed_kinds, lambda k: F.struct((-X.occurrences(whole, F.lower(k["name"]))).alias("n"), k["code"].alias("code")))
    share = lambda n: F.when(n > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.62), n / 3))).otherwise(0.62)
    best_first = F.array_sort(F.transform(F.filter(times, lambda x: x["n"] < 0), lambda x: F.struct((-F.round(share(-x["n"]), 4)).alias("a"), x["n"].alias("n"), x["code"].alias("code"))))
    counted = F.slice(F.transform(best_first, lambda x: pair(x["code"], -x["a"])), 1, most)
    wide = wide.withColumn("__merged", F.when(F.size("__codes") > 0, merged).otherwise(counted))

    plain = lambda c: F.transform(c, lambda x: pair(x["code"], x["confidence"]))
    by_hand, n = F.size("__manual") > 0, F.size("__expanded")
    mode = F.when(~by_hand & (F.size("__terms") <= 1) & (n > 1), "family").when(~by_hand & (n == 1), "single").otherwise("open")
    wide = wide.withColumn("__mode", mode)
    bar = F.when(F.col("__mode") == "family", 0.60).when(F.col("__mode") == "single", 0.95).otherwise(least)
    slack = F.when(F.col("__mode") == "family", 0.45).when(F.col("__mode") == "single", 0.0).otherwise(margin)
    room = F.when(F.col("__mode") == "family", F.least(F.lit(keep), n)).when(F.col("__mode") == "single", 1).otherwise(keep)
    source = F.when(F.col("__mode") == "family", plain(F.col("__expanded"))).otherwise(F.col("__merged"))
    sorted_ = F.transform(F.array_sort(F.transform(source, lambda x, i: F.struct((-x["confidence"]).alias("a"), i.alias("i"), x.alias("r")))), lambda x: x["r"])
    wide = wide.withColumn("__sorted", sorted_).withColumn("__bar", F.greatest(bar, F.get("__sorted", F.lit(0))["confidence"] - slack)).withColumn("__room", room)
    near = F.filter("__sorted", lambda x, i: ((x["confidence"] >= F.col("__bar")) & (i < F.col("__room"))) | (i < least_keep))
    verified = F.when((F.size("__direct") > 0) & F.lit(show_direct), plain(F.col("__direct"))).otherwise(near)
    named = lambda what, c: F.transform(c, lambda x, i: F.struct(F.lit(what).alias("list"), (i + 1).cast("long").alias("position"), x["code"].alias("code"), x["confidence"].alias("confidence")))
    lists = F.concat(named("direct", plain(F.col("__expanded"))), named("reverse", plain(F.col("__reverse"))), named("merged", F.col("__merged")), named("verified", verified))
    return wide.select(doc, F.explode(lists).alias("r")).select(doc, "r.*")
