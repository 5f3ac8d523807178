"""Text expressions: normalisers, tokens, n-grams, similarity, hashes.

Patterns list white space explicitly (``[\\s\\u00A0\\u3000]``): the engines'
own ``\\s`` is ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that each module strips from its keys.
SPACE = "\\s\u00a0\u3000"
DOTS = r"·‧･ㆍ•∙⋅"
LABEL_MARKS = r"[·‧･ㆍ•∙⋅\-_/|(),.\[\]{}:;]"
CATALOGUE_MARKS = rf"[{SPACE}·‧･ㆍ•∙⋅・\-_/|(),.]+"
COVERAGE_MARKS = rf"[{SPACE}\-_/|(),.·・]+"
DOCUMENT_MARKS = rf"[{SPACE}:：·•\-_/()\[\]{{}}]+"
GAP_MARKS = rf"[{SPACE}\-_/|(),.·・〮‧･ㆍ•∙⋅]+"
# Words too common to tell two texts apart.
STOP_WORDS = ("및", "관련", "업무", "직무", "공공기관", "수행", "경험", "기술", "기반", "활용", "가능", "이해", "등")


def blank_to_null(c: Column) -> Column:
    """Blank, white space and null are one value: null."""
    trimmed = F.regexp_replace(c.cast("string"), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.nullif(trimmed, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text_or_empty(c), rf"[{SPACE}]+", ""))


def dedup_key(c: Column) -> Column:
    """Squeezed, without separators and brackets."""
    return F.regexp_replace(squeeze(c), LABEL_MARKS, "")


def label_key(c: Column) -> Column:
    """Only Hangul syllables, ASCII letters and digits stay."""
    return F.regexp_replace(dedup_key(c), r"[^0-9a-z가-힣]", "")


def catalogue_key(c: Column) -> Column:
    """Catalogue matching."""
    return F.lower(F.regexp_replace(text_or_empty(c), CATALOGUE_MARKS, ""))


def plain_key(c: Column) -> Column:
    """Squeezed only."""
    return squeeze(c)


def coverage_key(c: Column) -> Column:
    """Requested against covered labels."""
    return F.lower(F.regexp_replace(text_or_empty(c), COVERAGE_MARKS, ""))


def document_key(c: Column) -> Column:
    """Headings of documents (compatibility forms are folded by ``udfs.nfkc`` beforehand)."""
    return F.lower(F.regexp_replace(text_or_empty(c), DOCUMENT_MARKS, ""))


def surface_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text_or_empty(c), r"[^0-9A-Za-z가-힣]+", ""))


def question_key(c: Column) -> Column:
    """Bracketed parts go, other characters become single spaces."""
    t = F.regexp_replace(F.lower(text_or_empty(c)), r"\[[^\]]+\]", " ")
    t = F.regexp_replace(t, r"[^0-9a-z가-힣 ]+", " ")
    return F.trim(F.regexp_replace(t, r" +", " "))


def gap_key(c: Column) -> Column:
    """Gap diagnosis."""
    return F.lower(F.regexp_replace(text_or_empty(c), GAP_MARKS, ""))


def code(c: Column, width: int) -> Column:
    """Zero-padded code: a trailing ``.0`` goes, digits shorter than ``width`` are filled, nothing is cut."""
    t = F.regexp_replace(F.trim(text_or_empty(c)), r"\.0$", "")
    return F.when(t.rlike(r"^[0-9]+$") & (F.length(t) < width), F.lpad(t, width, "0")).otherwise(t)


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case tokens of two or more letters or digits, in order."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[가-힣a-z0-9]{2,}"), F.lit(0))
    kept = F.array_distinct(found)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


def question_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of a question key, two characters or more."""
    kept = F.filter(F.array_distinct(F.split(question_key(c), " ")), lambda t: F.length(t) >= 2)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


def sentences(c: Column) -> Column:
    """Sentences, cut at ``. ! ? ;`` and line feeds, trimmed, without blanks."""
    parts = F.transform(F.split(text_or_empty(c), r"[.!?;\n]+"), lambda s: F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.filter(parts, lambda s: s != "")


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Multiset of character n-grams over letters and digits; a text shorter than ``low`` is its own gram."""
    t = F.regexp_replace(squeeze(c), r"[^0-9a-z가-힣]", "")

    def of(n: int) -> Column:
        return F.when(F.length(t) >= n, windows(t, n)).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[of(n) for n in range(low, high + 1)])
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < low, F.array(t)).otherwise(grams)


def char_ngram_set(c: Column, n: int = 3) -> Column:
    """Set of character n-grams of a question key without spaces; short texts have none."""
    t = F.replace(question_key(c), F.lit(" "), F.lit(""))
    return pieces(t, n)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def count_markers(c: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers a text contains."""
    return sum((F.when(c.contains(m), 1).otherwise(0) for m in markers), F.lit(0))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: c.contains(m)) if markers else F.lit(False)


def signature(c: Column, scenarios: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Names of the scenarios whose marker occurs, joined by ``+``."""
    return F.array_join(F.array_compact(F.array(*[F.when(contains_any(c, m), F.lit(name)) for name, m in scenarios])), "+")


def first_match(c: Column, intents: tuple[tuple[str, tuple[str, ...], int], ...], unknown: str = "") -> Column:
    """The first intent of which at least the required number of markers occur."""
    out = F.lit(unknown)
    for name, markers, needed in reversed(intents):
        out = F.when(count_markers(c, markers) >= needed, F.lit(name)).otherwise(out)
    return F.when(c == "", F.lit(unknown)).otherwise(out)


def canonical(c: Column, aliases: dict[str, str], default: str = "") -> Column:
    """The canonical name of an alias, matched on letters and digits only."""
    key = surface_key(c)
    out = F.lit(default)
    for alias, name in aliases.items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return out


def ksa_type(raw: Column, factor: Column) -> Column:
    """Canonical type of a factor: its own type by alias, else by words in its name, else blank."""
    key, name = surface_key(raw), surface_key(factor)
    # Names of the three types and words that give them away.
    return (
        F.when(key.isin("k", "knowledge") | key.contains("지식"), "지식")
        .when(key.isin("s", "skill", "skills") | key.contains("기술") | key.contains("스킬"), "기술")
        .when(key.isin("a", "attitude") | key.contains("태도"), "태도")
        .when(contains_any(name, ("태도", "자세", "의지", "의식", "성실", "적극성", "책임감")), "태도")
        .when(contains_any(name, ("지식", "개념", "원리", "이론", "종류", "특성", "법규", "법령", "동향", "규정", "세법")), "지식")
        .when(contains_any(name, ("능력", "기술", "스킬", "작성", "수립", "분석", "점검", "활용", "파악", "검증", "산정", "설정", "조작", "선별", "중재", "기법", "시스템")), "기술")
        .otherwise("")
    )


def lexically_matches(a: Column, b: Column, a_key: Column, b_key: Column, short: tuple[str, ...] = ()) -> Column:
    """Whether a point matches a demand, by arrays of stems and compact keys.

    It does if its key, of 4 characters or more, lies in the other's; if two of
    its stems begin, or are begun by, a stem of the other; or one that has 3
    characters or is one of ``short``. Empty stems anchor nothing.
    """
    begins = lambda x: F.exists(b, lambda y: (F.length(y) >= 2) & (F.startswith(x, y) | F.startswith(y, x)))
    anchors = F.filter(F.array_distinct(a), lambda x: (F.length(x) >= 2) & begins(x))
    one = F.get(anchors, F.lit(0))
    alone = (F.length(one) >= 3) | (one.isin(*short) if short else F.lit(False))
    return F.coalesce(((F.length(a_key) >= 4) & b_key.contains(a_key)) | (F.size(anchors) >= 2) | ((F.size(anchors) == 1) & alone), F.lit(False))


def first_useful(candidates: list[tuple[str, Column]], useful: Callable[[Column], Column], fallback: tuple[str, Column]) -> Column:
    """Struct of the first candidate that is ``useful``, else the fallback, and the tag it came with."""
    tag, surface = F.lit(fallback[0]), fallback[1]
    for name, c in reversed(candidates):
        ok = F.coalesce(useful(c), F.lit(False))
        tag, surface = F.when(ok, name).otherwise(tag), F.when(ok, c).otherwise(surface)
    return F.struct(surface.alias("surface"), tag.alias("tag"))


def evidence_id(prefix: str, fields: dict[str, Column]) -> Column:
    """``prefix`` and 24 hex digits of the SHA-256 of the fields as JSON, keys sorted, nothing escaped."""
    row = F.struct(*[text_or_empty(fields[k]).alias(k) for k in sorted(fields)])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(row), 256), 1, 24))


def is_sensitive_key(c: Column, exact: tuple[str, ...] = ("authorization", "secret", "token", "cookie")) -> Column:
    """Whether a field name suggests a secret."""
    key = surface_key(c)
    # Parts of names that stand for secrets.
    return key.isin(*exact) | contains_any(key, ("apikey", "password", "accesstoken", "refreshtoken", "이력서"))


#: Fixed value: what a key or its assignment looks like.
SECRET = r"(?i)(\bsk-(proj-|svcacct-)?[A-Za-z0-9_-]{8,}|\b(openai[_-]?)?api[_-]?key\s*[:=])"


def has_secret(c: Column) -> Column:
    return text_or_empty(c).rlike(SECRET)


def to_int(c: Column) -> Column:
    """An integer, or null if the text is none."""
    return F.when(F.trim(c.cast("string")).rlike(r"^[+-]?[0-9]+$"), F.trim(c.cast("string")).try_cast("long"))


def to_bool(c: Column) -> Column:
    """true/1/yes/y/pass/passed, false/0/no/n/fail/failed, else null."""
    t = F.lower(F.trim(c.cast("string")))
    # Words for yes and no.
    return F.when(t.isin("true", "1", "yes", "y", "pass", "passed"), True).when(t.isin("false", "0", "no", "n", "fail", "failed"), False)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def squeezed(c: Column) -> Column:
    """Lower case without any ASCII white space: what names are looked for in."""
    return F.lower(F.regexp_replace(text_or_empty(c), r"[ \t\r\n\f\x0B]+", ""))


def windows(c: Column, n: int) -> Column:
    """All substrings of ``n`` characters in order, in one walk over the text: ``substring`` at each place would be quadratic."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.filter(out, lambda x: x.isNotNull())


def pieces(c: Column, n: int = 2) -> Column:
    """Distinct substrings of ``n`` characters."""
    return F.when(F.length(c) >= n, F.array_distinct(windows(c, n))).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("int")).otherwise(0)


def weighted_query(fields: list[tuple[str, Column, int, int]]) -> Column:
    """Labelled copies of fields: (label, text, longest, times) each; blanks are left out."""
    parts = [F.when(blank_to_null(c).isNotNull() & F.lit(times > 0), F.rtrim(F.repeat(F.concat(F.lit(label), F.substring(c, 1, most), F.lit(" ")), max(1, times)))) for label, c, most, times in fields]
    return F.concat_ws(" ", *parts)


def context_text(sections: list[tuple[str, Column, int]]) -> Column:
    """Labelled sections, cut to their lengths, joined by blank lines; blanks are left out."""
    return F.concat_ws("\n\n", *[F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"[{label}]\n"), F.substring(c, 1, most))) for label, c, most in sections])


def composite_labels(c: Column) -> Column:
    """Labels in one cell: cut at separators, numbering and blanks removed, first of equal keys."""
    parts = F.split(text_or_empty(c), r"\s*[,;/|\n]\s*")
    cleaned = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*(\(?[0-9]{1,2}[).]|[-*])\s*", "")))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def clean_markdown(c: Column) -> Column:
    """Markdown to plain text: images and links go, breaks become lines, marks and runs of blanks collapse."""
    t = F.regexp_replace(text_or_empty(c), r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[*_`~]+", "")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n"), r"^[ |\t\r\n:：•-]+|[ |\t\r\n:：•-]+$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def _rest(c: Column, closers: tuple[str, ...]) -> Column:
    """What follows the last of the closers, which are lower-case ASCII, in a lower-case text."""
    for closer in closers:
        c = F.substring_index(c, closer, -1)
    return c


def _split(c: Column, closers: tuple[str, ...], use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of a text up to the end of its last closer and of the rest: behind it nothing closes."""
    head = F.regexp_extract(c, "(?is)^.*(?:" + "|".join(closers) + ")", 0)
    return once(head, lambda h: use(h, F.substr(c, F.length(h) + 1)))


def replace_closed(c: Column, pattern: str, closers: tuple[str, ...], new: str, opener: str = "<") -> Column:
    """Replace a pattern that begins with ``opener`` and ends with one of the closers (lower case, whatever the text's).

    An opener without a closer would read to the end of the text, and many of
    them would make that quadratic; so where one stands behind the last closer,
    the pattern is only sought before that.
    """
    apart = lambda x: _split(x, closers, lambda head, rest: F.concat(F.regexp_replace(head, pattern, new), rest))
    return once(c, lambda x: F.when(_rest(F.lower(x), closers).contains(opener), apart(x)).otherwise(F.regexp_replace(x, pattern, new)))


def extract_closed(c: Column, pattern: str, *closers: str) -> Column:
    """All matches (first group) of a pattern that ends with one of the closers, as in ``replace_closed``."""
    every = lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    return once(c, lambda x: F.when(_rest(F.lower(x), closers).contains("<"), _split(x, closers, lambda head, _: every(head))).otherwise(every(x)))


#: A noncharacter that keeps an opener without a closer from being read as one.
OPEN = "\uffff"


def without_elements(c: Column, elements: tuple[tuple[str, str, str], ...], new: str = "") -> Column:
    """A text without the elements (opener, pattern that follows it, closer, all lower case), whichever opens first."""
    pattern = "(?is)" + "|".join(f"{opener}{after}.*?{closer}" for opener, after, closer in elements)

    def marked(c: Column, opener: str, after: str, closer: str) -> Column:
        mark = lambda head, rest: F.concat(head, F.regexp_replace(rest, f"(?i)<(?={opener[1:]}{after})", f"<{OPEN}"))
        return once(c, lambda x: _split(x, (closer,), mark))

    def careful(c: Column) -> Column:
        for element in elements:
            c = marked(c, *element)
        return F.replace(F.regexp_replace(c, pattern, new), F.lit(f"<{OPEN}"), F.lit("<"))

    def all_closed(low: Column) -> Column:
        out = F.lit(True)
        for opener, _, closer in elements:
            out &= ~_rest(low, (closer,)).contains(opener)
        return out

    return once(c, lambda x: F.when(once(F.lower(x), all_closed), F.regexp_replace(x, pattern, new)).otherwise(careful(x)))
