"""Labels by layout: folds in Spark against walks over the lines."""

import random
import re

from pyspark.sql import functions as F

from quillmill.operators import layouts

LEVELS = ("Large", "Middle", "Small", "Detail")
BITS = ["Large", "Middle", " Small ", "S mall", "Detail", "Small: 01. ax 02. by", "Small a, b/ c", "01. one", "2) two (x) 3. three", "01. a 02. b 03. c", "1. q 2. r 3. s 4. t", "", "text", "01. Small", "02. two", "03. three", "STOP", "1. 22"]


def documents(seed):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice(BITS) for _ in range(rng.randrange(0, 14)))) for i in range(250)] + [(900, None), (901, "")]


def clean(t):
    return re.sub(r"^[ ,:;|\-]+|[ ,:;|\-]+$", "", re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", "", t)))


def pairs(line):
    found = [(int(c), clean(n)) for c, n in re.findall(layouts.PAIR, line)]
    return [(c, n) for c, n in found if n and n not in LEVELS and not n.isdigit()]


def distinct(names):
    return list(dict.fromkeys(names))


def by_header(text):
    lines = (text or "").split("\n")
    for x in lines:
        m = re.match(r"S\s*m\s*a\s*l\s*l\s*[:： ]\s*(.+)$", re.sub(r"\s+", " ", x).strip())
        if m:
            names = [n for _, n in pairs(m[1])] or [p for p in map(clean, re.split("[,/|·]", m[1])) if p and p not in LEVELS]
            if names:
                return distinct(names)
    seen, end = 0, -1
    for i, x in enumerate(lines):
        c = re.sub(r"\s+", "", x)
        if seen == 4 or c not in LEVELS:
            continue
        seen, end = (seen + 1, i) if c == LEVELS[seen] else (0, end)
    row = next((r for r in ([n for _, n in pairs(x)] for x in lines[end + 1 :]) if len(r) > 1), [])
    return row[1:2] if seen > 2 and len(row) in (2, 3) else []


def by_pairs(text, known=()):
    rows = [r for r in ([n for _, n in pairs(x)] for x in (text or "").split("\n")) if r]
    flat = [n for r in rows for n in r]
    if max(map(len, rows), default=0) <= 1:
        one, turns = flat[2:3], [n for n in distinct(flat[2::2]) if n in known]
        return distinct(turns if len(turns) > len(one) else one)
    out, row = [], []
    for r in rows:
        row = row + r
        out += row[2:3]
        row = [] if len(row) >= 4 else row
    return distinct(out)


def by_block(text):
    opened, last, done, out = False, 0, False, []
    for x in (text or "").split("\n"):
        c = re.sub(r"\s+", "", x)
        opens, again = "Small" in c, "Middle" in c
        m = re.search(layouts.PAIR, x)
        name, number = (clean(m[2]), int(m[1])) if m else ("", None)
        fits = opened and not done and name != "" and number == last + 1
        was = done
        done = True if re.search("STOP", x) else False if opens or again else was or (opened and number is not None and not fits and last > 0)
        out += [name] if fits and not opens else []
        last = 0 if opens or again else number if fits else last
        opened |= opens
    return distinct(out)


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.pos)):
        out.setdefault(r.k, []).append(r.label)
    return out


def test_folds_equal_walks(spark):
    docs = documents(3)
    df = spark.createDataFrame(docs, "k int, t string")
    for got, walk in (
        (layouts.header_positions(df, "k", "t", LEVELS, 2), by_header),
        (layouts.code_pairs(df, "k", "t", LEVELS, 2), by_pairs),
        (layouts.code_pairs(df, "k", "t", LEVELS, 2, F.array(F.lit("one"), F.lit("two"), F.lit("three"))), lambda t: by_pairs(t, ("one", "two", "three"))),
        (layouts.vertical_blocks(df, "k", "t", LEVELS, 2, "STOP"), by_block),
    ):
        expected = {k: walk(t) for k, t in docs if walk(t)}
        assert result(got) == expected and len(expected) > 20
