"""Labels from tables, anchor classes and the candidate bundle, against loops."""

import re

from pyspark.sql import functions as F

from quillmill.operators import labels

TEXT = """intro
| Group | Detail |
|---|---|
| metal | welding, 2. casting |
| wood |
between
| paper | printing |
| Detail | sewing | 1. dyeing 2. weaving |
| Group | only |
| stone | carving |
<table><tr><th>Group</th><th>Class</th><th>Detail</th></tr>
<tr><td>a</td><td>b</td><td>baking</td></tr><tr><td>c</td><td>milling &amp; more</td></tr><tr><td>brewing</td></tr>
<tr><td>Group</td><td>x</td></tr><tr><td>d</td><td>e</td><td>unread</td></tr></table>
<TABLE><tr><td>Class Detail</td><td>n</td></tr><tr><td>k</td><td>Sewing</td></tr><tr><td>7</td><td>9</td></tr></TABLE>"""


def test_table_values(spark):
    out = labels.table_values(spark.createDataFrame([(1, TEXT), (2, None), (3, "plain"), (4, "")], "d int, t string"), "d", "t", "Detail$", "^(Group|Class|Detail)", merged="^Class Detail$")
    got = [r.value for r in sorted(out.collect(), key=lambda r: (r.kind == "html", r.tbl, r.row))]
    # the pipe header last read is in the first column; a short pipe row gives its last cell; the shifted rows of the first HTML table give theirs; its other header ends it
    assert sorted(got) == sorted(["welding", "casting", "wood", "printing", "sewing", "dyeing", "weaving", "stone", "baking", "milling & more", "brewing"])


LINES = ["Class: cutting", "plain line", "Class", "head", "metal cutting work", "Class", "", "", "", "too far", "the cut", "near weld", "section", "welding", "| Class | weld | x |", "| paint | y |"]
NAMES = ["cutting", "welding", "metal cutting", "paint"]


def model(lines):
    """Scores of labels by a walk over lines and cells."""
    rows = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    clean = lambda t: re.sub(r"^[\s:\-|>]+|[\s:\-|<]+$", "", re.sub(r"\s+", " ", t)).strip()

    def canonical(raw):
        same = [n for n in NAMES if n.lower() == raw.lower()]
        inner = sorted((n for n in NAMES if n in raw), key=len)
        outer = [n for n in NAMES if raw in n and len(raw) > 1]
        return (same[0], 5) if same else (inner[-1], 3) if inner else (outer[0], 3) if outer else (raw, 0)

    told, seen = {}, {}

    def tell(raw, base):
        label, bonus = canonical(clean(raw))
        told[label] = told.get(label, 0) + base + bonus

    ok = lambda t: clean(t) not in ("", "head")
    for i, x in rows:
        if "Class" not in x:
            continue
        after = x.split("Class", 1)[1]
        if ok(after):
            tell(after, 1)
            continue
        for j, y in rows:
            if i < j <= i + 3:
                if "Class" in y:
                    break
                if ok(y):
                    tell(y, 1)
                    break
    grid = [[c.strip() for c in re.sub(r"^\||\|$", "", x).split("|")] for _, x in rows if "|" in x]
    for r, cells in enumerate(grid):
        for c, cell in enumerate(cells):
            if "Class" in cell:
                right = [v for v in cells[c + 1 : c + 4] if ok(v)][:1]
                down = [g[c] for g in grid[r + 1 : r + 4] if ok(g[c])][:1]
                for v in right + down:
                    tell(v, 0 if len(v) > 30 else 1)
    anchors = [i for i, x in rows if "Class" in x]
    parts = [i for i, x in rows if "section" in x]
    for i, x in rows:
        w = 3 if any(abs(i - a) <= 3 for a in anchors) else 2 if any(abs(i - a) <= 5 for a in parts) else 1
        for n in NAMES:
            if n in x:
                seen[n] = min(10, seen.get(n, 0) + w)
    score = {k: told.get(k, 0) + seen.get(k, 0) + (2 if k in told and k in seen else 0) for k in told.keys() | seen.keys()}
    best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
    return {(k, v, i + 1, i == 0 and v >= 3) for i, (k, v) in enumerate(best)}


def test_anchor_classes_equal_a_walk(spark):
    texts = ["\n".join(LINES), "\n".join(reversed(LINES)), "\n".join(LINES[4:9]), "x", "", None]
    names = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "label string, ord int")
    out = labels.anchor_classes(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t", names, "label", "ord", "Class", ("head",), "section").collect()
    for d, t in enumerate(texts):
        assert {(r.label, r.score, r.rank, r.best) for r in out if r.d == d} == model((t or "").split("\n"))


def bundle(spark, rows, **options):
    classes = spark.createDataFrame([("c1", "cutting", "m"), ("c2", "welding", "m"), ("c3", "baking", "f"), ("c4", "rare words", "f")], "code string, name string, family string")
    aliases = spark.createDataFrame([("cutting", "c1", True), ("welding", "c2", True), ("baking", "c3", True), ("oven", "c3", False)], "alias string, code string, official boolean")
    docs = spark.createDataFrame(rows, "d int, t string, terms array<string>, f string, hand array<string>")
    out = labels.candidate_bundle(docs, "d", "t", F.col("terms"), F.col("f"), classes, "code", "name", "family", aliases, "alias", "official", F.lit(False), F.lit(False), manual=F.col("hand"), **options)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.d, r.list, r.position)):
        found.setdefault((r.d, r.list), []).append((r.code, r.confidence))
    return found


ROWS = [
    (1, "cutting and welding", ["Cutting"], "a", None),
    (2, "baking baking oven oven welding", [], "a", None),
    (3, "about rare words", None, "a", []),
    (4, "nothing", ["Cutting", "baking", "CUTTING"], "a", None),
    (5, None, None, None, None),
    (6, "cutting and welding", ["cutting"], "a", ["welding"]),
]


def test_bundle_lists(spark):
    found = bundle(spark, ROWS, show_direct=False)
    # one direct class: its mentioned kin joins it, and both are verified as a family
    assert found[1, "direct"] == [("c1", 1.0), ("c2", 0.62)] and found[1, "verified"] == [("c1", 1.0), ("c2", 0.62)]
    assert found[1, "reverse"] == [("c1", 0.62), ("c2", 0.62)] and found[1, "merged"] == [("c1", 1.0), ("c2", 0.62)]
    # baking 2 x 1.2 and oven 2 x 0.9 over 4.5; welding is beyond the margin
    assert (2, "direct") not in found and found[2, "merged"] == [("c3", 0.9333), ("c2", 0.62)] and found[2, "verified"] == [("c3", 0.9333)]
    # neither terms nor aliases: the catalogue's names are counted
    assert (3, "reverse") not in found and found[3, "merged"] == found[3, "verified"] == [("c4", 0.62)]
    # two direct classes: no kin; position is the first term's
    assert found[4, "direct"] == found[4, "merged"] == found[4, "verified"] == [("c1", 1.0), ("c3", 1.0)]
    assert not any(d == 5 for d, _ in found)
    # terms by hand lift the family lock: the usual margin holds, and the hint adds 0.8
    assert found[6, "verified"] == [("c1", 1.0)] and found[6, "reverse"] == [("c1", 0.62), ("c2", 0.62)]


def test_direct_classes_are_shown(spark):
    found = bundle(spark, ROWS)
    assert found[1, "verified"] == [("c1", 1.0)] and found[2, "verified"] == [("c3", 0.9333)] and found[4, "verified"] == [("c1", 1.0), ("c3", 1.0)]


def test_every_absence_state_is_reached(spark):
    from quillmill.operators import documents as T

    texts = {
        "has_label": "| Class | Note |\n|---|---|\n| weld | 1 |", "declared_no_mapping": "| no 1 | x |\nClass: mapping none", "unsound_value": "Class: 7\nother", "blank_cell": "| Class |  -  |\nline",
        "header_without_value": "Class\ntext", "table_without_header": "| a | 1 |", "empty_document": "  \n ", "no_sign": "just text",
    }
    rows = [(i, t, r) for i, (r, t) in enumerate(texts.items())] + [(90, None, "empty_document"), (91, "| Class |\n| 5 |\n| . |\n| real name |", "has_label")]
    v = F.col("value")
    out = {r.k: r for r in T.absence_states(spark.createDataFrame(rows, "k int, t string, r string"), "k", "t", "^Class$", "[0-9]", "none", F.length(v).between(2, 40) & v.rlike("[a-z]")).collect()}
    assert {k: out[k].reason for k, _, _ in rows} == {k: r for k, _, r in rows}
    assert out[91].states == ["saw_header", "saw_table", "unsound_value", "blank_cell", "value"]
    marked = T.absence_states(spark.createDataFrame(rows, "k int, t string, r string").withColumn("f", F.col("k") == 7), "k", "t", "^Class$", "[0-9]", "none", F.lit(True), F.col("f")).filter("k = 7").collect()
    assert marked[0].reason == "has_label"


def test_sections_pass_the_anchor_test_and_score(spark):
    from quillmill.operators import documents as T

    text = "Talk ..... 3\nTalk first\nask 5 minutes\nTable of words\nWritten part\nplain\nTalk again\nnothing\nAppendix\nask more"
    rows = [(1, text), (2, "Talk only\nask"), (3, "Talk\nx\nWritten\ny"), (4, "no method"), (5, None), (6, "Talk " + "x" * 200 + "\nWritten\nask")]
    c = F.col("content")
    method = F.when(c.startswith("Talk"), "talk").when(c.startswith("Written"), "written")
    out = T.method_sections(spark.createDataFrame(rows, "k int, t string"), "k", "t", method, [c.contains("ask")], [c.rlike("[0-9] minutes")], "[A-Z][a-z]+le", c == "Appendix").collect()
    assert {(r.k, r.method): (r.origin, r.sections, r.n_lines, r.score) for r in out} == {
        # only one of two methods has a section that scores
        (1, "talk"): ("full_document", 1, 10, 4), (1, "written"): ("full_document", 1, 10, 0), (2, "talk"): ("document_section", 1, 2, 1),
        (3, "talk"): ("full_document", 1, 4, 0), (3, "written"): ("full_document", 1, 4, 0), (6, "talk"): ("full_document", 1, 3, 0), (6, "written"): ("full_document", 1, 3, 1),
    }
    both = T.method_sections(spark.createDataFrame([(1, text.replace("plain", "ask Table"))], "k int, t string"), "k", "t", method, [c.contains("ask")], [c.rlike("[0-9] minutes")], "[A-Z][a-z]+le", c == "Appendix").collect()
    assert {(r.method, r.origin, r.sections, r.n_lines, r.score) for r in both} == {("talk", "document_section", 1, 3, 4), ("written", "document_section", 1, 2, 2)}
