"""Layout grouping against the texts that generated pages were set from, and against brute force."""

import random

from paperloom.operators import layout

SCHEMA = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, block string, line int"


def set_page(deal, doc, page):
    """Glyphs of a heading over two columns whose lines don't stand level, and the text they give."""
    word = lambda: "".join(deal.choices("abcdefgh", k=deal.randint(1, 5)))
    glyphs, text = [], []

    def line(x, y):
        words = [word() for _ in range(deal.randint(1, 4))]
        for w in words:
            for c in w:
                glyphs.append((doc, page, x, y, x + 5.0, y + 8.0 + deal.random(), c, "clash", 1))
                x += 5.0
            x += 4.0
        text.append(" ".join(words))

    line(150.0, 760.0)
    for column in range(2):
        for k in range(deal.randint(1, 6)):
            line(20.0 + 300.0 * column, 700.0 - 12.0 * k - 5.0 * column)
    deal.shuffle(glyphs)
    return glyphs, "\n".join(text)


def test_pages_read_as_they_were_set(spark):
    deal, rows, want = random.Random(6), [], {}
    for doc in range(8):
        for page in range(3):
            glyphs, text = set_page(deal, doc, page)
            rows += glyphs
            want[doc, page] = text
    rows += [(1, 0, None, 1.0, 2.0, 3.0, "x", "", 1), (1, 0, 1.0, 1.0, 2.0, 3.0, None, "", 1)]
    glyphs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = layout.lines(glyphs)
    got = {(r["doc_id"], r["page"]): (r["text"], r["n_lines"]) for r in layout.page_texts(found).collect()}
    assert got == {k: (t, t.count("\n") + 1) for k, t in want.items()}
    assert layout.page_texts(layout.lines(glyphs.limit(0))).count() == 0


def merged(items, start, end, gap):
    """Groups of items whose intervals hang together, by comparing all with all."""
    groups = [[i] for i in items]
    joined = True
    while joined:
        joined = False
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                if any(start(x) <= end(y) + gap and start(y) <= end(x) + gap for x in groups[a] for y in groups[b]):
                    groups[a] += groups.pop(b)
                    joined = True
                    break
            if joined:
                break
    return sorted(groups, key=lambda g: min(start(x) for x in g))


def test_cuts_equal_brute_force(spark):
    deal, rows = random.Random(8), []
    for page in range(6):
        for _ in range(25):
            x, y = deal.randint(0, 400), deal.randint(0, 300)
            rows.append((1, page, float(x), float(y + deal.randint(1, 9)), float(x + deal.randint(1, 60)), float(y), deal.choice("abc"), "", 1))
    want = []
    for page in range(6):
        own = [(r[2], min(r[3], r[5]), r[4], max(r[3], r[5]), r[6]) for r in rows if r[1] == page]
        for b, block in enumerate(merged(own, lambda g: -g[3], lambda g: -g[1], 20.0), 1):
            for c, column in enumerate(merged(block, lambda g: g[0], lambda g: g[2], 30.0), 1):
                for n, line in enumerate(merged(column, lambda g: -g[3], lambda g: -g[1], -0.5), 1):
                    line.sort(key=lambda g: (g[0], g[2], g[4]))
                    want.append((page, b, c, n, "".join((" " if i and g[0] - line[i - 1][2] > 1.5 else "") + g[4] for i, g in enumerate(line))))
    got = layout.lines(spark.createDataFrame(rows, SCHEMA)).select("page", "block", "column", "line", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pages_are_shuffled_once(spark):
    deal, rows = random.Random(9), []
    for doc in (None, 1, 2):
        for page in range(2):
            rows += [(doc, page, float(deal.randint(0, 9)), float(y := deal.randint(0, 60)), float(deal.randint(0, 9)), float(y + 5), deal.choice(["b", "ab", "\u00e9", ""]), "", 1) for _ in range(40)]
    glyphs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = layout.texts(glyphs)
    want = layout.page_texts(layout.lines(glyphs)).collect()
    assert len(want) == 6 and sorted(map(str, found.collect())) == sorted(map(str, want))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and layout.texts(glyphs.limit(0)).count() == 0
    ends = layout.lines(spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 9.0, "b", "", 1), (1, 0, 0.0, 0.0, 1.0, 9.0, "a", "", 1), (1, 0, float("nan"), 0.0, 2.0, 9.0, "c", "", 1)], SCHEMA)).select("column", "text")
    assert [tuple(r) for r in ends.collect()] == [(1, "abc")]
