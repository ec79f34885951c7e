"""Nested content of random shape against the rules read from above."""

import random

from lorekeep.operators import extraction

KNOWN = ["text", "card"]


def grown(rng, path, kind, depth):
    """A random node and those below it, as rows of NODES without the page."""
    label = {"en": f"L{len(path)}"} if rng.random() < 0.4 else None
    if kind == "field":
        type_ = rng.choice(["text", "Writer", "email", "pages", None] + (["structure", "object", "blocks", "layout"] if depth else []))
        name = rng.choice(["a", "b", "apiKey", "Icon", "text"])
        rows = [(path, kind, name, type_, label, None, rng.choice(["", "v", f"<b>v{path[-1]}</b>", None]), rng.choice([None, [], ["x"], ["y", "x", "gone"]]))]
        below = {"structure": "item", "object": "item", "blocks": "block", "layout": "row"}.get(type_)
    else:
        type_ = rng.choice(["text", "card", "code", "own"]) if kind == "block" else None
        rows = [(path, kind, None, type_, None, rng.choice([True, False, None]) if kind == "block" else None, None, None)]
        below = {"item": "field", "block": "field", "row": "column", "column": "block"}[kind]
    # children under a node that can't hold any are left alone
    if depth and (below or rng.random() < 0.2):
        places = rng.sample(range(6), rng.randint(0, 3))
        for at in places:
            rows += grown(rng, path + [at], below or "item", depth - 1)
    return rows


def plain_text(rows, summaries):
    nodes = {tuple(r[0]): r for r in rows}

    def children(path):
        return sorted(p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path)

    def joined(path):
        texts = [(nodes[p][1], read(p)) for p in children(path)]
        texts = [(k, t) for k, t in texts if t]
        return ("\n" if path and texts and all(k == "field" for k, _ in texts) else "\n\n").join(t for _, t in texts)

    def read(path):
        _, kind, name, type_, label, hidden, value, targets = nodes[path]
        if kind == "block" and (hidden or type_ not in KNOWN):
            return ""
        if kind != "field":
            return joined(path)
        if name in ("apiKey",) or (len(path) > 1 and name == "Icon"):
            return ""
        type_ = (type_ or "").lower()
        text = ""
        if type_ in ("text", "writer"):
            text = (value or "").replace("<b>", "").replace("</b>", "")
        elif type_ == "pages":
            text = "\n\n".join(summaries[t] for t in targets or [] if t in summaries)
        elif type_ in ("structure", "object", "blocks", "layout"):
            text = joined(path)
        return f"{label['en']}: {text}" if label and text else text

    return joined(())


def test_trees_equal_the_recursive_reading(spark):
    rng = random.Random(11)
    pages, summaries = {}, {"x": "Titel: X", "y": "Titel: Y\nmore"}
    for k in range(40):
        pages[f"p{k}"] = [r for at in rng.sample(range(8), rng.randint(0, 5)) for r in grown(rng, [at], "field", rng.choice([0, 2, 6]))]
    rows = [(k, *r) for k, found in pages.items() for r in found]
    nodes = spark.createDataFrame(rows, extraction.NODES).repartition(5)
    got = {r.page_key: r.text for r in extraction.tree_text(nodes, KNOWN, spark.createDataFrame(list(summaries.items()), "page_key string, summary string")).collect()}
    want = {k: t for k, found in pages.items() if (t := plain_text(found, summaries))}
    assert got == want and max(len(r[1]) for r in rows) >= 6 and len(want) > 15


def test_trees_of_nothing(spark):
    empty = spark.createDataFrame([], extraction.NODES)
    assert extraction.tree_text(empty, KNOWN).count() == 0 and extraction.tree_text(empty, KNOWN).columns == ["page_key", "text"]
