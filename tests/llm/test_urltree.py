"""The tree of path templates against a walk over nested nodes."""

import math
import random
from collections import defaultdict

from contactmill.llm import urltree

NONE = None


def walk(rows):
    """(host, leaf tuple, bad) rows -> (host, leaf) -> (template, purity)."""
    leaves = defaultdict(lambda: [0, 0, 0])
    for host, leaf, bad in rows:
        c = leaves[host, leaf]
        c[0] += 1
        c[1] += bad is not None
        c[2] += bad or 0
    template = {k: list(k[1]) for k in leaves}
    depth = max((len(k[1]) for k in leaves), default=0)
    for level in range(depth):
        child = defaultdict(int)
        for k, c in leaves.items():
            if len(template[k]) > level:
                child[k[0], tuple(template[k][:level]), template[k][level]] += c[0]
        up = defaultdict(list)
        for (h, pre, seg), n in child.items():
            up[h, pre].append(n)
        new = {}
        for k in leaves:
            t = template[k]
            if len(t) > level:
                ns = up[k[0], tuple(t[:level])]
                n = child[k[0], tuple(t[:level]), t[level]]
                if len(ns) > urltree.BRANCHES and len(ns) * 4 > sum(ns) and n * len(ns) <= urltree.RARE * sum(ns):
                    new[k] = "*"
        for k, v in new.items():
            template[k][level] = v
    for level in range(depth, 0, -1):
        node = defaultdict(lambda: [0, 0])
        for k, c in leaves.items():
            if len(template[k]) >= level:
                x = node[k[0], tuple(template[k][:level])]
                x[0] += c[1]
                x[1] += c[2]
        family = defaultdict(list)
        for (h, t), x in node.items():
            family[h, t[:-1]].append(x)
        alike = set()
        for (h, t), (n, b) in node.items():
            kin = family[h, t[:-1]]
            if len(kin) < 2:
                continue
            nn, bb = sum(x[0] for x in kin), sum(x[1] for x in kin)
            differs = False
            if n and nn - n:
                p = bb / nn
                differs = abs(b / n - (bb - b) / (nn - n)) > urltree.Z * math.sqrt(p * (1 - p) * (1 / n + 1 / (nn - n)))
            if not differs:
                alike.add((h, t))
        for k in leaves:
            if len(template[k]) >= level and (k[0], tuple(template[k][:level])) in alike:
                template[k] = [*template[k][:level - 1], "*", *template[k][level:]]
    n, b = sum(c[1] for c in leaves.values()), sum(c[2] for c in leaves.values())
    smooth = lambda b, n, prior: (b + urltree.WEIGHT * prior) / (n + urltree.WEIGHT)
    host, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, c in leaves.items():
        for x in (host[k[0]], own[k[0], tuple(template[k])]):
            x[0] += c[1]
            x[1] += c[2]
    hosts = {h: smooth(b_, n_, b / n if n else 0.0) for h, (n_, b_) in host.items()}
    return {k: ("/".join(template[k]), smooth(own[k[0], tuple(template[k])][1], own[k[0], tuple(template[k])][0], hosts[k[0]])) for k in leaves}


def leaf_of(path):
    parts = ["*" if any(c.isdigit() for c in s) else s for s in path.split("/") if s]
    return tuple(parts[:urltree.DEPTH] + ["/".join(parts[urltree.DEPTH:])] if len(parts) > urltree.DEPTH else parts)


def made(rng):
    rows = []
    for _ in range(1500):
        host = rng.choice(["a.org", "b.org", "c.org"])
        first = rng.choice(["blog", "shop", "casino", "x" + rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghij")])
        path = "/" + "/".join([first, *[rng.choice(["p", "q", "r", str(rng.randrange(99))]) for _ in range(rng.randrange(0, 3))]])
        if rng.random() < 0.05:
            path += "/d/e/f/g/h/" + rng.choice(["good", "bad"])
        bad = None if rng.random() < 0.3 else int(rng.random() < (0.95 if first == "casino" or path.endswith("bad") else 0.05))
        rows.append((host, path, bad))
    return rows


def test_templates_and_purity_equal_a_walk(spark):
    rows = made(random.Random(2))
    df = spark.createDataFrame([(i, f"http://{h}{p}", b) for i, (h, p, b) in enumerate(rows)], "page_id long, url string, bad int").repartition(3)
    want = walk([(h, leaf_of(p), b) for h, p, b in rows])
    got = {r["page_id"]: r for r in urltree.judged(df).collect()}
    assert len({t for t, _ in want.values()}) > 5
    for i, (h, p, _) in enumerate(rows):
        template, purity = want[h, leaf_of(p)]
        assert got[i]["template"] == template and abs(got[i]["purity"] - purity) < 1e-9, (rows[i], template, got[i])


def test_a_frequent_child_of_a_wide_node_is_seen(spark):
    rng = random.Random(3)
    slugs = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(100)})
    rows = [(f"http://h.org/{s}", 0) for s in slugs for _ in range(2)] + [("http://h.org/casino", 1)] * 50
    got = urltree.judged(spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int")).collect()
    assert {r["verdict"] for r in got if r["path"] == "/casino"} == {"block"} and {r["verdict"] for r in got if r["path"] != "/casino"} == {"allow"}


def test_levels_below_the_sixth_are_seen(spark):
    rows = [(f"http://h.org/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(200)] + [("http://h.org/" + "s/" * 3000, None)]
    got = urltree.judged(spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int")).collect()
    assert {r["verdict"] for r in got if "/bad/" in r["path"]} == {"block"} and {r["verdict"] for r in got if "/good/" in r["path"]} == {"allow"}
