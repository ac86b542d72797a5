"""Order-dependent operators against plain loops on random inputs."""

import random

import numpy as np

from episodica.operators import cover, predicates


def test_assignment(spark):
    r = random.Random(4)
    left = [(g, f"n{i}", r.randrange(30), r.randrange(30)) for g in range(4) for i in range(25)]
    right = [(g, i, r.randrange(30), r.randrange(30)) for g in range(4) for i in range(25)]
    left += [(0, "twin", *left[0][2:]), (9, "alone", 1, 1)]
    a, b = spark.createDataFrame(left, "g int, name string, r int, c int"), spark.createDataFrame(right, "g int, ord int, r int, c int")
    got = {(x.g, x.a, x.b): x.d for x in cover.assign(a, b, ["g"], 6).collect()}
    want, pairs = {}, []
    for g, n, u, v in left:
        pairs += [(((u - x) ** 2 + (v - y) ** 2) ** 0.5, n, o, g) for h, o, x, y in right if h == g]
    used = set()
    for d, n, o, g in sorted(p for p in pairs if p[0] <= 6):
        if (g, n) not in used and (g, -1, o) not in used:
            used |= {(g, n), (g, -1, o)}
            want[g, n, o] = d
    assert got == want


def walk(seed, n=400):
    """Random motions: the hand opens and shuts, rises and turns."""
    r = np.random.default_rng(seed)
    s = np.zeros((n, 7))
    hold = lambda values, least, most: np.concatenate([np.full(r.integers(least, most), v) for v in r.choice(values, 60)])[:n]
    s[:, 6], s[:, 2], s[:, 3] = hold([0.05, 0.02, 0.03, 0.001], 4, 30), hold([0, 0.02, 0.05, 0.1], 5, 25), hold([np.pi, np.pi - 0.2, np.pi - 0.7], 5, 30)
    return s


def streak(flags, k):
    out, run = [], 0
    for f in flags:
        run = run + 1 if f else 0
        out.append(run >= k)
    return out


def plain(s, kinds):
    """Steps at which picks and pours complete, scanned one after another."""
    q, z = s[:, 6], s[:, 2]
    tilt = [float(np.degrees(np.arccos(np.clip(-np.cos(x), -1, 1)))) for x in s[:, 3]]
    grasp = streak([0.006 < q[i] < 0.037 and (i == 0 or abs(q[i] - q[i - 1]) < 0.0015) for i in range(len(q))], 5)
    out, at = [], 0
    for kind in kinds:
        found = None
        if at < len(q) and kind == "pick":
            opened = False
            for i in range(at, len(q)):
                opened = opened or q[i] > 0.037
                if opened and grasp[i]:
                    found = next((j for j in range(i, len(q)) if z[j] >= z[i] + 0.03 and not q[j] > 0.037), None)
                    break
        elif at < len(q):
            away = [abs(x - tilt[at]) for x in tilt]
            turned = next((i for i in range(at, len(q)) if streak([x >= 25 for x in away], 15)[i]), None)
            if turned is not None:
                found = next((i for i in range(turned, len(q)) if streak([x <= 10 for x in away], 5)[i]), None)
        out.append(found)
        at = at if found is None else found + 1
    return out


def test_completions(spark):
    kinds = ["pick", "pour", "pick", "pick", "pour"]
    walks = {e: walk(e) for e in range(12)}
    states = spark.createDataFrame([(e, i, x.tolist()) for e, s in walks.items() for i, x in enumerate(s)], "ep int, step int, s array<double>").repartition(3)
    plan = spark.createDataFrame([(e, k, kind, "bowl") for e in walks for k, kind in enumerate(kinds)], "ep int, ord int, kind string, what string")
    got = {(r.ep, r.ord): r.t for r in predicates.completions(states, plan, "ep").collect()}
    want = {(e, k): t for e, s in walks.items() for k, t in enumerate(plain(s, kinds))}
    assert got == want and sum(t is not None for t in want.values()) > 20
