import random

from sheetloom.operators import failover, layout


def chained(spark, keys, models, outcomes):
    """Attempts as (vendor, credential, model, listed, notice_to) and the outcome of one chain; outcomes: 'ok', 'again', or 'no'."""
    frames = (
        spark.createDataFrame([(1, v, p, k, q, f) for v, p, k, q, f in keys], "c int, vendor string, vendor_pos int, credential string, credential_pos int, first string"),
        spark.createDataFrame([(1, *m) for m in models], "c int, vendor string, credential string, model string"),
        spark.createDataFrame([(1, *o[:3], o[3] == "ok", o[3] == "again", f"{o[1]}:{o[2]}") for o in outcomes], "c int, vendor string, credential string, model string, ok boolean, retryable boolean, error string"),
    )
    done = failover.nested_chain(*frames, ["c"]).cache()
    rows = done.orderBy("attempt").collect()
    assert [r.ended for r in rows] == [False] * (len(rows) - 1) + [True] and [r.attempt for r in rows] == list(range(1, len(rows) + 1))
    end = failover.chain_outcome(done, ["c"]).first()
    return [(r.vendor, r.credential, r.model, r.listed, r.notice_to) for r in rows], (end.outcome, end.model, end.error, end.attempts, end.lists)


NAMES = ["x-flash-9", "x-flash-8", "x-flash-7", "x-flash-6", "x-flash-5", "x-flash-4", "x-flash-3"]


def test_budgets_of_nested_chains(spark):
    keys = [("a", 1, "k1", 1, "mine"), ("a", 1, "k2", 2, "mine"), ("b", 2, "k3", 1, "other")]
    models = [("a", k, m) for k in ("k1", "k2") for m in [*NAMES, "mine", "x-embedding"]] + [("b", "k3", "x-pro")]
    fails = [("a", k, m, "again") for k in ("k1", "k2") for m in [*NAMES, "mine"]]
    told, end = chained(spark, keys, models, [*fails, ("b", "k3", "other", "again"), ("b", "k3", "x-pro", "ok")])
    first = ["mine", *NAMES[:4]]
    assert [t[:3] for t in told] == [("a", "k1", m) for m in first] + [("a", "k2", m) for m in first[:2]] + [("b", "k3", "other"), ("b", "k3", "x-pro")]
    assert [t[3] for t in told] == [True, False, False, False, False, True, False, True, False]  # a list is asked for once, after the first failure
    assert [t[4] for t in told] == [*NAMES[:4], NAMES[4], *NAMES[:2], "x-pro", None]  # also the fifth failure announces a model, which isn't tried
    assert end == ("success", "x-pro", None, 9, 3)
    told, end = chained(spark, keys, models, [*fails, ("b", "k3", "other", "again"), ("b", "k3", "x-pro", "again")])
    assert len(told) == 9 and end == ("exhausted", None, f"k2:{NAMES[0]}", 9, 3)  # the chosen vendor's last error


def test_what_ends_a_chain(spark):
    keys = [("a", 1, "k1", 1, "m"), ("b", 2, None, 1, "m"), ("c", 3, "k3", 1, "m")]
    told, end = chained(spark, keys, [], [("a", "k1", "m", "again"), ("c", "k3", "m", "ok")])
    assert told == [("a", "k1", "m", True, None), ("b", None, None, False, None)] and end == ("fatal", None, "no credentials", 1, 1)
    told, end = chained(spark, keys, [], [("a", "k1", "m", "no")])
    assert told == [("a", "k1", "m", False, None)] and end == ("fatal", None, "k1:m", 1, 0)
    told, end = chained(spark, keys, [], [])
    assert end == ("fatal", None, None, 1, 0)


def placed(spark, graphs):
    rows = spark.createDataFrame([(i, [(b,) for b in blocks], edges) for i, (blocks, edges) in enumerate(graphs)], "i int, blocks array<struct<id:string>>, connections array<struct<`from`:string,`to`:string>>")
    return {r.i: r for r in layout.layouts(rows).collect()}


def test_a_small_diagram(spark):
    got = placed(spark, [(["in", "reg", "out", "fb", "alone"], [("in", "reg"), ("reg", "out"), ("out", "fb"), ("fb", "reg"), ("in", "out"), ("reg", "reg"), ("reg", "zz")]), ([], []), (None or ["x", "x", None], [(None, "x")])])
    r = got[0]
    assert {n.id: (n.layer, n.place) for n in r.nodes} == {"in": (0, 0), "alone": (0, 1), "reg": (1, 0), "out": (2, 0), "fb": (3, 0)}
    assert [(e["from"], e.to, e.back, e.side, e.lane) for e in r.edges] == [("in", "reg", False, False, None), ("reg", "out", False, False, None), ("out", "fb", False, False, None), ("fb", "reg", True, True, 0), ("in", "out", False, True, 1)]
    assert r.width == 2 * layout.WIDTH + layout.GAP_X + 2 * layout.LANE and r.height == 4 * layout.HEIGHT + 3 * layout.GAP_Y
    assert got[1].nodes == [] and got[1].edges == [] and got[1].width == got[1].height == 0
    assert [n.id for n in got[2].nodes] == ["x", None] and [(e["from"], e.to) for e in got[2].edges] == [(None, "x")]


def test_random_diagrams(spark):
    dice = random.Random(5)
    graphs = []
    for _ in range(60):
        names = [f"n{i}" for i in range(dice.randint(1, 9))]
        graphs.append((names, [(dice.choice(names), dice.choice(names)) for _ in range(dice.randint(0, 14))]))
    for i, r in placed(spark, graphs).items():
        names, edges = graphs[i]
        layers = {n.id: n.layer for n in r.nodes}
        assert [(e["from"], e.to) for e in r.edges] == [e for e in edges if e[0] != e[1]] and set(layers) == set(names)
        ahead = [(e["from"], e.to) for e in r.edges if not e.back]
        assert all(layers[u] < layers[v] for u, v in ahead)  # without back edges nothing is a cycle
        for n in names:
            own = [layers[u] for u, v in ahead if v == n]
            assert layers[n] == (max(own) + 1 if own else 0)

        def reaches(u, v):
            seen, open_ = set(), [u]
            while open_:
                x = open_.pop()
                for a, b in edges:
                    if a == x and b not in seen and a != b:
                        seen.add(b)
                        open_.append(b)
            return v in seen

        assert all(e.back == (names.index(e.to) < names.index(e["from"]) and reaches(e.to, e["from"])) for e in r.edges)
        for layer in set(layers.values()):
            assert sorted(n.place for n in r.nodes if n.layer == layer) == list(range(sum(x == layer for x in layers.values())))


def test_a_wide_diagram(spark):
    """Means of more places than 32 bits hold, and many steps within one report."""
    names = [f"s{i}" for i in range(2200)]
    r = placed(spark, [([*names, "hub", "last"], [*((s, "hub") for s in names), ("hub", "last"), ("last", "hub")])])[0]
    assert [n.place for n in r.nodes] == [*range(2200), 0, 0] and [n.layer for n in r.nodes[-2:]] == [1, 2]
    assert [e.to for e in r.edges if e.back] == ["hub"] and sum(e.side for e in r.edges) == 1 and r.width == 2200 * (layout.WIDTH + layout.GAP_X) - layout.GAP_X + layout.LANE


def test_reports_are_placed_alike_together_and_alone(spark):
    dice = random.Random(8)
    graphs = [([], []), ([f"n{i}" for i in range(500)], [(f"n{i + d}", f"n{i + 1 - d}") for i in range(499) for d in (0, 1)]), (["x"], [("x", "x")])]
    graphs += [([f"n{i}" for i in range(7)], [(f"n{dice.randrange(7)}", f"n{dice.randrange(7)}") for _ in range(9)]) for _ in range(40)] + [([], [])]
    together = placed(spark, graphs)
    assert [n.layer for n in together[1].nodes] == list(range(500)) and sum(e.back for e in together[1].edges) == 499
    for i in range(6):
        assert together[i][3:] == placed(spark, [graphs[i]])[0][3:]
