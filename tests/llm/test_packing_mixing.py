import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from rotativa.llm import mixing as X
from rotativa.llm import packing as P
from rotativa.llm.tokens import VOCABULARY, count_tokens, token_counts

os_vocab = pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no vocabulary")


def check_plan(hist, capacity, plan):
    got = Counter()
    for pick, n in plan:
        assert sum(k * m for k, m in pick.items()) <= capacity and n > 0
        for k, m in pick.items():
            got[k] += m * n
    assert got == Counter({k: v for k, v in hist.items() if v})
    return sum(n for _, n in plan)


def test_knapsack_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        size = np.array(sorted(rnd.sample(range(1, 12), 4)))
        price = np.array([rnd.random() for _ in size])
        most = np.array([rnd.randint(0, 4) for _ in size])
        cap = rnd.randint(5, 25)
        sack = P.Knapsack(size, price, most, cap)
        c = np.zeros(4, int)
        for i, n in sack.content(cap).items():
            c[i] = n
        assert (c <= most).all() and (c * size).sum() <= cap
        best = max((a * price[0] + b * price[1] + d * price[2] + e * price[3]) for a in range(most[0] + 1) for b in range(most[1] + 1) for d in range(most[2] + 1) for e in range(most[3] + 1) if a * size[0] + b * size[1] + d * size[2] + e * size[3] <= cap)
        assert abs((c * price).sum() - best) < 1e-9


@pytest.mark.parametrize("capacity", [10, 64, 300])
def test_plan_is_complete_and_tight(capacity):
    rnd = random.Random(capacity)
    hist = Counter(rnd.randint(1, capacity) for _ in range(3000))
    n = check_plan(hist, capacity, P.make_plan(dict(hist), capacity))
    bound = max(-(-sum(k * v for k, v in hist.items()) // capacity), sum(v for k, v in hist.items() if 2 * k > capacity))
    assert n <= 1.03 * bound + 1
    assert P.make_plan({}, capacity) == [] and check_plan({capacity: 7}, capacity, P.make_plan({capacity: 7}, capacity)) == 7


def best_fit(hist, capacity):
    """Containers of the plain rule: the longest item, then always the longest that fits."""
    left, used = Counter(hist), 0
    while left := Counter({k: v for k, v in left.items() if v}):
        room, pick = capacity, Counter()
        for k in sorted(left, reverse=True):
            n = min(left[k], room // k)
            pick[k], room = n, room - n * k
        times = min(left[k] // n for k, n in pick.items() if n)
        used += times
        left.subtract({k: n * times for k, n in pick.items()})
    return used


@pytest.mark.parametrize("capacity,mean", [(256, 150), (512, 220), (1024, 300), (3000, 300)])
def test_plan_against_best_fit_and_bound(capacity, mean):
    rng = np.random.default_rng(capacity)
    hist = dict(Counter(np.clip(rng.lognormal(np.log(mean), 0.6, 8000).astype(int), 1, capacity).tolist()))
    n = check_plan(hist, capacity, P.make_plan(hist, capacity))
    assert P.lower_bound(hist, capacity) - 1e-6 <= n <= best_fit(hist, capacity)


def test_program_is_feasible_and_bounded():
    size, demand = np.array([3, 5, 7, 11]), np.array([40.0, 25, 30, 12])
    s = P.solve(size, demand, 20, rounds=2000)
    covered = np.zeros(4)
    for c, x in s.configurations.items():
        assert sum(int(size[i]) * n for i, n in c) <= 20
        for i, n in c:
            covered[i] += n * x
    assert (covered >= demand - 1e-6).all() and s.bound <= s.containers <= 1.2 * s.bound


def test_many_equal_items_are_fast():
    hist = {k: 10**9 for k in range(1, 60)}
    check_plan(hist, 100, P.make_plan(hist, 100))


@os_vocab
def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, "palabra " * rnd.choice((1, 5, 20, 90, 400)), "q") for i in range(300)] + [(900, None, "q"), (901, "", "q"), (None, "x", "q"), (1, "repetida", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, numero string").repartition(5)
    sizes = [("S", 64), ("L", 512)]
    out = P.pack(df, sizes).collect()
    tokens = {}
    for i, t, _ in rows:
        if i is not None and t:
            tokens.setdefault(i, []).append(count_tokens(t))
    for name, cap in sizes:
        load, per = Counter(), defaultdict(list)
        for r in out:
            if r.contenedor == name:
                load[r.numero] += r.tokens
                per[r.doc_id].append(r)
        assert max(load.values()) <= cap
        assert {i: sum(v) for i, v in tokens.items()} == {i: sum(r.tokens for r in rs) for i, rs in per.items()}
        for i, rs in per.items():
            if sum(tokens[i]) <= cap:
                assert all(r.parte == 0 for r in rs)
        assert all(load[n] == cap for n in load if n < 0)
    fill = {r.contenedor: r for r in P.fill(P.pack(df, sizes), sizes).collect()}
    assert fill["L"].llenado > 0.95 and fill["L"].tokens == sum(map(sum, tokens.values()))
    assert P.pack(df.where("false"), sizes).count() == 0


def test_sainte_lague():
    assert X.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    assert X.sainte_lague([1, 1], 3) == [2, 1] and X.sainte_lague([0, 5], 4) == [0, 4] and X.sainte_lague([], 3) == [] and X.sainte_lague([1, 2], 0) == [0, 0]
    assert X.sainte_lague([1, 1], 10, [2, 3]) == [2, 3]
    rnd = random.Random(1)
    for _ in range(100):
        w = [rnd.randint(0, 50) for _ in range(5)]
        n, s = rnd.randint(0, 40), [0] * 5
        for _ in range(n if any(w) else 0):
            q = [x / (2 * k + 1) for x, k in zip(w, s)]
            s[q.index(max(q))] += 1
        got = X.sainte_lague(w, n)
        assert sum(got) == sum(s)
        # the highest quotients: no seat could be given better
        taken = [w[i] / (2 * got[i] - 1) for i in range(5) if got[i]]
        left = [w[i] / (2 * got[i] + 1) for i in range(5) if w[i]]
        assert not taken or min(taken) >= max(left) - 1e-9


@os_vocab
def test_draw(spark):
    rnd = random.Random(4)
    rows = [(i, "palabra " * rnd.randint(1, 60), "A" if i % 3 else "B") for i in range(1500)] + [(5000 + i, "otra " * 20, "C") for i in range(40)] + [(9000, None, "A"), (9001, "x", None), (None, "x", "A"), (9002, "x", "Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    goals = spark.createDataFrame([("A", 0.5, 1), ("B", 0.2, 2), ("C", 0.1, 3), ("D", 0.2, 5), ("E", None, None)], "source string, target_share double, max_repeats int")
    drawn = X.draw(docs, goals)
    got = drawn.collect()
    most = {"A": 1, "B": 2, "C": 3}
    assert all(1 <= r.veces <= most[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    share = {r.source: r.parte for r in X.reached(drawn, goals).collect()}
    assert share["D"] == 0 and share["E"] == 0
    for s, t in (("A", 0.5), ("B", 0.2), ("C", 0.1)):
        assert abs(share[s] - t / 0.8) < 0.02
    assert sorted(map(tuple, X.draw(docs, goals).collect())) == sorted(map(tuple, got))
    assert X.draw(docs.where("false"), goals).count() == 0 and X.draw(docs, goals.where("false")).count() == 0


@os_vocab
def test_tokens(spark):
    df = spark.createDataFrame([(1, "hola mundo"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in token_counts(df).collect()} == {1: count_tokens("hola mundo"), 2: 0, 3: 0}
