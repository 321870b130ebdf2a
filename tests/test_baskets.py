from itertools import combinations

import numpy as np
import pytest

from cartlens.operators import baskets as bk
from cartlens.operators import rules as rl


@pytest.fixture(scope="module")
def orders():
    """Sixty orders over seven items; one order holds every item."""
    rng = np.random.default_rng(5)
    found = [{f"i{j}" for j in range(7) if rng.random() < [0.8, 0.7, 0.6, 0.5, 0.4, 0.2, 0.02][j]} for _ in range(59)]
    return [*found, {f"i{j}" for j in range(7)}]


@pytest.fixture(scope="module")
def lines(spark, orders):
    rows = [(f"o{n}", i) for n, items in enumerate(orders) for i in items]
    return bk.multi_item_lines(spark.createDataFrame(rows, "order_id string, item string"), min_orders=3)


def by_hand(orders, support, confidence):
    kept = {i for i in {i for o in orders for i in o} if sum(i in o for o in orders) >= 3}
    several = [o & kept for o in orders if len(o & kept) > 1]
    n, share = len(several), {}
    for size in range(1, len(kept) + 1):
        for items in combinations(sorted(kept), size):
            count = sum(set(items) <= o for o in several)
            if count / n >= support:
                share[items] = count
    found = {}
    for items, count in share.items():
        for size in range(1, len(items)):
            for left in combinations(items, size):
                if count / share[left] >= confidence:
                    found[left, tuple(i for i in items if i not in left)] = count / share[left]
    return share, found


@pytest.mark.parametrize(("support", "confidence"), [(0.1, 0.5), (0.05, 0.9), (0.3, 0.0)])
def test_itemsets_and_rules_against_enumeration(orders, lines, support, confidence):
    share, found = by_hand(orders, support, confidence)
    mined = bk.mine(lines, support, confidence)
    assert {tuple(r["items"]): r.freq for r in mined.itemsets.collect()} == share
    assert max(len(i) for i in share) >= 3
    got = {(tuple(r.antecedents), tuple(r.consequents)): r.confidence for r in mined.rules.collect()}
    assert set(got) == set(found)
    assert all(got[k] == pytest.approx(found[k]) for k in found)


def test_minimum_count():
    for n in range(1, 200):
        for support in (0.01, 0.05, 0.1, 0.3, 0.7, 1.0):
            count = bk.minimum_count(support, n)
            assert count / n >= support and (count == 1 or (count - 1) / n < support)


def test_retry_and_empty_results(spark, lines):
    once = bk.mine_with_retry(lines, 0.1, 0.5)
    assert not once.retried and not once.rules.isEmpty()
    never = bk.mine_with_retry(spark.createDataFrame([], "order_id string, item string"))
    assert never.retried and never.rules.isEmpty()
    assert rl.recommend(never.rules).isEmpty()
    assert rl.rule_quality(never.rules).head().n_rules == 0
    strict = bk.mine_with_retry(lines, 0.9, 0.9)
    assert strict.retried and (strict.min_support == 0.45 or strict.rules.isEmpty())


def test_recommendations_against_a_loop(lines):
    rules = bk.mine(lines, 0.1, 0.3).rules.collect()
    got = {}
    for r in rl.recommend(bk.mine(lines, 0.1, 0.3).rules, 3).orderBy("product", "position").collect():
        got.setdefault(r["product"], []).append(r.recommended_product)
    for product in {i for r in rules for i in r.antecedents}:
        best = sorted(
            (r for r in rules if product in r.antecedents),
            key=lambda r: (-round(r.lift, 9), -round(r.confidence, 9), r.antecedents, r.consequents),
        )[:3]
        want = list(dict.fromkeys(i for r in best for i in r.consequents))[:3]
        assert got[product] == want


def test_unknown_product_has_no_recommendation(lines):
    assert rl.recommend_for(bk.mine(lines, 0.1, 0.3).rules, "nothing").isEmpty()


def test_months_of_an_order_that_spans_two(spark):
    facts = spark.createDataFrame(
        [("o1", "a", "2020-01-31"), ("o1", "c", "2020-02-01"), ("o2", "a", "2020-02-03"), ("o3", "c", "2020-03-01")],
        "order_id string, product_name string, order_date string",
    ).selectExpr("order_id", "product_name", "cast(order_date as date) as order_date", "1.0D as quantity")
    rules = spark.createDataFrame([(["a"], ["c"])], "antecedents array<string>, consequents array<string>")
    got = {r.month: (r.n_orders, r.confidence) for r in rl.temporal_confidence(rules, facts).collect()}
    assert got == {"2020-01": (1, 1.0), "2020-02": (2, 0.5)}
    preview = rl.temporal_preview(rl.temporal_confidence(rules, facts)).head()
    assert preview.preview == "2020-01: 1.00, 2020-02: 0.50"


def test_cross_category_treats_empty_sets_as_disjoint(spark):
    rules = spark.createDataFrame(
        [(["a"], ["b"], 1.0), (["a"], ["c"], 1.0), (["x"], ["y"], 1.0)],
        "antecedents array<string>, consequents array<string>, lift double",
    )
    categories = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "item string, category string")
    kept = rl.cross_category_rules(rl.rule_categories(rules, categories)).collect()
    assert sorted(r.consequents[0] for r in kept) == ["c", "y"]


def test_pairs_need_no_trees(spark, monkeypatch):
    """Without three items that are frequent in pairs no tree is grown; with them, the trees see only their orders."""
    def itemsets(orders, support):
        rows = [(str(o), i) for o, items in enumerate(orders) for i in items]
        found = bk.frequent_itemsets(spark.createDataFrame(rows, "order_id string, item string"), support).collect()
        return {tuple(r["items"]): (r["size"], r["freq"], r["support"]) for r in found}

    def by_hand(orders, support):
        items, out = sorted(set().union(*orders)), {}
        for size in range(1, len(items) + 1):
            for some in combinations(items, size):
                freq = sum(set(some) <= set(o) for o in orders)
                if freq and freq / len(orders) >= support:
                    out[some] = (size, freq, freq / len(orders))
        return out

    seen = []
    grow = bk.FPGrowth

    class Watched(grow):
        def fit(self, data):
            seen.append(data.count())
            return super().fit(data)

    monkeypatch.setattr(bk, "FPGrowth", Watched)
    chain = [["a", "b"], ["b", "c"], ["c", "d"]] * 5 + [["a", "b", "c", "d"]]
    assert itemsets(chain, 0.2) == by_hand(chain, 0.2) and not seen
    dense = [["a", "b", "c", "d"]] * 4 + [["a", "b", "c"]] * 3 + [["d", "e"]] * 6 + [["f"]] * 3
    assert itemsets(dense, 0.2) == by_hand(dense, 0.2) and seen == [7]
