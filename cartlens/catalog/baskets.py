"""Market-basket queries.

Three item columns serve as fixtures: product names (pairs only), sub-categories, and categories (itemsets
of up to four items, rules with several consequents).
"""

from pyspark.sql import functions as F

from cartlens.catalog import tables
from cartlens.catalog.overview import histogram_sql
from cartlens.catalog.registry import RFM_SQL, query, rounded, union_all
from cartlens.functions.exprs import item_text
from cartlens.operators import baskets as bk
from cartlens.operators import overview, rules as rl

NAMES = ("product_name", 0.005, 0.05)
SUBS = ("sub_category", 0.01, 0.10)
CATEGORIES = ("category", 0.051, 0.15)
# The synthetic orders have lifts near 1, so the cut-offs of the filters are lowered for them.
LIFT = 1.1
# The synthetic names occur about equally often: the threshold that bites at every scale is their mean number of orders.
MEAN_ORDERS = "(SELECT AVG(n_orders) FROM cnt)"

CLEAN_SQL = RFM_SQL.split("places AS")[0].rstrip().rstrip(",")


def lines_sql(item: str, min_orders: int | str = 15) -> str:
    return f"""{CLEAN_SQL},
b AS (SELECT order_id, {item} AS item FROM clean GROUP BY 1, 2 HAVING SUM(quantity) > 0),
cnt AS (SELECT item, COUNT(*) AS n_orders FROM b GROUP BY item),
keep AS (SELECT item FROM cnt WHERE n_orders >= {min_orders}),
k AS (SELECT b.* FROM b JOIN keep USING (item)),
multi AS (SELECT order_id FROM k GROUP BY order_id HAVING COUNT(*) > 1),
lines AS (SELECT k.* FROM k JOIN multi USING (order_id))"""


def sets_sql(item: str, support: float, _confidence: float = 0) -> str:
    return f"""{lines_sql(item)},
nn AS (SELECT COUNT(DISTINCT order_id) AS n FROM lines),
s1 AS (SELECT [item] AS items, COUNT(*) AS freq FROM lines GROUP BY item HAVING COUNT(*) / (SELECT n FROM nn) >= {support}),
f AS (SELECT l.* FROM lines l JOIN s1 ON l.item = s1.items[1]),
s2 AS (SELECT [a.item, b.item] AS items, COUNT(*) AS freq FROM f a JOIN f b ON a.order_id = b.order_id AND a.item < b.item
  GROUP BY a.item, b.item HAVING COUNT(*) / (SELECT n FROM nn) >= {support}),
s3 AS (SELECT [a.item, b.item, c.item] AS items, COUNT(*) AS freq FROM f a
  JOIN f b ON a.order_id = b.order_id AND a.item < b.item JOIN f c ON a.order_id = c.order_id AND b.item < c.item
  GROUP BY a.item, b.item, c.item HAVING COUNT(*) / (SELECT n FROM nn) >= {support}),
s4 AS (SELECT [a.item, b.item, c.item, d.item] AS items, COUNT(*) AS freq FROM f a
  JOIN f b ON a.order_id = b.order_id AND a.item < b.item JOIN f c ON a.order_id = c.order_id AND b.item < c.item
  JOIN f d ON a.order_id = d.order_id AND c.item < d.item
  GROUP BY a.item, b.item, c.item, d.item HAVING COUNT(*) / (SELECT n FROM nn) >= {support}),
sets AS (SELECT items, LEN(items) AS size, freq, freq / n AS support, ARRAY_TO_STRING(items, ', ') AS text
  FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4), nn)"""


def rules_sql(item: str, support: float, confidence: float) -> str:
    return f"""{sets_sql(item, support)},
splits AS (SELECT freq, list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS a,
    list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) AS c
  FROM (SELECT items, freq, UNNEST(RANGE(1, (1 << LEN(items)) - 1)) AS m FROM sets WHERE LEN(items) > 1)),
base AS (SELECT a AS antecedents, c AS consequents, sa.support AS asup, sc.support AS csup, s.freq / n AS support
  FROM splits s JOIN sets sa ON sa.items = s.a JOIN sets sc ON sc.items = s.c, nn),
rules AS (SELECT *, support / asup AS confidence, support / (asup * csup) AS lift, support - asup * csup AS leverage,
    ARRAY_TO_STRING(antecedents, ', ') AS atext, ARRAY_TO_STRING(consequents, ', ') AS ctext,
    CASE WHEN support / (asup * csup) <= 1.5 THEN 'Weak' WHEN support / (asup * csup) <= 2.5 THEN 'Moderate' ELSE 'Strong' END AS strength
  FROM base WHERE support / asup >= {confidence})"""


BY_LIFT = "ROUND(lift, 9) DESC, ROUND(confidence, 9) DESC, antecedents, consequents"


def lines(spark, sf_dir, item):
    return bk.multi_item_lines(tables.reused(bk.basket_items(tables.clean(spark, sf_dir), item)))


def sets(spark, sf_dir, fixture):
    item, support, _ = fixture
    return bk.frequent_itemsets(lines(spark, sf_dir, item), support)


def mined(spark, sf_dir, fixture):
    item, support, confidence = fixture
    return bk.mine(lines(spark, sf_dir, item), support, confidence)


def texted(rules):
    return rules.withColumns({"antecedents": item_text(F.col("antecedents")), "consequents": item_text(F.col("consequents"))})


@query(
    "baskets",
    f"WITH {lines_sql('product_name')} SELECT order_id, COUNT(*) AS n_items, STRING_AGG(item, ', ' ORDER BY item) AS items FROM b GROUP BY order_id",
)
def baskets(spark, sf_dir):
    out = bk.as_baskets(bk.basket_items(tables.clean(spark, sf_dir)))
    return out.select("order_id", F.size("items").cast("long").alias("n_items"), F.array_join("items", ", ").alias("items"))


@query("item_orders", f"WITH {lines_sql('product_name')} SELECT item, n_orders FROM cnt")
def item_orders(spark, sf_dir):
    return bk.item_orders(bk.basket_items(tables.clean(spark, sf_dir)))


def mean_pruned(spark, sf_dir):
    """The lines, and the mean number of orders of an item as the threshold."""
    items = bk.basket_items(tables.clean(spark, sf_dir))
    return items, bk.item_orders(items).agg(F.avg("n_orders")).head()[0] or 0


@query("prune_rare_items", f"WITH {lines_sql('product_name', MEAN_ORDERS)} SELECT order_id, item FROM k")
def prune_rare_items(spark, sf_dir):
    return bk.prune_rare_items(*mean_pruned(spark, sf_dir))


@query(
    "basket_stats",
    f"""WITH {lines_sql('product_name', MEAN_ORDERS)},
    z AS (SELECT order_id, COUNT(keep.item) AS n FROM b LEFT JOIN keep USING (item) GROUP BY order_id)
    SELECT COUNT(*) AS n_orders, ROUND(AVG(n), 6) AS avg_items, MAX(n) AS max_items, MIN(n) AS min_items,
      COUNT(*) FILTER (n > 1) AS multi_item_orders, (SELECT COUNT(*) FROM keep) AS n_items,
      COUNT(*) FILTER (n <= 1) AS single_item_orders, COUNT(*) FILTER (n > 1) < 100 AS small_data FROM z""",
)
def basket_stats(spark, sf_dir):
    return rounded(bk.basket_stats(*mean_pruned(spark, sf_dir)), avg_items=6)


@query(
    "multi_item_baskets",
    f"WITH {lines_sql('product_name', MEAN_ORDERS)} SELECT order_id, STRING_AGG(item, ', ' ORDER BY item) AS items FROM lines GROUP BY order_id",
)
def multi_item_baskets(spark, sf_dir):
    out = bk.multi_item_baskets(*mean_pruned(spark, sf_dir))
    return out.select("order_id", F.array_join("items", ", ").alias("items"))


def _sets_query(name, fixture):
    @query(name, f"WITH {sets_sql(*fixture)} SELECT text AS items, size, freq, ROUND(support, 9) AS support FROM sets")
    def run(spark, sf_dir):
        return rounded(sets(spark, sf_dir, fixture).withColumn("items", F.array_join("items", ", ")), support=9)


_sets_query("frequent_itemsets", NAMES)
_sets_query("frequent_itemsets_categories", CATEGORIES)


@query(
    "top_itemsets",
    f"WITH {sets_sql(*SUBS)} SELECT text AS items, size, freq, ROUND(support * 100, 6) AS support_pct FROM sets ORDER BY freq DESC, size, items LIMIT 15",
)
def top_itemsets(spark, sf_dir):
    out = bk.top_itemsets(sets(spark, sf_dir, SUBS)).withColumn("items", F.array_join("items", ", "))
    return rounded(out.select("items", "size", "freq", "support_pct"), support_pct=6)


@query("itemset_size_counts", f"WITH {sets_sql(*CATEGORIES)} SELECT size, COUNT(*) AS n FROM sets GROUP BY size")
def itemset_size_counts(spark, sf_dir):
    return bk.itemset_size_counts(sets(spark, sf_dir, CATEGORIES))


@query(
    "top_single_items",
    f"WITH {sets_sql(*NAMES)} SELECT text AS item, ROUND(support, 9) AS support, freq FROM sets WHERE size = 1 ORDER BY freq DESC, item LIMIT 10",
)
def top_single_items(spark, sf_dir):
    return rounded(bk.top_single_items(sets(spark, sf_dir, NAMES)), support=9)


METRICS_SQL = """SELECT atext AS antecedents, ctext AS consequents, ROUND(asup, 9) AS antecedent_support,
  ROUND(csup, 9) AS consequent_support, ROUND(support, 9) AS support, ROUND(confidence, 9) AS confidence,
  ROUND(lift, 9) AS lift, 1.0 AS representativity, ROUND(leverage, 9) AS leverage,
  CASE WHEN confidence < 1 THEN ROUND((1 - csup) / (1 - confidence), 9) END AS conviction,
  CASE WHEN leverage = 0 THEN 0 ELSE ROUND(leverage / GREATEST(support * (1 - asup), asup * (csup - support)), 7) END AS zhangs_metric,
  ROUND(support / (asup + csup - support), 9) AS jaccard, ROUND((confidence - csup) / (1 - csup), 9) AS certainty,
  ROUND((support / asup + support / csup) / 2, 9) AS kulczynski,
  LEN(antecedents) AS antecedent_len, LEN(consequents) AS consequent_len,
  ROUND(support * 100, 7) AS support_pct, ROUND(confidence * 100, 7) AS confidence_pct, strength AS lift_strength
FROM rules"""
_NINE = {
    c: 9
    for c in [
        "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction",
        "jaccard", "certainty", "kulczynski",
    ]
}


def rule_rows(out):
    """All columns of rules whose item sets are text, as ``METRICS_SQL`` has them."""
    out = out.withColumn("conviction", F.when(F.col("confidence") < 1, F.col("conviction")))
    return rounded(out, **_NINE, zhangs_metric=7, support_pct=7, confidence_pct=7)


def _rules_query(name, fixture):
    @query(name, f"WITH {rules_sql(*fixture)} {METRICS_SQL}")
    def run(spark, sf_dir):
        return rule_rows(texted(mined(spark, sf_dir, fixture).rules))


_rules_query("association_rules", CATEGORIES)
_rules_query("association_rules_names", NAMES)


@query(
    "rule_metrics",
    f"""WITH {CLEAN_SQL}, t AS (SELECT COUNT(*) AS n FROM clean),
    p AS (SELECT category, segment, COUNT(*) / (SELECT n FROM t) AS support FROM clean GROUP BY 1, 2),
    m AS (SELECT *, SUM(support) OVER (PARTITION BY category) AS asup, SUM(support) OVER (PARTITION BY segment) AS csup FROM p)
    SELECT category AS antecedent, segment AS consequent, ROUND(support / asup, 9) AS confidence,
      ROUND(support / (asup * csup), 9) AS lift, ROUND(support - asup * csup, 9) AS leverage,
      ROUND((1 - csup) / (1 - support / asup), 9) AS conviction, ROUND(support / (asup + csup - support), 9) AS jaccard,
      ROUND((support / asup - csup) / (1 - csup), 9) AS certainty, ROUND((support / asup + support / csup) / 2, 9) AS kulczynski
    FROM m""",
)
def rule_metrics(spark, sf_dir):
    """The measures alone, on category x segment shares."""
    clean = tables.clean(spark, sf_dir)
    total = clean.agg(F.count(F.lit(1)).cast("double")).scalar()
    cells = clean.groupBy("category", "segment").agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy("category").agg(F.sum("n").alias("na"))
    right = cells.groupBy("segment").agg(F.sum("n").alias("nc"))
    out = bk.rule_metrics(
        cells.join(left, "category").join(right, "segment").withColumn("_n", total).select(
            F.col("category").alias("antecedent"), F.col("segment").alias("consequent"),
            (F.col("na") / F.col("_n")).alias("antecedent_support"),
            (F.col("nc") / F.col("_n")).alias("consequent_support"), (F.col("n") / F.col("_n")).alias("support"),
        )
    ).select(
        "antecedent", "consequent", "confidence", "lift", "leverage", "conviction", "jaccard", "certainty", "kulczynski"
    )
    return rounded(out, **{c: 9 for c in out.columns[2:]})


@query("rule_strength_counts", f"WITH {rules_sql(*NAMES)} SELECT strength AS lift_strength, COUNT(*) AS n FROM rules GROUP BY 1")
def rule_strength_counts(spark, sf_dir):
    return rl.rule_strength_counts(mined(spark, sf_dir, NAMES).rules)


def _label_sql(scale):
    cuts = {"strength": [(3, "Very Strong"), (2, "Strong"), (1.5, "Moderate")], "strength3": [(2, "Strong"), (1.5, "Moderate")]}
    return "CASE " + " ".join(f"WHEN lift > {v} THEN '{n}'" for v, n in cuts[scale]) + f" ELSE 'Weak' END AS {scale}"


def _top_query(name, fixture, n, sort_by):
    sql = f"""WITH {rules_sql(*fixture)} SELECT atext AS antecedents, ctext AS consequents, ROUND(support, 9) AS support,
      ROUND(confidence, 9) AS confidence, ROUND(lift, 9) AS lift, {_label_sql('strength')}, {_label_sql('strength3')}
      FROM rules ORDER BY ROUND({sort_by}, 9) DESC, ROUND(confidence, 9) DESC, rules.antecedents, rules.consequents LIMIT {n}"""

    @query(name, sql)
    def run(spark, sf_dir):
        out = texted(rl.top_rules(mined(spark, sf_dir, fixture).rules, n, sort_by)).select(
            "antecedents", "consequents", "support", "confidence", "lift", "strength", "strength3"
        )
        return rounded(out, support=9, confidence=9, lift=9)


_top_query("top_rules", NAMES, 20, "lift")
_top_query("top_rules_by_confidence", CATEGORIES, 10, "confidence")
_top_query("top_rules_by_support", CATEGORIES, 50, "support")

_SHORT = lambda t, w: f"CASE WHEN LENGTH({t}) > {w} THEN LEFT({t}, {w}) || '...' ELSE {t} END"


@query(
    "format_rules",
    f"""WITH {rules_sql(*CATEGORIES)} SELECT {_SHORT('atext', 12)} || ' → ' || {_SHORT('ctext', 12)} AS rule,
    printf('%.2f%%', support * 100) AS support, printf('%.1f%%', confidence * 100) AS confidence,
    printf('%.2f', lift) AS lift, {_label_sql('strength3').replace('strength3', 'strength')} FROM rules""",
)
def format_rules(spark, sf_dir):
    return rl.format_rules(mined(spark, sf_dir, CATEGORIES).rules, 12)


@query(
    "rules_flatten",
    f"WITH {rules_sql(*CATEGORIES)} SELECT atext AS antecedents, ctext AS consequents, ROUND(lift, 9) AS lift FROM rules",
)
def rules_flatten(spark, sf_dir):
    return rounded(texted(mined(spark, sf_dir, CATEGORIES).rules).select("antecedents", "consequents", "lift"), lift=9)


@query(
    "rule_quality",
    f"""WITH {rules_sql(*NAMES)} SELECT COUNT(*) AS n_rules, ROUND(AVG(confidence), 9) AS avg_confidence,
    ROUND(AVG(lift), 9) AS avg_lift, COUNT(*) FILTER (lift > {LIFT}) AS high_lift_rules,
    ROUND(COUNT(*) FILTER (lift > {LIFT}) / COUNT(*), 9) AS high_lift_share,
    COUNT(*) FILTER (confidence > 0.06) AS high_confidence_rules,
    ROUND(COUNT(*) FILTER (confidence > 0.06) / COUNT(*), 9) AS high_confidence_share FROM rules""",
)
def rule_quality(spark, sf_dir):
    out = rl.rule_quality(mined(spark, sf_dir, NAMES).rules, LIFT, 0.06)
    return rounded(out, avg_confidence=9, avg_lift=9, high_lift_share=9, high_confidence_share=9)


TEMPORAL_SQL = f"""{rules_sql(*NAMES)},
simple AS (SELECT antecedents[1] AS a, consequents[1] AS c FROM rules WHERE LEN(antecedents) = 1 AND LEN(consequents) = 1),
om AS (SELECT DISTINCT order_id, STRFTIME(order_date, '%Y-%m') AS month FROM clean),
monthly AS (SELECT s.a AS antecedent, s.c AS consequent, om.month, COUNT(*) AS n_orders,
    COUNT(bc.item) / COUNT(*) AS confidence
  FROM simple s JOIN b ba ON ba.item = s.a JOIN om ON om.order_id = ba.order_id
  LEFT JOIN b bc ON bc.order_id = ba.order_id AND bc.item = s.c GROUP BY 1, 2, 3)"""


def _temporal(spark, sf_dir):
    return rl.temporal_confidence(mined(spark, sf_dir, NAMES).rules, tables.clean(spark, sf_dir))


@query(
    "temporal_confidence",
    f"WITH {TEMPORAL_SQL} SELECT antecedent, consequent, month, n_orders, ROUND(confidence, 6) AS confidence FROM monthly",
)
def temporal_confidence(spark, sf_dir):
    return rounded(_temporal(spark, sf_dir), confidence=6)


@query(
    "temporal_preview",
    f"""WITH {TEMPORAL_SQL}, m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY antecedent, consequent ORDER BY month) AS i,
      month || ': ' || CAST(CAST(round(CAST(confidence AS DECIMAL(18,10)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS figure FROM monthly)
    SELECT antecedent, consequent, COUNT(*) AS n_months,
      STRING_AGG(figure, ', ' ORDER BY month) FILTER (i <= 6) AS preview FROM m GROUP BY 1, 2""",
)
def temporal_preview(spark, sf_dir):
    return rl.temporal_preview(_temporal(spark, sf_dir))


@query(
    "monthly_trend",
    f"WITH {CLEAN_SQL} SELECT STRFTIME(order_date, '%Y-%m') AS month, COUNT(DISTINCT order_id) AS orders, ROUND(SUM(sales), 2) AS sales FROM clean GROUP BY 1",
)
def monthly_trend(spark, sf_dir):
    return rounded(rl.monthly_trend(tables.clean(spark, sf_dir)), sales=2)


@query(
    "monthly_trend_summary",
    f"""WITH {CLEAN_SQL}, m AS (SELECT STRFTIME(order_date, '%Y-%m') AS month, COUNT(DISTINCT order_id) AS o, SUM(sales) AS s FROM clean GROUP BY 1)
    SELECT COUNT(*) AS n_months, ROUND(AVG(o), 6) AS avg_orders, ROUND(AVG(s), 2) AS avg_sales FROM m""",
)
def monthly_trend_summary(spark, sf_dir):
    return rounded(rl.monthly_trend_summary(rl.monthly_trend(tables.clean(spark, sf_dir))), avg_orders=6, avg_sales=2)


def _recommend_sql(fixture, n):
    return f"""{rules_sql(*fixture)},
x AS (SELECT UNNEST(antecedents) AS product, * FROM rules),
r1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY {BY_LIFT}) AS rr FROM x),
y AS (SELECT product, rr, confidence, lift, support, UNNEST(consequents) AS item, GENERATE_SUBSCRIPTS(consequents, 1) AS place
  FROM r1 WHERE rr <= {n}),
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product, item ORDER BY rr, place) AS seen FROM y),
rec AS (SELECT product, ROW_NUMBER() OVER (PARTITION BY product ORDER BY rr, place) AS position, item AS recommended_product,
  confidence, lift, support FROM d WHERE seen = 1 QUALIFY position <= {n})"""


def _recommend_query(name, fixture, n):
    @query(
        name,
        f"WITH {_recommend_sql(fixture, n)} SELECT product, position, recommended_product, ROUND(confidence, 9) AS confidence, "
        "ROUND(lift, 9) AS lift, ROUND(support, 9) AS support FROM rec",
    )
    def run(spark, sf_dir):
        return rounded(rl.recommend(mined(spark, sf_dir, fixture).rules, n), confidence=9, lift=9, support=9)


_recommend_query("recommend", NAMES, 5)
_recommend_query("recommend_categories", CATEGORIES, 10)


@query(
    "format_recommendations",
    f"""WITH {_recommend_sql(NAMES, 5)} SELECT product, position, recommended_product,
    printf('%.1f%%', confidence * 100) AS confidence, printf('%.2f', lift) AS lift, printf('%.2f%%', support * 100) AS support FROM rec""",
)
def format_recommendations(spark, sf_dir):
    return rl.format_recommendations(rl.recommend(mined(spark, sf_dir, NAMES).rules, 5))


@query("recommendable_products", f"WITH {rules_sql(*NAMES)} SELECT DISTINCT UNNEST(antecedents) AS product FROM rules")
def recommendable_products(spark, sf_dir):
    return rl.recommendable_products(mined(spark, sf_dir, NAMES).rules)


MAP_SQL = """pl AS (SELECT product_name AS item, category, sub_category, MIN(order_date) AS since FROM clean GROUP BY ALL),
pmap AS (SELECT DISTINCT item, FIRST_VALUE(category) OVER (PARTITION BY item ORDER BY since, category) AS category,
  FIRST_VALUE(sub_category) OVER (PARTITION BY item ORDER BY since, sub_category) AS sub_category FROM pl)"""


@query("product_category_map", f"WITH {CLEAN_SQL}, {MAP_SQL} SELECT item, category, sub_category FROM pmap")
def product_category_map(spark, sf_dir):
    return rl.product_category_map(tables.clean(spark, sf_dir))


CATEGORY_SQL = f"""{rules_sql(*NAMES)}, {MAP_SQL},
ua AS (SELECT atext, ctext, LIST_SORT(LIST_DISTINCT(LIST(category))) AS la
  FROM (SELECT atext, ctext, UNNEST(antecedents) AS item FROM rules) JOIN pmap USING (item) GROUP BY 1, 2),
uc AS (SELECT atext, ctext, LIST_SORT(LIST_DISTINCT(LIST(category))) AS lc
  FROM (SELECT atext, ctext, UNNEST(consequents) AS item FROM rules) JOIN pmap USING (item) GROUP BY 1, 2),
cats AS (SELECT r.*, la, lc, ARRAY_TO_STRING(la, ', ') AS antecedent_categories, ARRAY_TO_STRING(lc, ', ') AS consequent_categories
  FROM rules r JOIN ua USING (atext, ctext) JOIN uc USING (atext, ctext))"""


def _categorised(spark, sf_dir):
    found = mined(spark, sf_dir, NAMES).rules
    return rl.rule_categories(found, rl.product_category_map(tables.clean(spark, sf_dir)))


def _category_rows(df):
    out = texted(df).withColumns(
        {c: F.array_join(c, ", ") for c in ["antecedent_categories", "consequent_categories"]}
    ).select("antecedents", "consequents", "antecedent_categories", "consequent_categories", "lift")
    return rounded(out, lift=9)


_CATEGORY_COLS = "atext AS antecedents, ctext AS consequents, antecedent_categories, consequent_categories, ROUND(lift, 9) AS lift"


@query("rule_categories", f"WITH {CATEGORY_SQL} SELECT {_CATEGORY_COLS} FROM cats")
def rule_categories(spark, sf_dir):
    return _category_rows(_categorised(spark, sf_dir))


@query(
    "cross_category_rules",
    f"WITH {CATEGORY_SQL} SELECT {_CATEGORY_COLS} FROM cats WHERE NOT LIST_HAS_ANY(la, lc)",
)
def cross_category_rules(spark, sf_dir):
    return _category_rows(rl.cross_category_rules(_categorised(spark, sf_dir)))


@query(
    "top_cross_category",
    f"""WITH {CATEGORY_SQL} SELECT {_CATEGORY_COLS} FROM cats WHERE NOT LIST_HAS_ANY(la, lc)
    ORDER BY ROUND(cats.lift, 9) DESC, cats.antecedents, cats.consequents LIMIT 10""",
)
def top_cross_category(spark, sf_dir):
    return _category_rows(rl.top_cross_category(_categorised(spark, sf_dir)))


@query(
    "cross_sell_revenue",
    f"""WITH {rules_sql(*NAMES)}, o AS (SELECT order_id, SUM(sales) AS s FROM clean GROUP BY 1),
    h AS (SELECT COUNT(*) AS n FROM rules WHERE confidence > 0.055 AND lift > {LIFT} AND support > 0.005)
    SELECT ROUND(AVG(s), 4) AS avg_order_value, COUNT(*) AS n_orders, ANY_VALUE(n) AS high_impact_rules,
      ROUND(ANY_VALUE(n) * AVG(s) * 0.1, 4) AS estimated_revenue FROM o, h""",
)
def cross_sell_revenue(spark, sf_dir):
    found = mined(spark, sf_dir, NAMES).rules
    out = rl.cross_sell_revenue(found, tables.clean(spark, sf_dir), 0.055, LIFT, 0.005)
    return rounded(out, avg_order_value=4, estimated_revenue=4)


@query(
    "cross_sell_report",
    f"""WITH {rules_sql(*NAMES)}, o AS (SELECT order_id, SUM(sales) AS s FROM clean GROUP BY 1),
    h AS (SELECT LEAST(COUNT(*), 5) AS n FROM rules WHERE lift > {LIFT})
    SELECT ROUND(AVG(s), 4) AS avg_order_value, COUNT(*) AS n_orders, ANY_VALUE(n) AS listed_rules,
      ROUND(ANY_VALUE(n) * AVG(s) * 0.1, 4) AS estimated_revenue FROM o, h""",
)
def cross_sell_report(spark, sf_dir):
    out = rl.cross_sell_report(mined(spark, sf_dir, NAMES).rules, tables.clean(spark, sf_dir), LIFT)
    return rounded(out, avg_order_value=4, estimated_revenue=4)


def _high_lift_query(name, n):
    @query(
        name,
        f"""WITH {rules_sql(*NAMES)} SELECT atext AS antecedents, ctext AS consequents, ROUND(confidence, 9) AS confidence,
        ROUND(lift, 9) AS lift FROM rules WHERE lift > {LIFT}
        ORDER BY ROUND(rules.confidence, 9) DESC, ROUND(rules.lift, 9) DESC, rules.antecedents, rules.consequents LIMIT {n}""",
    )
    def run(spark, sf_dir):
        out = texted(rl.high_lift_rules(mined(spark, sf_dir, NAMES).rules, n, LIFT))
        return rounded(out.select("antecedents", "consequents", "confidence", "lift"), confidence=9, lift=9)


_high_lift_query("cross_sell_rules", 5)
_high_lift_query("high_value_rules", 10)


@query(
    "mine_with_retry",
    f"""WITH {rules_sql("sub_category", 0.015, 0.1)} SELECT atext AS antecedents, ctext AS consequents, ROUND(support, 9) AS support,
    ROUND(confidence, 9) AS confidence, ROUND(lift, 9) AS lift, TRUE AS retried FROM rules""",
)
def mine_with_retry(spark, sf_dir):
    """Thresholds that give no rule at first and some after the retry, at half of them."""
    found = bk.mine_with_retry(lines(spark, sf_dir, "sub_category"), 0.03, 0.2)
    out = texted(found.rules.select("antecedents", "consequents", "support", "confidence", "lift"))
    return rounded(out.withColumn("retried", F.lit(found.retried)), support=9, confidence=9, lift=9)


@query(
    "rule_points",
    f"WITH {rules_sql(*SUBS)} SELECT ROUND(support, 9) AS support, ROUND(confidence, 9) AS confidence, ROUND(lift, 9) AS lift FROM rules",
)
def rule_points(spark, sf_dir):
    return rounded(rl.rule_points(mined(spark, sf_dir, SUBS).rules), support=9, confidence=9, lift=9)


@query(
    "histogram_rules",
    f"WITH {rules_sql(*NAMES)} " + union_all([histogram_sql("rules", c, 30) for c in ["lift", "confidence", "support"]]),
)
def histogram_rules(spark, sf_dir):
    out = overview.histogram(mined(spark, sf_dir, NAMES).rules, ["lift", "confidence", "support"], 30)
    return rounded(out, bin_start=4, bin_end=4)


@query(
    "top_rules_chart",
    f"""WITH {rules_sql(*CATEGORIES)} SELECT {_SHORT('atext', 20)} || ' → ' || {_SHORT('ctext', 20)} AS label,
    ROUND(lift, 9) AS lift, ROUND(confidence, 9) AS confidence FROM rules
    ORDER BY ROUND(rules.lift, 9) DESC, ROUND(rules.confidence, 9) DESC, rules.antecedents, rules.consequents LIMIT 10""",
)
def top_rules_chart(spark, sf_dir):
    return rounded(rl.top_rules_chart(mined(spark, sf_dir, CATEGORIES).rules), lift=9, confidence=9)
