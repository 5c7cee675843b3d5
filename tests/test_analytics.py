import datetime

import pytest
from conftest import ran_plan, rows
from pyspark.sql import functions as F

from millrace.plans import campaign, geo, intent, people, rfm, stories
from millrace.plans.runner import build
from millrace.plans.spec import job_of
from millrace.sources import versioned

TODAY = datetime.date(2024, 6, 30)


@pytest.fixture
def orders(spark):
    ago = [("1", "A", 5, 120.0), ("2", "A", 10, 80.0), ("3", "B", 90, 200.0), ("4", "C", 200, 50.0), ("5", "D", 365, 500.0)]
    return spark.createDataFrame(
        [(o, c, TODAY - datetime.timedelta(d), a) for o, c, d, a in ago],
        "order_id string, customer_id string, order_date date, total_amount double",
    )


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(
        [("A", "US", "North"), ("B", "UK", "South"), ("C", "US", "West"), ("D", "CA", "East")],
        "customer_id string, country string, region string",
    )


@pytest.fixture
def campaigns(spark):
    return spark.createDataFrame(
        [
            ("1", "one", "Phone X Pro", 100000, 5000, 250, 250000.0, 10000.0),
            ("2", "two", "Phone X", 50000, 2000, 80, 64000.0, 5000.0),
            ("3", "three", "Tablet", 30000, 800, 10, 5000.0, 3000.0),
            ("4", "four", "Phone X Mini", 0, 0, None, None, 0.0),
        ],
        "campaign_id string, campaign_name string, product_family string, impressions long,"
        " clicks long, conversions long, revenue double, spend double",
    )


def test_rfm_exact_values(orders):
    got = {r.customer_id: tuple(r)[1:] for r in rfm.rfm_scores(orders, str(TODAY)).collect()}
    assert got == {
        "A": (5, 2, 200.0, 5, 4, 2, 11, "Loyal Customers"),
        "B": (90, 1, 200.0, 4, 1, 2, 7, "Potential Loyalists"),
        "C": (200, 1, 50.0, 3, 1, 1, 5, "At Risk"),
        "D": (365, 1, 500.0, 2, 1, 4, 7, "Potential Loyalists"),
    }


def test_rfm_ignores_missing_amounts_in_the_thresholds(spark):
    df = spark.createDataFrame(
        [(str(i), str(i), TODAY, float(i) if i else None) for i in range(6)],
        "order_id string, customer_id string, order_date date, order_amount double",
    )
    got = {r.customer_id: r.m_score for r in rfm.rfm_scores(df, str(TODAY)).collect()}
    assert got == {"0": 5, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5}


def test_rfm_of_decimals_is_one_lazy_plan(spark, orders, folder):
    exact = orders.withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    exact.write.parquet(f"{folder}/o")
    scored = rfm.rfm_scores(spark.read.parquet(f"{folder}/o"), str(TODAY))
    text = ran_plan(scored)
    assert "millrace" not in text and "ReusedExchange" in text
    assert rows(scored.select("customer_id", "rfm_score")) == rows(
        rfm.rfm_scores(orders, str(TODAY)).select("customer_id", "rfm_score")
    )


def test_rfm_of_nothing_is_empty(orders):
    assert rfm.rfm_scores(orders.limit(0), str(TODAY)).count() == 0


def test_rfm_by_rank(orders):
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in rfm.rfm_scores_by_rank(orders, str(TODAY)).collect()}
    assert got == {"A": (5, 4, 2), "B": (4, 1, 3), "C": (3, 2, 1), "D": (2, 3, 4)}


def test_geo_exact_values(orders, customers):
    got = geo.geo_revenue(orders, customers).collect()
    assert [(r.country, r.region, r.total_revenue) for r in got] == [
        ("CA", "East", 500.0),
        ("UK", "South", 200.0),
        ("US", "North", 200.0),
        ("US", "West", 50.0),
    ]
    north = got[2]
    assert (north.unique_customers, north.order_count, north.avg_order_value) == (1, 2, 100.0)
    assert north.revenue_per_customer == 200.0 and not any(r.is_high_value for r in got)
    assert geo.geo_revenue(orders, customers, 200.0).filter("is_high_value").count() == 1


def test_geo_unknown_and_repeated_customers(spark, orders, customers):
    loose = orders.union(
        spark.createDataFrame([("6", None, TODAY, 7.0), ("7", "Z", TODAY, None)], orders.schema)
    )
    twice = customers.union(customers.filter("customer_id = 'A'"))
    for limit in (10, 0):
        got = {
            (r.country, r.region): (r.total_revenue, r.unique_customers, r.order_count, r.avg_order_value)
            for r in geo.geo_revenue(loose, twice, broadcast_mb=limit).collect()
        }
        # as joining first and grouping afterwards gives it
        joined = loose.join(twice, "customer_id", "left").groupBy("country", "region")
        plain = joined.agg(
            F.sum("total_amount"), F.count_distinct("customer_id"), F.count("order_id"), F.avg("total_amount")
        )
        assert got == {(r[0], r[1]): tuple(r)[2:] for r in plain.collect()}
        assert got[(None, None)] == (7.0, 1, 2, 7.0)


def test_geo_with_region_on_both_sides(orders, customers):
    both = orders.withColumn("region", F.lit("old"))
    assert geo.geo_revenue(both, customers).filter("region = 'old'").count() == 0


def test_country_rollup(orders, customers):
    got = geo.top_countries(geo.geo_revenue(orders, customers), 2).collect()
    assert [tuple(r) for r in got] == [("CA", 500.0, 1), ("US", 250.0, 2)]


def test_campaign_exact_values(campaigns):
    got = {r.campaign_id: r for r in campaign.campaign_kpis(campaigns, "Phone X").collect()}
    assert sorted(got) == ["1", "2", "4"]
    first, second, none = got["1"], got["2"], got["4"]
    assert (first.conversion_rate, first.revenue_per_impression, first.roi_pct, first.campaign_grade) == (
        0.0025,
        2.5,
        2400.0,
        "A",
    )
    assert (second.conversion_rate, second.roi_pct, second.campaign_grade) == (0.0016, 1180.0, "B")
    assert (none.conversion_rate, none.roi_pct, none.campaign_grade, none.revenue) == (0.0, 0.0, "C", 0.0)


def test_campaign_with_orders(spark, campaigns):
    bought = spark.createDataFrame(
        [("o1", "1", "Phone X", 100.0), ("o2", "1", "Phone X", 50.0), ("o3", "1", "Tablet", 9.0)],
        "order_id string, campaign_id string, product_family string, order_amount double",
    )
    plain = campaigns.drop("revenue", "conversions").withColumnRenamed("spend", "campaign_cost")
    got = {r.campaign_id: r for r in campaign.campaign_kpis(plain, "Phone X", bought).collect()}
    assert (got["1"].order_count, got["1"].total_revenue, got["1"].conversion_rate) == (2, 150.0, 2e-05)
    assert (got["2"].order_count, got["2"].total_revenue, got["2"].campaign_grade) == (0, 0.0, "D")


def test_campaign_reports(campaigns):
    kpis = campaign.campaign_kpis(campaigns, "Phone X")
    assert [tuple(r) for r in campaign.grade_breakdown(kpis).collect()] == [("A", 1), ("B", 1), ("C", 1)]
    assert tuple(campaign.campaign_summary(kpis).first()) == (0.0014, 1193.33, 1.26)


def test_intent_exact_values(orders):
    got = {r.customer_id: (round(r.intent_score, 6), r.intent_segment) for r in intent.intent_scores(orders, "x").collect()}
    assert got == {
        "A": (7.693061, "Low Intent"),
        "B": (5.865736, "Low Intent"),
        "C": (5.565736, "Low Intent"),
        "D": (6.465736, "Low Intent"),
    }


def test_intent_with_category_and_limits(spark):
    df = spark.createDataFrame(
        [(str(i), "a", "target thing", 10.0) for i in range(30)]
        + [("x", "b", "target", None), ("y", "c", "other", 2000.0), ("z", "c", None, 0.0)],
        "order_id string, customer_id string, category string, total_amount double",
    )
    got = {r.customer_id: r for r in intent.intent_scores(df, "target").collect()}
    assert (got["a"].intent_score, got["a"].intent_segment) == (100.0, "High Intent")
    assert (got["b"].avg_spend, got["b"].intent_score) == (None, 0.0)
    assert (got["c"].target_purchases, got["c"].category_diversity, got["c"].total_orders) == (0, 1, 2)


def test_combined_reports(orders):
    scored = rfm.rfm_scores(orders, str(TODAY))
    both = intent.with_intent(scored, intent.intent_scores(orders, "x"))
    assert intent.segment_cross_table(both).count() == 3
    assert intent.high_value_targets(both).count() == 0
    assert [tuple(r) for r in rfm.segment_distribution(scored).collect()][0] == ("Potential Loyalists", 2, 350.0, 1.0)


def test_paths_and_frames_give_the_same(spark, orders, customers, campaigns, folder):
    orders.write.parquet(f"{folder}/o")
    customers.write.parquet(f"{folder}/c")
    campaigns.write.parquet(f"{folder}/k")
    rfm.run_rfm(spark, f"{folder}/o", f"{folder}/rfm", str(TODAY))
    assert rows(versioned.read(spark, f"{folder}/rfm")) == rows(rfm.run_rfm(spark, orders, None, str(TODAY)))
    by_path = geo.run_geo(spark, f"{folder}/o", f"{folder}/c", f"{folder}/geo")
    assert rows(by_path) == rows(geo.geo_revenue(orders, customers)) == rows(versioned.read(spark, f"{folder}/geo"))
    assert rows(intent.run_intent(spark, f"{folder}/o", "x")) == rows(intent.intent_scores(orders, "x"))
    assert rows(campaign.run_campaign(spark, f"{folder}/k", "Phone")) == rows(campaign.campaign_kpis(campaigns, "Phone"))


def _view(spark, name, values, schema):
    spark.createDataFrame(values, schema).createOrReplaceTempView(name)
    return {"table": name}


def test_payments_by_category_equals_joining_as_written(spark):
    ts = datetime.datetime(2024, 3, 1)
    orders = _view(spark, "s_orders", [(1, "delivered", ts), (2, "delivered", ts), (3, "canceled", ts)], "order_id int, order_status string, order_purchase_timestamp timestamp")
    payments = _view(spark, "s_payments", [(1, 10.0), (1, 5.0), (2, 7.0), (3, 9.0)], "order_id int, payment_value double")
    items = _view(spark, "s_items", [(1, 100), (1, 100), (1, 101), (2, 999), (3, 100)], "order_id int, product_id int")
    products = _view(spark, "s_products", [(100, "toys"), (101, "art")], "product_id int, product_category_name string")
    got = build(spark, job_of(stories.monthly_payments_by_category(orders, payments, items, products)))
    as_written = spark.sql(
        """SELECT year(order_purchase_timestamp), month(order_purchase_timestamp),
        product_category_name, sum(payment_value) FROM s_orders JOIN s_payments USING (order_id)
        JOIN s_items USING (order_id) LEFT JOIN s_products USING (product_id)
        WHERE order_status = 'delivered' GROUP BY 1, 2, 3"""
    )
    assert rows(got) == rows(as_written) == [(2024, 3, "art", 15.0), (2024, 3, "toys", 30.0), (2024, 3, None, 7.0)]


def test_order_frequency_segments(spark):
    orders = _view(spark, "s_orders", [(i, c, "delivered") for i, c in enumerate("aabbbcd")] + [(9, "c", "canceled")], "order_id int, customer_id string, order_status string")
    people_ = _view(spark, "s_people", [("a", "P"), ("b", "P"), ("c", "Q"), ("d", None)], "customer_id string, customer_unique_id string")
    got = build(spark, job_of(stories.order_frequency(orders, people_)))
    assert rows(got) == [("P", 5, "loyal"), ("Q", 1, "one_time"), (None, 1, "one_time")]


def test_category_revenue_counts_a_line_once(spark):
    lines = _view(
        spark,
        "s_lines",
        [(1, 7, None, 10.0, 2024, 1), (1, 7, 2.0, 10.0, 2024, 1), (1, 8, 1.0, 4.0, 2024, 1), (2, 7, 1.0, 3.0, 2024, 2)],
        "order_id int, product_id int, unit_price double, line_total double, year int, month int",
    )
    products = _view(spark, "s_products", [(7, "toys")], "product_id int, category string")
    got = build(spark, job_of(stories.monthly_category_revenue(lines, products)))
    assert rows(got) == [(2024, 1, "toys", 10.0, 1), (2024, 1, None, 4.0, 1), (2024, 2, "toys", 3.0, 1)]


def test_person_rfm_counts_orders_once(spark):
    ts = datetime.datetime(2024, 6, 20)
    customers = spark.createDataFrame([("c1", "P"), ("c2", "P"), ("c3", "Q")], "customer_id string, customer_unique_id string")
    orders = spark.createDataFrame([(1, "c1", ts), (2, "c2", ts), (3, "c3", ts), (4, "c3", ts)], "order_id int, customer_id string, order_purchase_timestamp timestamp")
    payments = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 4.0), (3, 8.0)], "order_id int, payment_value double")
    got = {r.customer_unique_id: (r.recency_days, r.frequency, r.monetary) for r in people.person_metrics(customers, orders, payments, str(TODAY)).collect()}
    assert got == {"P": (10, 2, 7.0), "Q": (10, 1, 8.0)}


def test_seller_and_english_stories(spark):
    ts = datetime.datetime(2024, 3, 1)
    orders = _view(spark, "s_orders", [(1, "delivered", ts), (2, "canceled", ts)], "order_id int, order_status string, order_purchase_timestamp timestamp")
    items = _view(spark, "s_items", [(1, 7, "s", 10.0, 1.0), (1, 8, "t", 20.0, 2.0), (2, 7, "s", 99.0, 9.0)], "order_id int, product_id int, seller_id string, price double, freight_value double")
    products = _view(spark, "s_products", [(7, "brinquedos")], "product_id int, product_category_name string")
    words = _view(spark, "s_words", [("brinquedos", "toys")], "product_category_name string, product_category_name_english string")
    sellers = build(spark, job_of(stories.seller_revenue(items, orders)))
    assert [tuple(r) for r in sellers.collect()] == [("t", 22.0), ("s", 11.0)]
    english = build(spark, job_of(stories.monthly_revenue_english(items, orders, products, words)))
    assert rows(english) == [(2024, 3, "toys", 10.0), (2024, 3, None, 20.0)]


def test_order_enrichment(spark):
    source = _view(spark, "s_o", [(1, TODAY - datetime.timedelta(30), 9.0, 2), (2, TODAY - datetime.timedelta(31), 9.0, 0)], "order_id int, order_date date, total double, qty int")
    got = build(spark, job_of(stories.order_enrichment(source, reference_date=str(TODAY))))
    assert [tuple(r)[4:] for r in got.orderBy("order_id").collect()] == [(30, True, 4.5), (31, False, None)]


def test_rfm_story_fills_missing_spend(spark):
    source = _view(spark, "s_o", [("1", "a", TODAY, None), ("2", "b", TODAY, 5.0)], "order_id string, customer_id string, order_date date, order_amount double")
    got = build(spark, job_of(stories.rfm_story(source, reference_date=str(TODAY))))
    assert {r.customer_id: r.monetary for r in got.collect()} == {"a": 0.0, "b": 5.0}
