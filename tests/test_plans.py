"""Plan regression tests: the scale properties the design relies on."""

from conftest import SF_SMALL


def plan(df) -> str:
    qe = df._jdf.queryExecution()
    return (qe.optimizedPlan().toString() + "\n" + qe.executedPlan().toString())


def q(name):
    from __spark_entry__ import queries

    return queries()[name]


def test_flagship_status_filter_reaches_the_scan(spark):
    text = plan(q("list_orders_received")(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in text


def test_no_unbounded_collect_in_cards_and_dedupe(spark):
    for name in ("product_cards", "card_variants", "dedupe_changed", "resolve_variant"):
        text = plan(q(name)(spark, SF_SMALL)).lower()
        assert "collect_list" not in text and "collect_set" not in text, name


def test_rankings_use_no_row_number_window(spark):
    for name in ("rank_duplicates", "card_variants", "list_products_gender", "dedupe_changed"):
        text = plan(q(name)(spark, SF_SMALL)).lower()
        assert "row_number" not in text, name


def test_outbox_is_one_pass(spark):
    text = plan(q("notification_outbox")(spark, SF_SMALL))
    assert "Union" not in text and "Generate" in text


def test_reservation_python_is_arrow_batched(spark):
    text = plan(q("reserve_stock")(spark, SF_SMALL))
    assert "MapInArrow" in text
    assert "BatchEvalPython" not in text      # no row-at-a-time Python UDF


def test_anti_join_right_side_is_deduplicated_first(spark):
    from loomcart.operators import mutations as mu

    p = spark.range(0, 100).select("id")
    o = spark.range(0, 1000).selectExpr("id", "id % 7 AS product_id")
    text = mu.unreferenced_products(p, o)._jdf.queryExecution().optimizedPlan().toString()
    anti = text[text.index("LeftAnti"):]
    assert "Aggregate [id" in anti           # DISTINCT product ids before the anti join
