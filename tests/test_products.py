"""All pairs from blocks of ids: they equal plain joins, and no join makes a row for each pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import dedup


def join_rows(df):
    """The rows of df, and the most rows that one of its joins made."""
    rows, todo, most = sorted(map(tuple, df.collect())), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            todo.append(plan.plan())
        else:
            if "Join" in plan.nodeName():
                most = max(most, plan.metrics().apply("numOutputRows").value())
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, most


def test_joins_make_no_pairs_of_leads(spark):
    lead = "seq long, company_name string, place_id string, website string, phone string"
    leads = [(i, None, "P1", None, None) for i in range(300)] + [(300 + i, "Acme Dental", None, "https://a.test", None) for i in range(200)] + [(500 + i, "Acme Dental Care", f"q{i}", "https://a.test", "4155550101") for i in range(40)]
    want = [(i, j, "place_id") for i in range(300) for j in range(i + 1, 300)] + [(i, j, "domain_name_similarity") for i in range(300, 500) for j in range(i + 1, 540)]
    rows, most = join_rows(dedup.duplicate_pairs(spark.createDataFrame(leads, lead)))
    assert rows == sorted(want) and most < 100


def test_pairs_of_several_blocks(spark, monkeypatch):
    from leadloom.functions import products

    monkeypatch.setattr(products, "BLOCK", 16)
    monkeypatch.setattr(products, "RUN", 4)
    lead = "seq long, company_name string, place_id string, website string, phone string"
    seqs = [7 * i % 101 for i in range(101)] + [5, 5, None]  # some not unique
    leads = [(i, "Acme Dental", "P1" if n % 2 else None, "https://a.test", None) for n, i in enumerate(seqs)]
    df = spark.createDataFrame(leads, lead)
    sides = [(i, p) for i, _, p, _, _ in leads if i is not None]
    want = [(i, j, "place_id" if p and q else "domain_name_similarity") for i, p in sides for j, q in sides if i < j]
    rows, most = join_rows(dedup.duplicate_pairs(df))
    assert rows == sorted(want) and most < len(want) / 50


def test_products_equal_cross_joins(spark):
    from leadloom.functions import products

    sizes = [(0, 1), (1, 1), (products.RUN, 3), (2, products.RUN + 1), (2 * products.RUN + 5, 2 * products.RUN)]
    df = spark.createDataFrame([(n, list(range(i)), list(range(1000, 1000 + j))) for n, (i, j) in enumerate(sizes)], "n int, x array<long>, y array<long>").where(F.size("x") > 0)
    want = [(n, a, b) for n, (i, j) in enumerate(sizes) for a in range(i) for b in range(1000, 1000 + j)]
    assert sorted(map(tuple, products.products(df, "x", "y").select("n", "x", "y").collect())) == sorted(want)


def test_joins_make_no_pairs_of_names(spark):
    from leadloom.functions import listing

    texts = ["Milano Pizza", "Milano's Pizza Shop", "", None, "Blue River", "the restaurant"]
    a = spark.createDataFrame([(i, i % 2, texts[i % 6]) for i in range(240)] + [(240, None, "Blue River")], "a int, k int, x string")
    b = spark.createDataFrame([(i, i % 3, texts[i % 5]) for i in range(90)] + [(90, None, "Blue River")], "b int, k int, y string")
    plain = a.join(b, "k").select("a", "b", listing.is_identity_match(F.col("x"), F.col("y")).alias("same"))
    rows, most = join_rows(listing.identity_pairs(a, b, "k"))
    assert rows == sorted(map(tuple, plain.collect())) and most < 100
