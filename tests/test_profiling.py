import pytest

from helpers import as_rows, plan_of
from dockside.operators import cleaning, profiling


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [
            (1, "a@x", None, 5, "COMPLETE"),
            (1, "a@x", None, 5, "COMPLETE"),
            (2, "b@x", None, None, "PENDING"),
            (None, None, None, None, None),
            (None, None, None, None, None),
        ],
        "order_id int, customer_email string, product_description string,"
        " customer_zipcode int, order_status string",
    )


def test_null_profile_is_one_pass(people):
    profile = profiling.null_profile(people)
    assert dict(as_rows(profile)) == {
        "order_id": 2,
        "customer_email": 2,
        "product_description": 5,
        "customer_zipcode": 3,
        "order_status": 2,
    }
    assert plan_of(profile).count("Scan") == 1


def test_duplicates_count_null_rows_as_equal(people):
    assert as_rows(profiling.duplicate_profile(people)) == [(5, 3, 2)]


def test_duplicates_without_copies_and_empty(people):
    once = people.dropDuplicates()
    assert as_rows(profiling.duplicate_profile(once)) == [(3, 3, 0)]
    assert as_rows(profiling.duplicate_profile(people.limit(0))) == [(0, 0, 0)]


def test_duplicates_with_one_hot_row(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) AS a", "string(id % 1) AS b")
    total, distinct, extra = as_rows(profiling.duplicate_profile(df))[0]
    assert (total, distinct, extra) == (3000, df.distinct().count(), 3000 - df.distinct().count())


def test_private_values_are_masked(people):
    sample = profiling.pii_sample(people, ("customer_email", "product_description"))
    assert dict(as_rows(sample)) == {"customer_email": "a***", "product_description": "empty"}


def test_counts_and_samples(people):
    assert as_rows(profiling.table_shape(people)) == [(5, 5)]
    counts = profiling.non_null_counts(people, ("product_description", "order_id"))
    assert dict(as_rows(counts)) == {"product_description": 0, "order_id": 3}
    samples = {row[0]: row[1:] for row in as_rows(profiling.column_samples(people))}
    assert samples["order_id"] == ("int", "1")
    assert samples["product_description"] == ("string", "N/A")
    listing = profiling.describe_schema(people).orderBy("position")
    assert as_rows(listing)[0] == (0, "order_id", "int", 3)


def test_value_counts(people):
    counts = profiling.value_counts(people, "order_status", order=True)
    assert as_rows(counts) == [("COMPLETE", 2), (None, 2), ("PENDING", 1)]
    assert as_rows(profiling.top_values(people, "order_status", 1)) == [("COMPLETE", 2)]
    both = profiling.category_frequencies(people, ("order_status", "customer_email"))
    assert ("order_status", "COMPLETE", 2) in as_rows(both)
    assert all(value is not None for _, value, _ in as_rows(both))
    assert sorted(as_rows(profiling.distinct_values(people, "order_status"))) == [
        ("COMPLETE",),
        ("PENDING",),
    ]


def test_cleaning(people):
    cleaned = cleaning.clean_orders(people)
    assert cleaned.columns == ["order_id", "customer_zipcode", "order_status"]
    assert cleaned.where("customer_zipcode IS NULL").count() == 0
    assert as_rows(cleaning.clean_report(people, cleaned)) == [(5, 5, 5, 3, 2, True)]
    assert dict(as_rows(cleaning.remaining_nulls(cleaned))) == {"order_id": 2, "order_status": 2}
    # Cleaning again finds nothing to drop.
    assert cleaning.clean_orders(cleaned).columns == cleaned.columns


def test_schema_without_a_job(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert profiling.schema_fields(df) == [(0, "a", "bigint"), (1, "b", "string")]
