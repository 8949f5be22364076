import pytest

from helpers import as_rows, order_line
from dockside.operators import knowledge
from dockside.sources.tables import load_knowledge, write_knowledge


@pytest.fixture
def varied(lines):
    rows = [
        order_line(
            i,
            market=("Europe", "Pacific Asia", None)[i % 3],
            category_name=f"kind {i % 30:02d}/x",
            shipping_mode=("Same Day", None)[i % 2],
            customer_segment=("Consumer", "Home Office")[i % 2],
            sales=1000.5 * i,
        )
        for i in range(95)
    ]
    return lines(*rows)


def test_corpus_is_the_four_kinds(varied):
    corpus = knowledge.knowledge_corpus(varied)
    parts = [
        knowledge.market_docs(varied),
        knowledge.category_docs(varied),
        knowledge.shipping_docs(varied),
        knowledge.segment_docs(varied),
    ]
    apart = [row for part in parts for row in as_rows(part)]
    assert sorted(as_rows(corpus), key=str) == sorted(apart, key=str)
    assert dict(as_rows(knowledge.corpus_by_source(corpus))) == {
        "category_profile": 25,
        "market_report": 2,
        "segment_profile": 2,
        "shipping_analysis": 1,
    }


def test_ids_and_texts(varied):
    docs = {row.id: row for row in knowledge.knowledge_corpus(varied).collect()}
    assert "market_Pacific_Asia" in docs and "cat_kind_00_x" in docs and "ship_Same_Day" in docs
    text = docs["market_Europe"].text
    assert "Europe" in text and "32 order lines" in text and "None" not in text
    assert docs["market_Europe"].market == "Europe" and docs["cat_kind_00_x"].market is None


def test_missing_numbers_do_not_drop_the_text(lines):
    df = lines(order_line(1, order_profit_per_order=None, sales=None))
    assert "n/a" in knowledge.segment_docs(df).first().text


def test_samples(spark):
    docs = spark.createDataFrame(
        [("b", "x" * 300, "s", None), ("a", "y" * 300, "s", None), ("c", "z", None, None)],
        "id string, text string, source string, market string",
    )
    assert sorted(as_rows(knowledge.corpus_samples(docs))) == [
        ("s", "a", "y" * 200 + "..."),
        ("unknown", "c", "z..."),
    ]


def test_store_replaces_and_refuses_repeated_ids(spark, tmp_path):
    schema = "id string, text string, source string, market string, embedding array<float>"
    rows = [("a", "t", "s", None, [1.0]), ("b", "t", "s", "m", [0.5])]
    path = str(tmp_path / "knowledge")
    write_knowledge(spark.createDataFrame(rows, schema), path)
    write_knowledge(spark.createDataFrame(rows[:1], schema), path)
    assert load_knowledge(spark, path).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        write_knowledge(spark.createDataFrame(rows + rows, schema), path)
    with pytest.raises(FileNotFoundError):
        load_knowledge(spark, str(tmp_path / "none"))
