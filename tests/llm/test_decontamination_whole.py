"""Re-parameterised, short and partly held benchmark items."""

from chatlens.llm.decontaminate import leaks


def found(spark, pairs):
    """``{k: row}`` of the pairs (item, document) whose document is found to hold its own item."""
    items = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "item_id long, text string")
    docs = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pairs)], "doc_id long, text string")
    return {r["doc_id"]: r for r in leaks(docs, items).collect() if r["doc_id"] == r["item_id"]}


FARM = "A farmer keeps 3 cows and 4 goats in the old barn behind the house and wants to know how many legs there are in the barn"
SHOP = "In a small shop we see that 2 pens and 2 books lie on the table near the door and ask how many things there are"


def test_values_that_become_equal_and_one_changed_use_of_a_value(spark):
    names = "The team of Ann and the team of Bob met, and then the team of Ann lost to the team of Bob by 3 goals in the last minutes"
    got = found(spark, [(FARM, FARM.replace("3 cows", "5 cows").replace("4 goats", "5 goats")), (SHOP, SHOP.replace("2 books", "3 books")),
                        (SHOP, SHOP.replace("2 pens", "7 pens").replace("2 books", "3 books")), (names, names.replace("Ann and", "Cy and").replace("Ann lost", "Di lost")),
                        (FARM, FARM)])
    assert set(got) == {0, 1, 2, 4}
    assert got[0]["coverage"] == 1.0 and got[1]["coverage"] == 1.0 and 0.5 <= got[2]["coverage"] < 1
    assert [got[k]["exact"] for k in (0, 1, 2, 4)] == [False, False, False, True]


def test_changed_names_that_open_a_sentence(spark):
    toms = "Tom has 3 apples. Tom buys 4 more apples. Tom eats 2 apples. How many apples does Tom have?"
    got = found(spark, [(toms, toms.replace("Tom", "Anna")), ("Tom has 3 apples and 4 pears.", "Anna has 3 apples and 4 pears."),
                        ("Tom Smith has 3 red apples and 4 pears in his bag.", "We know that Anna has 5 red apples and 6 pears in his bag."),
                        (toms, "Now " + toms.lower()), ("What is the capital of France?", "Berlin is the capital of Germany.")])
    assert set(got) == {0, 1, 2, 3}
    assert got[0]["coverage"] == 1.0 and got[1]["coverage"] == 1.0 and got[2]["coverage"] == 1.0
    assert not got[0]["exact"] and not got[1]["exact"]


def test_short_items_items_of_values_and_a_part_of_a_long_item(spark):
    long = " ".join(f"term{i}" for i in range(100))
    values = "Ann 3 Bob 7 Cy 12 Di 31 Ed 5 Flo 8"
    got = found(spark, [("What is 12 + 34 * 56?", "He asks: what is 12 + 34 * 56? Well"), ("Compute 12 * 7.", "Compute 12 * 7. Then"), ("Compute 13 * 7.", "Compute 13 * 8."),
                        (values, "So " + values + " all"), (values, values[:-2]), (long, "see " + " ".join(long.split()[40:60]) + " there"),
                        (long, "see " + " ".join(long.split()[40:50]) + " there")])
    assert set(got) == {0, 1, 3, 5}
    assert got[0]["coverage"] == got[3]["coverage"] == 1.0 and got[0]["exact"] and got[3]["exact"] and got[5]["coverage"] < 0.2
    assert found(spark, [("Tom has 3 apples and 4 pears.", "Then Paul Tom has 3 apples and 4 pears.")])[0]["exact"]
