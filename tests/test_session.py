"""Intermediate tables: written, found again, released."""

from pathlib import Path

from credsift.session import folders_made, materialise, release, table_folder


def place(folder):
    return Path(folder.removeprefix("file:"))


def test_tables_are_released(spark):
    before = folders_made(spark)
    first, second = materialise(spark.range(3)), materialise(spark.range(4))
    made = [f for f in folders_made(spark) if f not in before]
    assert len(made) == 2 and all(place(f).is_dir() for f in made)
    assert (first.count(), second.count()) == (3, 4)
    release(spark, [made[0], "/not/made/here"])
    assert not place(made[0]).exists() and second.count() == 4 and made[0] not in folders_made(spark)


def test_tables_of_the_catalogue(spark):
    folder = table_folder(spark, "named", "named_for_a_test")
    spark.range(2).write.option("path", folder).saveAsTable("named_for_a_test")
    release(spark, [folder])
    assert not spark.catalog.tableExists("named_for_a_test") and not place(folder).exists()
