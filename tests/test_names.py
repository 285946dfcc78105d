import random

from pyspark.sql import functions as F

from cantata.operators.names import numbered, numbered_conflicts


def plain_number(name, n):
    dot = name.rfind(".")
    return name if n == 1 else f"{name} ({n})" if dot <= 0 else f"{name[:dot]} ({n}){name[dot:]}"


def one_after_another(rows, occupied):
    taken, out = {p.lower() for p in occupied}, []
    for at, folder, name in sorted(rows):
        n = 1
        while (path := (f"{folder}/" if folder else "") + plain_number(name, n)).lower() in taken:
            n += 1
        taken.add(path.lower())
        out.append((at, plain_number(name, n)))
    return out


def resolved(spark, rows, occupied):
    df = spark.createDataFrame(rows, "at int, folder string, name_ string")
    there = spark.createDataFrame([(p,) for p in occupied], "path string")
    return sorted(map(tuple, numbered_conflicts(df, "folder", "name_", "at", there).select("at", "name").collect()))


def test_numbers_stand_before_the_ending(spark):
    names = ["A.flac", ".flac", "A", "a.b.c", "A.", "x\n.y"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", numbered(F.col("n"), F.lit(2)).alias("m"))
    assert {r["n"]: r["m"] for r in df.collect()} == {n: plain_number(n, 2) for n in names}


def test_names_that_are_there_or_claimed_are_passed_over(spark):
    rows = [(1, "", "A.flac"), (2, "", "A.flac"), (3, "", "A.flac (2)"), (4, "", "A (2).flac"), (5, "x", "a.flac"), (6, None, "a.FLAC")]
    assert resolved(spark, rows, []) == [(1, "A.flac"), (2, "A (2).flac"), (3, "A.flac (2)"), (4, "A (2) (2).flac"), (5, "a.flac"), (6, "a (3).FLAC")]
    assert resolved(spark, rows[:2], ["a.flac", "A (2).FLAC", "A (4).flac"]) == [(1, "A (3).flac"), (2, "A (5).flac")]
    assert resolved(spark, [], ["a"]) == []


def test_claims_that_push_on_each_other(spark):
    rng = random.Random(3)
    names = ["A.flac", "A (2).flac", "A (3).flac", "A (2) (2).flac", "a.FLAC", "B", "B (2)", ".x", "A (02).flac"]
    for trial in range(3):
        rows = [(i, rng.choice(["", "d"]), rng.choice(names)) for i in rng.sample(range(1000), 60)]
        occupied = rng.sample(["A.flac", "d/a (2).flac", "A (2) (3).flac", "B (3)", "d/B", "A (5).flac", "A (6).flac"], trial * 3)
        assert resolved(spark, rows, occupied) == one_after_another(rows, occupied)
