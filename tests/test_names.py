"""Golden cases for the name cascade (N1-N7, P15) and character clean-up."""
from pyspark.sql import functions as F

from reviewlake.functions.columns import clean_characters
from reviewlake.operators.names import preprocess_names


def test_name_cascade(spark):
    names = ["John 'Jack' Smith", "Ana de Armas", "Sammy Davis Jr.", "Mary Ann Evans", "Tom Lee",
             "Bo Xi", "Henry Ford III", "Prince", "Max van Dyke", "Al 2Pac"]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, primaryName string")
    out = {r.primaryName: r for r in preprocess_names(df).collect()}
    assert (out["John 'Jack' Smith"].firstName, out["John 'Jack' Smith"].aliasName,
            out["John 'Jack' Smith"].lastName, out["John 'Jack' Smith"].noAliasName) == ("John", "Jack", "Smith",
                                                                                         "John Smith")
    assert (out["Ana de Armas"].firstName, out["Ana de Armas"].lastName) == ("Ana", "de Armas")
    assert out["Sammy Davis Jr."].lastName == "Davis Jr."
    assert (out["Mary Ann Evans"].middleName, out["Mary Ann Evans"].lastName) == ("Ann", "Evans")
    assert out["Tom Lee"].lastName == "Lee"
    assert out["Bo Xi"].processed == 0 and out["Bo Xi"].lastName is None          # rejected: last name < 3
    assert out["Henry Ford III"].processed == 0                                  # ends 'iii', no later rule fits
    assert out["Prince"].processed == 0
    assert out["Max van Dyke"].lastName == "van Dyke"                            # starts lower-case v: kept
    assert out["Al 2Pac"].lastName is None and out["Al 2Pac"].processed == 1     # digits -> null


def test_characters(spark):
    rows = [('["Batman"]', "actor", "Batman"), ('["Self"]', "self", None), ('["Joe (voice)"]', "actor", "Joe"),
            ('["Bob - The Builder"]', "actor", "Bob"), ('["Dr. X, the one"]', "actor", "Dr. X"),
            ('["Segment \'A\'"]', "actor", None), ('["Mary_Jane"]', "actress", "Mary Jane")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "characters string, category string")
    got = [r.c for r in df.select(clean_characters("characters", "category").alias("c")).collect()]
    assert got == [c for _, _, c in rows]
