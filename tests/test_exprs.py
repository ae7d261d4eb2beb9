import datetime as dt

from pyspark.sql import functions as F

from courtside.functions import exprs as X


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


def test_ordinals(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 101, 111, 112, None)], "n int")
    got = dict((r["n"], r["o"]) for r in df.select("n", X.ordinal("n").alias("o")).collect())
    assert got == {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th",
                   21: "21st", 22: "22nd", 101: "101st", 111: "111th", 112: "112th", None: None}


def test_safe_ratio_and_true_shooting(spark):
    df = spark.createDataFrame([(10, 0, 0), (20, 10, 5)], "pts long, fga long, fta long")
    got = [r["ts"] for r in df.select(X.true_shooting("pts", "fga", "fta").alias("ts")).collect()]
    assert got[0] is None
    assert abs(got[1] - 20 / (2 * (10 + 0.44 * 5))) < 1e-12


def test_text_parsing(spark):
    assert one(spark, X.clock_minutes("c"), "11:38", "c string") == 11.633
    assert one(spark, X.clock_minutes("c"), "bad", "c string") is None
    assert one(spark, X.date_from_weekday_text("c"), "Tue, Dec 22, 2020", "c string") == dt.date(2020, 12, 22)
    assert one(spark, X.date_from_weekday_text("c"), "junk", "c string") is None
    assert one(spark, X.start_minute("c"), "7:30p", "c string") == 19 * 60 + 30
    assert one(spark, X.start_minute("c"), "12:00p", "c string") == 12 * 60
    assert one(spark, X.start_minute("c"), "11:05 AM", "c string") == 11 * 60 + 5
    assert one(spark, X.money_to_double("c"), "$1,234", "c string") == 1234.0
    assert one(spark, X.money_to_double("c"), "", "c string") is None
    assert one(spark, X.money_to_double("c"), "-", "c string") is None


def test_ascii_fold_and_first_replace(spark):
    assert one(spark, X.ascii_fold("c"), "Dončić Jokić Schröder", "c string") == "Doncic Jokic Schroder"
    folded = {"Weiß ẞ": "Weiss SS", "Ægir Œuvre Cœur": "AEgir OEuvre Coeur", "Þórður": "THordur", "Łukasz Đỗ Nguyễn Thế": "Lukasz Do Nguyen The",
              "Ĳssel ŉ ǆ ﬁ ŀ": "IJssel 'n dz fi l", "e\u0301 o\u0308": "e o", "İı Ħ ŧ": "Ii H t", "日本 αβ 😀 ½": "日本 αβ 😀 ½", "": ""}
    for text, ascii_text in folded.items():
        assert one(spark, X.ascii_fold("c"), text, "c string") == ascii_text
    # no letter of the Latin blocks with a base letter is left
    letters = "".join(chr(i) for a, b in X.LATIN_BLOCKS for i in range(a, b + 1) if chr(i) in X.FOLDS)
    assert len(X.FOLDS) > 600 and one(spark, X.ascii_fold("c"), letters, "c string").isascii()


def test_number_texts(spark):
    assert [one(spark, X.thousands_text("c"), v, "c double") for v in (0.0, 999.0, 1000.0, 1234567.0, -45000.0, None)] == [
        "0", "999", "1,000", "1,234,567", "-45,000", None]
    assert one(spark, X.money_text("c"), 12500000.0, "c double") == "$12,500,000" and one(spark, X.money_text("c"), None, "c double") is None


def test_first_replace_and_last_word(spark):
    # first match only, and the dot is a wildcard as in a regex
    assert one(spark, X.replace_first("c", "Jr.", ""), "Jr. Jr.", "c string") == " Jr."
    assert one(spark, X.replace_first("c", "Jr.", ""), "AJrX", "c string") == "A"
    assert one(spark, X.last_word("c"), "Los Angeles Lakers", "c string") == "Lakers"


def test_recode_and_lookup(spark):
    df = spark.createDataFrame([("BRK",), ("PHO",), ("LAL",), (None,)], "t string")
    got = [r[0] for r in df.select(X.recode("t", {"BRK": "BKN", "PHO": "PHX"})).collect()]
    assert got == ["BKN", "PHX", "LAL", None]
    got = [r[0] for r in df.select(X.lookup("t", {"LAL": "logos/lal2.png"})).collect()]
    assert got == [None, None, "logos/lal2.png", None]
    assert one(spark, F.col("c"), 1, "c int") == 1
