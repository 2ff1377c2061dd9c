import pytest
from pyspark.sql import functions as F

from lshthemes.functions import clean_label, jaccard, label_tokens, substring_count, title_case
from lshthemes.sources import ABSTRACTS, POSTS, TWEETS, canonical, shape_of


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ('  **"Login help"**', "Login help"),
        ('**"Login help"**\nmore', 'Login help"'),
        ("x" * 60, "x" * 47 + "..."),
        ("x" * 50, "x" * 50),
        ("", ""),
        (" 'Label' \n", "Label"),
        ("a*b**c", "abc"),
        ("\n\n first\nsecond", "first"),
    ],
)
def test_clean_label(spark, raw, clean):
    assert one(spark, raw, clean_label) == clean


@pytest.mark.parametrize(
    "text", ["wifi + internet", "they're e-mail", "ción + MENT", "a1b2 x", "@ + http", ""]
)
def test_title_case_is_that_of_python(spark, text):
    assert one(spark, text, title_case) == text.title()


@pytest.mark.parametrize("text, part", [("aaaa", "aa"), ("happy app", "app"), ("", "x"), ("abc", "d")])
def test_substring_count_is_that_of_python(spark, text, part):
    assert one(spark, text, lambda v: substring_count(v, F.lit(part))) == text.count(part)


def test_tokens_and_jaccard(spark):
    assert one(spark, "Ción + Ment ment_2", label_tokens) == ["ción", "ment", "ment_2"]

    def alike(a, b):
        row = spark.createDataFrame([(a, b)], "a string, b string")
        return row.select(jaccard(label_tokens("a"), label_tokens("b"))).first()[0]

    assert alike("Theme 12", "Theme 13") == pytest.approx(1 / 3)
    assert alike("Tel", "License + Tel") == 0.5
    assert alike("a b", "B a") == 1.0
    assert alike("+", "a") == alike("+", "+") == 0.0


@pytest.fixture
def papers(spark):
    rows = [(0, 1, "T", "abc", "cs"), (1, 2, "U", "x" * 600, "cs"), (2, 3, "V", None, "ma")]
    return spark.createDataFrame(rows, "row_id long, arxiv_id long, title string, abstract string, category_name string")


def test_papers(papers):
    assert shape_of(papers) is ABSTRACTS
    short, long, empty = canonical(papers).orderBy("row_id").collect()
    assert short["display_text"] == "T\n\nabc..." and short["preview"] == "abc"
    assert long["display_text"] == "U\n\n" + "x" * 200 + "..."
    assert long["preview"] == "x" * 500 + "..."
    assert empty["display_text"] == "V\n\n..." and empty["preview"] is None and empty["body"] == ""
    assert short["item_id"] == "1" and short["category"] == "cs" and short["score"] is None


def test_posts(spark):
    rows = [(0, 7, "T", "T", "ask", 3, "me"), (1, 8, "T", "y" * 600, "ask", 4, "you")]
    df = spark.createDataFrame(rows, "row_id long, hn_id long, title string, text string, category_name string, score int, by string")
    assert shape_of(df) is POSTS
    same, long = canonical(df).orderBy("row_id").collect()
    assert same["preview"] is None and long["preview"] == "y" * 600
    assert (same["score"], same["author"]) == (3, "me")


def test_tweets(spark):
    df = spark.createDataFrame([(0, 5, "é" * 150), (1, 6, "short")], "row_id long, tweet_id long, text string")
    assert shape_of(df) is TWEETS
    long, short = canonical(df).orderBy("row_id").collect()
    assert long["title"] == "é" * 100 and long["display_text"] == long["preview"] == "é" * 150
    assert short["title"] == "short" and short["preview"] is None


def test_unknown_shape(spark):
    with pytest.raises(ValueError, match="known id columns"):
        shape_of(spark.createDataFrame([(1,)], "id long"))
