import re

import pytest

DOCS = "/root/testdata/sf0.001/documents.parquet"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    text = text or ""
    return re.findall("[^\x20\x09-\x0d]+", text.translate(FOLD) if fold else text)


@pytest.fixture(scope="session")
def llm_spark(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="session")
def docs(llm_spark):
    return llm_spark.read.parquet(DOCS)


LONG = " ".join(f"w{k}" for k in range(40_000))
#: Null and empty texts, copies, ties, a very long text, odd white space, a null
#: and a repeated id, and a column whose name an operator might use inside.
EDGE = [
    (1, None, 1), (2, "", 2), (3, "   \t\n", 3), (4, "one two", 4), (5, "one two", 5), (5, "one two", 5),
    (6, LONG, 6), (7, LONG + " tail", 7), (None, "one two", 8), (None, None, 9),
    (8, "a b c d e f g h i j k l m n o p", 10), (9, "a\u000bb c\nd e f g h  i j k l m n o p", 11),
    (10, "x y a b c d e f g h i j k l m z", 12), (11, "Te " * 300, 13), (12, "te " * 200, 14),
    (13, "éÉ \U0001f600 <|endoftext|> ▁ \x00", 15), (14, "A B C D E F G H I J K L M N O P", 16),
]


@pytest.fixture(scope="session")
def edge(llm_spark):
    return llm_spark.createDataFrame(EDGE, "doc_id long, text string, key long").cache()


@pytest.fixture(scope="session")
def empty(llm_spark):
    return llm_spark.createDataFrame([], "doc_id long, text string, key long")
