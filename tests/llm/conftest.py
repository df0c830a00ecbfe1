import pytest


@pytest.fixture
def documents(spark):
    """A small table with the awkward rows every operator must take, and columns that clash."""
    long = " ".join(f"w{i}" for i in range(60_000))
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " more", "en", "a", 5),
        (3, None, "en", "a", None), (4, "", "fr", "b", 0), (5, "  \n\t ", None, None, 5),
        (None, text, "de", "b", 5), (None, None, None, None, None), (6, long, "en", "c", 5),
        (7, "Ça va? Übung 你好 🙂", "fr", "c", 5), (8, "x", "en", "a", 1), (9, "x", "en", "b", 1),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    names = ("row", "key", "n", "hash", "size", "rate", "copies", "target", "source_size", "weight",
             "curve", "shard", "slot", "label", "kind", "n_entities", "kinds", "score", "same", "page",
             "__again", "__marks", "__same", "__doc", "__row", "__pos", "__part")
    return spark.createDataFrame(rows, columns).withColumns({c: F.lit(f"own {c}") for c in names})


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
