import os

import pytest
from pyspark.sql import functions as F

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000


@pytest.fixture(scope="session", autouse=True)
def checkpoint_dir(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def edge_documents(spark):
    near = " ".join(f"word{i}" for i in range(120))
    rows = [
        (-1, None), (-2, ""), (-3, " \t\n "), (-4, "one two three"), (-5, "one  two\nTHREE"), (-6, near), (-7, near.upper()), (-8, near + " tail"),
        (-9, near.replace("word60", "changed")), (-10, LONG), (-11, "Été à l'école № 5 — naïve 漢字 🙂 e\u0301 <|endoftext|>"), (None, near), (None, None),
        (-12, "same row"), (-12, "same row"), (-13, "a a a a a a a a a a a a"), (-14, "x" * 70_000),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows added to each."""
    out = str(tmp_path_factory.mktemp("edge"))
    read = lambda t: spark.read.parquet(f"{BASE}/{t}.parquet")
    read("documents").unionByName(edge_documents(spark)).write.parquet(f"{out}/documents.parquet")
    odd = spark.createDataFrame([(-4, None, None), (None, 1, 0), (-6, 1, 0), (-6, 1, 0)], "doc_id long, quality int, toxic int")
    read("labels").unionByName(odd).write.parquet(f"{out}/labels.parquet")
    items = spark.createDataFrame([(900, "one two three"), (901, None), (902, " . "), (903, " ".join(f"word{i}" for i in range(20, 45))), (903, "one two three")],
                                  "item_id long, text string")
    read("benchmark").unionByName(items).write.parquet(f"{out}/benchmark.parquet")
    pages = spark.createDataFrame(
        [(-1, None, None), (-2, "", ""), (-3, "no scheme/path", "<p>a<"), (-4, "HTTPS://Sub.Example.ORG/es/x?q#f", "<!-- open"), (-5, "x://Org/", "<article><p>One two three four.</p>")],
        "page_id long, url string, html string")
    read("pages").unionByName(pages).write.parquet(f"{out}/pages.parquet")
    chats = spark.createDataFrame(
        [(7000, 0, None, None), (7000, 1, "assistant", "<s>\\[/INST] [\\INST] \n x"), (7000, 1, "assistant", ""), (7001, None, "tool[END]", "[OUT]a</s>"), (None, 0, "user", "hi")],
        "conv_id long, turn long, role string, text string")
    read("conversations").unionByName(chats).write.parquet(f"{out}/conversations.parquet")
    vectors = read("embeddings")
    size = len(vectors.first().embedding)
    row = lambda i, x, label: (i, None if x is None else [x] * size, label)
    odd = [row(100000, 0.25, 1), row(100000, 0.25, 1), row(100001, 0.25, 1), row(100002, 0.25, 2), row(100003, -0.125, 2), row(200000, None, 1), row(200100, 0.5, None),
           row(None, 0.5, 1), row(200200, float("nan"), 1), row(200300, float("inf"), 2), row(100004, 0.0, 3), (200400, [0.5, None] + [0.0] * (size - 2), 1)]
    vectors.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="session")
def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
