"""Review ingestion: once per id, replays, lost progress."""

import pytest

from bookfeel.cluster import work_path
from bookfeel.sources import tables
from bookfeel.streaming.reviews import ingest_reviews

TEXT = " ".join(["word"] * 60)


def deliver(spark, folder, ids, text=TEXT, book=1):
    rows = [{"review_id": i, "book_id": book, "review_text": text} for i in ids]
    import json

    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(2).write.mode("append").text(folder)


def stored(spark, out):
    return sorted(r["review_id"] for r in tables.read(spark, out).collect())


def test_once_per_id(spark):
    landing, out, checkpoint = (work_path(spark, n) for n in ("landing", "stored", "progress"))
    books = spark.createDataFrame([(1,), (1,)], "book_id long")
    from bookfeel.schemas import REVIEWS_RAW

    kind = REVIEWS_RAW["book_id"].dataType.simpleString()
    books = books.selectExpr(f"CAST(book_id AS {kind}) AS book_id")
    deliver(spark, landing, ["a", "b", "b"])
    deliver(spark, landing, ["short"], "few words")
    deliver(spark, landing, ["stranger"], book=2)
    ingest_reviews(spark, landing, books, out, checkpoint)
    assert stored(spark, out) == ["a", "b"]
    deliver(spark, landing, ["b", "c"])
    deliver(spark, landing, ["short"])  # now long enough
    ingest_reviews(spark, landing, books, out, checkpoint)
    assert stored(spark, out) == ["a", "b", "c", "short"]
    ingest_reviews(spark, landing, books, out, checkpoint)
    assert stored(spark, out) == ["a", "b", "c", "short"]
    # A batch that was written but not committed is replayed to the same end.
    root = checkpoint.removeprefix("file:")
    import glob
    import os

    last = max(int(os.path.basename(p)) for p in glob.glob(f"{root}/commits/[0-9]*"))
    for name in (f"{root}/commits/{last}", f"{root}/commits/.{last}.crc"):
        if os.path.exists(name):
            os.rename(name, name + ".lost")
    ingest_reviews(spark, landing, books, out, checkpoint)
    assert stored(spark, out) == ["a", "b", "c", "short"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").find("RocksDB") == -1
    with pytest.raises(ValueError):
        ingest_reviews(spark, landing, books, out, work_path(spark, "elsewhere"))
