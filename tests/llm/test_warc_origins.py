from pyspark.sql import functions as F

from chronolith.llm import warc


def archived(spark, pages, **options):
    folder, index = warc.write_archives(spark, pages, **options)
    wanted = pages.select(warc.capture_key(F.col("url")).alias("key"), "page_id")
    return sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.look_up(spark, folder, index, wanted).collect()), key=str)


def test_rows_of_one_page_revisit_by_their_own_payload(spark):
    a, b, c = "a" * 200, "b" * 150, "c" * 99
    given = [(1, "http://x/1", a), (2, "http://x/2", a), (2, "http://x/2", b), (2, "http://x/2", c), (3, "http://x/3", c), (None, "http://x/4", a), (None, "http://x/4", "d" * 300), (5, None, b), (1, "http://x/1", a)]
    got = archived(spark, spark.createDataFrame(given, "page_id long, url string, html string"))
    assert got == sorted(
        [(1, "response", None, 200)] * 2 + [(2, "revisit", 1, 200), (2, "response", None, 150), (2, "response", None, 99), (3, "response", None, 99), (None, "revisit", 1, 200), (None, "response", None, 300), (5, "revisit", 2, 150)],
        key=str,
    )


def test_pages_are_shuffled_once_whatever_is_broadcast(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", "p" * 120 if i % 3 else f"{i}" * 60) for i in range(60)], "page_id long, url string, html string")
    first = archived(spark, pages)
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        assert archived(spark, pages) == first
        plan = warc.revisits(spark, pages)._jdf.queryExecution().optimizedPlan().toString()
        assert "html" not in plan  # what is joined are digests
    finally:
        spark.conf.set(key, was)
    assert [x[:3] for x in first] == sorted(((i, "revisit" if i % 3 and i != 1 else "response", 1 if i % 3 and i != 1 else None) for i in range(60)), key=str)
