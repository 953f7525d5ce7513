"""The given tables seen as evidence, labels, exports and feeds.

Every frame here covers its tables whole. Each has a counterpart in
``oracles.py`` that says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.columns import iso_time, week_start

DOWNLOADED_AT = "2024-02-01T00:00:00+00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_id(ts: Column) -> Column:
    """One collection run per week."""
    return F.concat(F.lit("run_"), F.date_format(week_start(ts), "yyyyMMdd"))


def dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the event that gives them an author and a time."""
    events = table(spark, sf_dir, "events").drop("props")
    return table(spark, sf_dir, "documents").join(
        events, F.col("event_id") == F.col("doc_id") * 5, "left"
    )


def _evidence_id() -> Column:
    kind = F.when(F.col("event_type").isin("click", "view"), "comment").otherwise("post")
    return F.concat(kind, F.lit("_"), F.col("doc_id").cast("string"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence row per document."""
    doc = F.col("doc_id").cast("string")
    comment = F.col("event_type").isin("click", "view")
    return dated_documents(spark, sf_dir).select(
        _evidence_id().alias("evidence_id"),
        F.when(comment, "comment").otherwise("post").alias("source_type"),
        run_id(F.col("ts")).alias("run_id"),
        F.col("source").alias("subreddit"),
        doc.alias("post_id"),
        F.when(comment, doc).otherwise("").alias("comment_id"),
        F.when(F.col("value") < 10, "[deleted]")
        .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("author"),
        F.col("ts").alias("created_at"),
        F.concat_ws(" ", "source", doc).alias("title"),
        F.col("text"),
        F.concat(F.lit("https://forum.example/"), doc).alias("permalink"),
        F.col("n_chars").cast("int").alias("score"),
    )


def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label row per labelled document."""
    docs = dated_documents(spark, sf_dir).drop("text")
    pain, delight = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        _evidence_id().alias("evidence_id"),
        F.when(F.col("lang") == "en", "Chevy").when(F.col("lang") == "de", "GMC")
        .when(F.col("lang") == "fr", "GM").otherwise("unknown").alias("brand"),
        F.col("source").alias("model"),
        F.when(F.col("event_type") == "click", "EV").when(F.col("event_type") == "signup", "PHEV")
        .when(F.col("event_type").isin("view", "purchase"), "ICE").otherwise("unknown").alias("powertrain"),
        pain.alias("is_pain_point"),
        F.when(pain, F.col("event_type")).alias("pain_theme"),
        delight.alias("is_delight"),
        F.when(delight, F.col("event_type")).alias("delight_theme"),
        F.when(pain & delight, "mixed").when(pain, "negative").when(delight, "positive")
        .otherwise("neutral").alias("sentiment"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).cast("float").alias("confidence"),
    )


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of each conversation with the event that dates it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return table(spark, sf_dir, "conversations").filter(F.col("turn") == 0).join(
        events, F.col("event_id") == F.col("conv_id") * 100, "left"
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts export: one row per conversation."""
    system = F.col("role") == "system"
    return _roots(spark, sf_dir).select(
        run_id(F.col("ts")).alias("run_id"),
        F.lit(DOWNLOADED_AT).alias("downloaded_at"),
        F.lit("export").alias("source_tool"),
        F.lit("new").alias("category"),
        F.lit("").alias("time_filter"),
        F.col("conv_id").cast("string").alias("id"),
        F.col("role").alias("subreddit"),
        F.concat(F.lit(" Conversation "), F.col("conv_id").cast("string"), F.lit("\n")).alias("title"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
        F.concat(F.length("text").cast("string"), F.lit(".5")).alias("score"),
        F.lit("").alias("comment_count"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("created_at"),
        F.lit("text").alias("post_type"),
        F.when(system, "content").otherwise("selftext").alias("content_source"),
        F.when(system, "").otherwise(F.col("text")).alias("selftext"),
        F.lit("").alias("outbound_url"),
        F.lit("").alias("domain"),
        F.concat(F.lit("https://forum.example/c/"), F.col("conv_id").cast("string"), F.lit("/")).alias("permalink"),
        F.col("text").alias("content"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments export: one row per later turn."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    root = posts(spark, sf_dir).select(
        F.col("id").cast("long").alias("conv_id"), "run_id", "downloaded_at",
        F.col("subreddit").alias("post_subreddit"), F.col("title").alias("post_title"),
        F.col("permalink").alias("post_permalink"),
    )
    said = table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)
    return said.join(root, "conv_id").select(
        "run_id", "downloaded_at",
        conv.alias("post_id"), "post_subreddit", "post_title", "post_permalink",
        turn.alias("comment_rank"),
        F.concat_ws("_", conv, turn).alias("comment_id"),
        F.col("role").alias("author"),
        F.when(F.col("role") == "user", "n/a").otherwise(F.length("text").cast("string")).alias("score"),
        F.col("text").alias("body"),
        F.lit("0").alias("reply_count"),
        F.concat("post_permalink", turn, F.lit("/")).alias("comment_permalink"),
    )


def _thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as a crawler lands them: those of a post as one array, which is its row."""
    said = table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)
    item = F.struct(
        "turn",
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") != "assistant", F.col("role")).alias("author"),
        F.col("text").alias("body"),
        F.length("text").cast("string").alias("score"),
        F.lit("0").alias("reply_count"),
    )
    return said.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(item)), lambda c: c.dropFields("turn")
    ).alias("comments"))


def page_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed feed: one post per page, with the conversation of that number."""
    url = F.col("url")
    gallery, blog = url.contains("#"), url.startswith("https://blog.")
    root = table(spark, sf_dir, "conversations").filter(F.col("turn") == 0).select("conv_id", "role", "text")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    joined = pages.join(root, F.col("conv_id") == F.col("page_id"), "left").join(
        _thread(spark, sf_dir), "conv_id", "left"
    )
    return joined.select(
        F.coalesce("role", F.lit("pages")).alias("subreddit"),
        F.col("page_id").cast("string").alias("id"),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.col("role").alias("author"),
        F.length(url).cast("string").alias("score"),
        F.lit("2024-01-05T10:00:00.250000+01:00").alias("created_at"),
        F.when(blog, url).otherwise(
            F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit("/"))).alias("permalink"),
        F.col("text").alias("body"),
        F.when(~gallery, F.when(blog, F.concat(url, F.lit("/"))).otherwise(url)).alias("link"),
        F.when(gallery, url).alias("gallery_link"),
        F.when(F.col("role").isNotNull() | blog, "TextPost").when(gallery, "GalleryPost")
        .when(url.endswith(".html"), "LinkPost").otherwise("OtherPost").alias("kind"),
        F.coalesce(F.size("comments"), F.lit(0)).cast("string").alias("comment_count"),
        "comments",
    )


COMMENT = "array<struct<id:string,author:string,body:string,score:string,reply_count:string>>"


def document_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed feed: one post per document."""
    return dated_documents(spark, sf_dir).select(
        F.col("source").alias("subreddit"),
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(" ", "source", "doc_id").alias("title"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
        F.col("n_chars").cast("string").alias("score"),
        iso_time(F.col("ts")).alias("created_at"),
        F.concat(F.lit("/p/"), F.col("doc_id").cast("string")).alias("permalink"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("link"),
        F.lit(None).cast("string").alias("gallery_link"),
        F.lit("TextPost").alias("kind"),
        F.lit("0").alias("comment_count"),
        F.array().cast(COMMENT).alias("comments"),
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a search index."""
    doc = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        doc.alias("post_id"), F.col("source").alias("subreddit"), F.concat_ws(" ", "source", doc).alias("title"),
        F.concat(F.lit("https://forum.example/"), doc).alias("permalink"), "text",
    )


def labelled_documents_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts collected earlier: the documents that have a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id").select(
        F.col("source").alias("subreddit"), F.col("doc_id").cast("string").alias("id")
    )


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per topic: its first vector."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("question_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries rebuilt from the evidence: one struct per community."""
    counted = evidence(spark, sf_dir).filter(F.col("run_id").isNotNull()).groupBy("run_id", "subreddit").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_type") == "comment").alias("c"),
        F.max("created_at").alias("last"), F.min("created_at").alias("first"),
    )
    item = F.struct(
        "subreddit", F.lit("completed").alias("status"),
        F.col("n").alias("inspected_posts"),
        F.when(F.col("c") > 0, F.col("n") - F.col("c")).alias("eligible_posts"),
        F.col("n").alias("new_posts"), F.col("c").alias("comments"),
        (F.col("n") + F.col("c")).alias("combined_rows"),
    )
    # Bounded by the number of communities of a run.
    return counted.groupBy("run_id").agg(
        iso_time(F.min("first")).alias("started_at"), iso_time(F.max("last")).alias("completed_at"),
        F.collect_list(item).alias("subreddits"),
    )


def status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status records: every event is one, of the kind of its user."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done") \
        .when(F.col("event_type") == "signup", "pending").otherwise("running")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("kind"),
        state.alias("state"),
        F.col("ts").alias("started_at"), F.col("ts").alias("heartbeat_at"), F.col("ts").alias("updated_at"),
    )
