"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, L, D, B, TS, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.IntegerType()

TRENDING = T.StructType([
    T.StructField("video_id", S), T.StructField("title", S), T.StructField("publishedAt", TS),
    T.StructField("channelId", S), T.StructField("channelTitle", S), T.StructField("categoryId", I),
    T.StructField("trending_date", TS), T.StructField("tags", S), T.StructField("view_count", L),
    T.StructField("likes", L), T.StructField("dislikes", L), T.StructField("comment_count", L),
    T.StructField("thumbnail_link", S), T.StructField("comments_disabled", B),
    T.StructField("ratings_disabled", B), T.StructField("description", S),
])
TRANSCRIPT = T.StructType([T.StructField(c, S) for c in (
    "video_id", "title", "description", "full_transcript", "transcript_source", "transcript_language")])
SFT_RECORD = T.StructType([T.StructField(c, S) for c in ("id", "source", "source_text", "title")])
MESSAGE = T.StructType([T.StructField("role", S), T.StructField("content", S)])
CHAT_RECORD = T.StructType([T.StructField("id", S), T.StructField("source", S),
                            T.StructField("messages", T.ArrayType(MESSAGE))])
PREDICTION = T.StructType([T.StructField(c, S) for c in ("id", "source", "reference", "prediction")])
VERDICT = T.StructType([T.StructField("keep", B), T.StructField("reason", S)])
