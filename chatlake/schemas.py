"""Typed schemas of the stored tables (full dataset and text-free export)."""

from pyspark.sql import types as T

L, I, S, D, TS, DBL = (T.LongType(), T.IntegerType(), T.StringType(), T.DateType(),
                       T.TimestampType(), T.DoubleType())
STR_ARRAY = T.ArrayType(T.StringType())


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CONVERSATIONS = _struct(("id", L), ("file_path", S), ("date", D), ("topic", S), ("model", S),
                        ("system_prompt", S), ("created_at", TS))
MESSAGES = _struct(("id", L), ("conversation_id", L), ("role", S), ("content", S),
                   ("char_start", I), ("char_end", I), ("token_count", L))
DAILY_STATS = _struct(("date", D), ("total_messages", L), ("user_messages", L),
                      ("assistant_messages", L), ("user_tokens", L), ("assistant_tokens", L),
                      ("conversation_count", L))
INSIGHTS = _struct(("id", L), ("message_id", L), ("category", S), ("title", S), ("summary", S),
                   ("tags", STR_ARRAY), ("confidence", DBL), ("extracted_at", TS))
SUMMARIES = _struct(("id", L), ("conversation_id", L), ("summary", S), ("key_topics", STR_ARRAY),
                    ("sentiment", S), ("outcome", S), ("summarized_at", TS))
EMBEDDINGS = _struct(("conversation_id", L), ("embedding", T.ArrayType(T.FloatType())),
                     ("model", S), ("created_at", TS))

# Export dataset: no message text, no system prompt, measures precomputed.
EXPORT_CONVERSATIONS = _struct(("id", L), ("file_path", S), ("date", D), ("topic", S), ("model", S),
                               ("message_count", L), ("user_messages", L),
                               ("assistant_messages", L), ("total_tokens", L))
EXPORT_INSIGHTS = _struct(("id", L), ("conversation_id", L), ("category", S), ("title", S),
                          ("summary", S), ("tags", STR_ARRAY), ("confidence", DBL),
                          ("extracted_at", TS))
EXPORT_TAGS = _struct(("tag", S), ("count", L))

# The allowed enum members.
ROLES = ("user", "assistant")
CATEGORIES = ("wisdom", "product_idea", "programming_tip", "question")
SENTIMENTS = ("technical", "exploratory", "debugging", "learning", "planning", "creative",
              "frustrated", "collaborative")
OUTCOMES = ("resolved", "ongoing", "abandoned", "learning", "decision_made", "idea_generated")

# Result lines of a bulk model job (one JSON object per line).
RESULT_LINE = T.StructType([
    T.StructField("custom_id", S),
    T.StructField("result", T.StructType([
        T.StructField("type", S),
        T.StructField("message", T.StructType([
            T.StructField("content", T.ArrayType(T.StructType([
                T.StructField("type", S), T.StructField("text", S)]))),
        ])),
    ])),
])
