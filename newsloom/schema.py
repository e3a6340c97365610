"""Table schemas and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------

# Stored formats: raw files, layers, messages.

# Date parts are read as text: crawlers write "" for parts they could not parse, and with
# integer fields one such value would flag every row of its file as corrupt.
RAW_ARTICLE = T.StructType(
    [T.StructField("url", T.StringType(), False), T.StructField("src", T.StringType(), False)]
    + [
        T.StructField(name, T.StringType())
        for name in [
            "title", "language", "content", "image_url", "publish_date", "time", "timezone", "hour", "minute", "day", "month",
            "month_number", "year", "weekday", "time_reading", "author",
        ]
    ]
    + [T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("_corrupt", T.StringType())]
)

INT_PARTS = ["hour", "minute", "day", "month_number", "year"]

# The columns of the raw files in their order, then those the cleaning adds.
SILVER_COLUMNS = [
    "url", "src", "title", "language", "content", "image_url", "publish_date", "time", "timezone",
    "hour", "minute", "day", "month", "month_number", "year", "weekday", "time_reading", "author",
    "categories", "main_category", "ingest_time", "processed_date", "processed_hour",
]

GOLD_COLUMNS = [
    "url", "src", "language", "title", "content", "image_url", "publish_date", "time", "timezone",
    "author", "main_category", "categories", "time_reading", "ingest_time", "processed_date", "upload_date",
]

ARTICLE_KEY = ["src", "url"]

UPDATE_MESSAGE = T.StructType(
    [
        T.StructField("update_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField(
            "details",
            T.StructType(
                [
                    T.StructField("processed_rows", T.LongType()),
                    T.StructField("table", T.StringType()),
                    T.StructField("date", T.StringType()),
                    T.StructField("hours", T.ArrayType(T.IntegerType())),
                ]
            ),
        ),
        T.StructField(
            "time_range",
            T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]),
        ),
    ]
)

TRANSCRIPT = "array<struct<startTime:double,endTime:double,text:string>>"

RELATED_QUERIES = (
    "struct<rising:array<struct<query:string,value:string,extracted_value:int,link:string,serpapi_link:string>>,"
    "top:array<struct<query:string,value:string,extracted_value:int,link:string,serpapi_link:string>>>"
)

# Text written by crawlers in place of a missing value.
SENTINELS = {
    "title": ["No title"],
    "content": ["No content"],
    "publish_date": ["No publish date"],
    "author": ["No author"],
    "time_reading": ["No reading time"],
    "src": ["No source"],
    "url": ["No URL"],
    "image_url": ["", "No image available"],
}

# Unified category -> keywords; the order decides ties.
CATEGORY_KEYWORDS = {
    "Sports": ["sports", "football", "nba", "tennis", "soccer", "cricket", "olympics"],
    "Technology": ["tech", "technology", "gadgets", "ai", "software", "hardware", "computing"],
    "Health": ["health", "wellness", "fitness", "medicine", "mental health", "nutrition"],
    "Business and Finance": ["business", "economy", "markets", "finance", "stocks", "investing"],
    "Entertainment": ["entertainment", "movies", "tv", "music", "celebrities", "hollywood", "film", "book"],
    "Politics": ["politics", "election", "government", "policy", "diplomacy"],
    "Science": ["science", "space", "research", "physics", "biology", "nasa"],
    "Climate": ["climate", "environment", "global warming", "carbon", "sustainability"],
    "Food and Drink": ["food", "drink", "cooking", "recipes", "restaurants", "beverage"],
    "Travel and Transportation": ["travel", "transportation", "flights", "hotels", "tourism"],
    "Beauty and Fashion": ["fashion", "style", "beauty", "makeup", "clothing"],
    "Autos and Vehicles": ["cars", "autos", "vehicles", "automobile", "motorcycles"],
    "Games": ["games", "gaming", "video games", "e-sports"],
    "Hobbies and Leisure": ["hobbies", "leisure", "crafts", "diy", "collections"],
    "Jobs and Education": ["jobs", "career", "education", "school", "university"],
    "Law and Government": ["law", "justice", "regulation", "court", "legal", "government"],
    "Pets and Animals": ["pets", "animals", "wildlife", "cats", "dogs"],
    "Shopping": ["shopping", "ecommerce", "retail", "deals", "sales"],
    "Other": ["World", "top stories", "lastest"],
}

CATEGORIES = sorted(CATEGORY_KEYWORDS)

# Categories shown on the front page, in order.
FRONT_PAGE_CATEGORIES = ["Politics", "Science", "Sports", "Technology", "Climate"]

# Pages that are not articles.
EXCLUDED_URL = r"/crosswords?/|/newsletters/signup/|/video/|/videos/"

# Links on a section page that are not articles.
EXCLUDED_LINK = r"/video/|/gallery/"

# Paragraphs with one of these phrases are boilerplate; text before the marker is dropped.
BOILERPLATE_PHRASES = ["Sign up for CNN’s Wonder Theory", "Sign up here"]
DATELINE_MARKER = "(CNN) —"

# Hours of a day are processed in these slots, local time.
SLOT_STARTS = [0, 5, 11, 17]
SLOT_ZONE = "Asia/Ho_Chi_Minh"

# Time zone abbreviations with a fixed offset; "ET" follows the rules of New York.
ZONE_OFFSETS = {
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00",
    "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "UTC": "+00:00", "GMT": "+00:00",
}

# Weights of the three embedding models in the ensemble.
MODEL_WEIGHTS = [0.25, 0.35, 0.40]

# Stop words of the English analyzer.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their",
    "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

# Search field boosts and ranking constants.
FIELD_BOOSTS = {"title": 3.0, "summary": 2.0, "content": 1.0}
BM25_K1 = 1.2
BM25_B = 0.75

# Speech timing: 150 words a minute, in hundredths of a second.
WORD_CS = 40
LONG_SENTENCE_WORD_CS = 44
LONG_SENTENCE_CHARS = 100
COMMA_CS = 10
PAUSE_CS = 30

# Bytes per second of audio at 128 kbit/s.
AUDIO_BYTES_PER_SECOND = 128 * 1024 / 8
