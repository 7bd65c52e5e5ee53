"""Kind and price of a listed model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a model name that show it is not a text model.
NON_TEXT_MARKERS = [
    "whisper", "tts", "transcribe", "audio", "realtime", "dall-e", "image", "moderation", "guard", "orpheus", "sora",
    "playai", "computer-use", "search-preview", "veo", "imagen", "lyria", "native-audio", "rerank", "ocr", "flux",
    "stable-diffusion", "sdxl", "vision-only",
]
# Listing types of each kind.
EMBEDDING_TYPES = ["embedding", "embeddings", "text-embedding"]
CHAT_TYPES = ["chat", "language", "llm", "text", "code", "completion"]


def names_text_model(model_id: Column) -> Column:
    return ~F.lower(model_id).rlike("|".join(NON_TEXT_MARKERS))


def classify_model(model_id: Column, listed_type: Column, output_modalities: Column) -> Column:
    """'embedding', 'llm' or null, from the listing's own metadata before the name."""
    kind = F.lower(F.coalesce(listed_type, F.lit("")))
    llm_if_text = F.when(names_text_model(model_id), F.lit("llm"))
    outputs = F.coalesce(output_modalities, F.array().cast("array<string>"))
    return (
        F.when(kind.isin(EMBEDDING_TYPES), F.lit("embedding"))
        .when((kind != "") & ~kind.isin(CHAT_TYPES), None)
        .when(F.array_contains(outputs, "embeddings"), F.lit("embedding"))
        .when(F.size(outputs) > 0, F.when(F.array_contains(outputs, "text"), llm_if_text))
        .when(kind.isin(CHAT_TYPES), llm_if_text)
        .when(F.lower(model_id).contains("embed"), F.lit("embedding"))
        .otherwise(llm_if_text)
    )


def is_free(prices: Column) -> Column:
    """True when every listed price is zero, null when none is listed."""
    listed = F.filter(prices, lambda p: p.isNotNull())
    return F.when(F.size(listed) > 0, F.forall(listed, lambda p: p.cast("double") == 0))


def end_date(expiration: Column, today: Column) -> Column:
    """A date more than five calendar years ahead means no end date."""
    return F.when(F.year(expiration) <= F.year(today) + 5, expiration)
