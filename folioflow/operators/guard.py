"""Checks of questions before and of hits after a search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import strip

# Limits of a question, the greatest mean distance of relevant hits, forbidden phrases, words of the subject.
SHORTEST, LONGEST, FARTHEST = 5, 500, 0.65
TOO_SHORT = "Query too short. Please ask a full question."
TOO_LONG = "Query too long (max 500 chars)."
DISALLOWED = "Query contains disallowed instructions."
OFF_TOPIC = "Warning: query may be outside the scope of the loaded books (AI/ML topics)."
IRRELEVANT = "Retrieved chunks have low relevance. Answer may not be grounded in the documents."
INJECTIONS = (
    "ignore (previous|above|all) instructions",
    "you are now",
    "forget (everything|your instructions)",
    "system prompt",
    "act as (a )?(different|new|another)",
    "disregard",
    "jailbreak",
)
TOPICS = (
    "ai", "ml", "machine learning", "deep learning", "neural", "model", "training", "dataset", "algorithm", "classification", "regression", "transformer",
    "llm", "embedding", "gradient", "backprop", "gan", "cnn", "rnn", "lstm", "attention", "reinforcement", "supervised", "unsupervised", "inference",
    "prediction", "feature", "overfitting",
)


def input_problem(query: Column) -> Column:
    """Why a question is refused, or an empty string; the first reason counts. A NULL question is too short."""
    q = strip(F.coalesce(query, F.lit("")))
    bad = F.lit(False)
    for pattern in INJECTIONS:
        bad = bad | q.rlike(f"(?i){pattern}")
    return F.when(F.length(q) < SHORTEST, TOO_SHORT).when(F.length(q) > LONGEST, TOO_LONG).when(bad, DISALLOWED).otherwise("")


def on_topic(query: Column) -> Column:
    """Whether any subject word occurs anywhere in the lower-cased question, also inside other words."""
    return F.lower(F.coalesce(query, F.lit(""))).rlike("|".join(TOPICS))


def topic_warning(query: Column) -> Column:
    return F.when(on_topic(query), "").otherwise(OFF_TOPIC)


def relevance_warning(mean_distance: Column) -> Column:
    """Empty for a mean distance up to the limit; no hits count as distance 1."""
    return F.when(F.coalesce(mean_distance, F.lit(1.0)) > FARTHEST, IRRELEVANT).otherwise("")
