"""Scored labels for texts, and what is kept of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text as tx
from ..schemas import SCORES
from ..sources import tables
from . import word_vectors
from .joins import merge_features, only_new

# The zero-shot tasks with their labels, template and label mode.
TASKS = {
    "content_intensity": {
        "labels": [
            "no disturbing or sensitive content",
            "scenes involving physical violence or injury",
            "scenes involving death or dying",
            "scenes involving sexual violence or assault",
            "scenes involving self-harm or suicide",
            "scenes involving psychological abuse or distress",
            "scenes involving war, torture, or extreme cruelty",
        ],
        "template": "The content intensity of this book is {}.",
        "multi": True,
    },
    "romance_heat_level": {
        "labels": [
            "no romance at all",
            "clean and innocent romance with no explicit scenes",
            "romance with some mild intimacy or suggestive scenes",
            "explicit sexual scenes described in detail",
        ],
        "template": "This romance in this book contains {}.",
        "multi": False,
    },
    "character_type": {
        "labels": [
            "a traditional heroic main character",
            "an anti-hero with morally ambiguous behavior",
            "a story with multiple main characters",
            "a main character who is a villain",
        ],
        "template": "This story features {}.",
        "multi": False,
    },
    "main_themes": {
        "labels": [
            "love and romantic relationships",
            "war and conflict",
            "travel and exploration",
            "a personal identity quest",
            "social justice issues",
            "ecology and environmental concerns",
            "technology and its impact",
            "death and loss",
            "mystery and investigation",
        ],
        "template": "The topic of this book is about {}.",
        "multi": True,
    },
    "pace": {
        "labels": [
            "a fast-paced story with constant action",
            "a slow-paced story focused on atmosphere",
            "an uneven pacing with ups and downs",
            "a balanced pacing throughout the story",
        ],
        "template": "The narrative pacing of this book is {}.",
        "multi": False,
    },
}
HIGH, LOW = 0.80, 0.60
EMOTION_THRESHOLD = 0.4

# Labels of the emotion and sentiment classifiers.
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
SENTIMENTS = ["negative", "neutral", "positive"]

# Cue words for ``lexicon_scorer``, a scorer that needs no corpus.
EMOTION_CUES = {
    "anger": ["anger", "angry", "rage", "fury", "furious", "hate"],
    "disgust": ["disgust", "disgusting", "vile", "gross", "nasty"],
    "fear": ["fear", "afraid", "terror", "scared", "horror", "dread"],
    "joy": ["joy", "happy", "delight", "fun", "wonderful", "smile"],
    "neutral": ["story", "book", "novel", "read"],
    "sadness": ["sad", "grief", "tears", "sorrow", "lonely", "loss"],
    "surprise": ["surprise", "sudden", "unexpected", "twist", "shock"],
}
SENTIMENT_CUES = {
    "negative": ["bad", "boring", "awful", "poor", "hate", "worst"],
    "neutral": ["story", "book", "novel", "read"],
    "positive": ["good", "great", "love", "best", "beautiful", "wonderful"],
}


def label_cues(labels: list[str]) -> dict[str, list[str]]:
    """Cue words of a label: its own words, short and stop words left out."""
    stop = set(tx.STOP_WORDS)
    cues = {}
    for label in labels:
        words = label.replace(",", " ").replace("-", " ").lower().split()
        cues[label] = [w for w in words if len(w) > 2 and w not in stop]
    return cues


def by_score(scores: Column) -> Column:
    """Entries by falling score, equal ones by label."""
    keyed = F.transform(scores, lambda s: F.struct((-s["score"]).alias("n"), s["label"].alias("label")))
    return F.transform(
        F.sort_array(keyed),
        lambda k: F.struct(k["label"].alias("label"), (-k["n"]).alias("score")),
    )


def _disjoint(cues: dict[str, list[str]]) -> bool:
    words = [w for ws in cues.values() for w in set(ws)]
    return len(words) == len(set(words))


def lexicon_scorer(cues: dict[str, list[str]], multi: bool = False) -> Callable[[Column], Column]:
    """Scores from cue-word counts over the whole text, as native expressions.

    With ``multi`` each label stands alone, hits / (hits + 1); otherwise labels
    compete and the scores sum to 1.
    """

    def score(c: Column) -> Column:
        wanted = sorted({w for ws in cues.values() for w in ws})
        # The text's cue words are few; they are found once and bound, so that
        # the labels do not each read the text again.
        heard = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), tx.NO_LETTERS), lambda w: w.isin(wanted))

        def count(found: Column, words: list[str]) -> Column:
            return F.size(F.filter(found, lambda w: w.isin(words)))

        def entries(found: Column) -> Column:
            hits = {name: count(found, words) for name, words in cues.items()}
            total = F.size(found) if _disjoint(cues) else sum(hits.values(), F.lit(0))
            return F.array(*[
                F.struct(
                    F.lit(name).alias("label"),
                    (n / (n + 1) if multi else (n + 1) / (total + len(cues))).alias("score"),
                )
                for name, n in hits.items()
            ])

        return by_score(F.flatten(F.transform(F.array(heard), entries)))

    return score


def score_text(
    df: DataFrame, text: str, key: str,
    scorer: Callable[[Column], Column] | None = None,
    model: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]] | None = None,
    batch: int = 32,
) -> DataFrame:
    """``(key, scores)`` with scores falling; a missing text is scored as ``""``.

    ``scorer`` is an expression and stays in the JVM. ``model`` is a loader that
    is called once per task and returns a function from a list of texts to their
    (label, score) lists; it is fed ``batch`` texts at a time.
    """
    texts = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if model is None:
        expression = scorer or lexicon_scorer(SENTIMENT_CUES)
        return texts.select(key, expression(F.col("_text")).alias("scores"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for frame in frames:
            rows = []
            for start in range(0, len(frame), batch):
                rows.extend(predict(frame["_text"].iloc[start:start + batch].tolist()))
            ranked = [
                [{"label": a, "score": float(s)} for a, s in sorted(r, key=lambda e: (-e[1], e[0]))]
                for r in rows
            ]
            yield pd.DataFrame({key: frame[key].to_numpy(), "scores": ranked})

    schema = texts.select(key).schema.add("scores", SCORES)
    return texts.mapInPandas(run, schema)


def top_label(df: DataFrame, scores: str = "scores", out: str = "sentiment") -> DataFrame:
    """Best label and its score."""
    best = F.get(F.col(scores), 0)
    return df.withColumn(out, best["label"]).withColumn(f"{out}_score", best["score"])


def _labels(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["label"])


def _none() -> Column:
    return F.array().cast("array<string>")


def select_emotions(df: DataFrame, scores: str = "scores", threshold: float = EMOTION_THRESHOLD) -> DataFrame:
    """All labels at or above the threshold, else the best one."""
    entries = F.col(scores)
    strong = F.filter(entries, lambda e: e["score"] >= threshold)
    best = F.get(entries, 0)
    return (
        df.withColumn(
            "emotions", _labels(F.when(F.size(strong) > 0, strong).otherwise(F.slice(entries, 1, 1)))
        )
        .withColumn("top_emotion", best["label"])
        .withColumn("top_score", best["score"])
    )


def select_labels(
    df: DataFrame, task: str, scores: str = "scores", high: float = HIGH, low: float = LOW,
    multi: bool | None = None,
) -> DataFrame:
    """Labels of a task: with several allowed all at or above ``high``, else the
    best one if it reaches ``low``, else none."""
    multi = TASKS[task]["multi"] if multi is None else multi
    entries = F.col(scores)
    best = F.get(entries, 0)
    chosen = F.when(best["score"] >= low, _labels(F.slice(entries, 1, 1))).otherwise(_none())
    if multi:
        strong = F.filter(entries, lambda e: e["score"] >= high)
        chosen = F.when(F.size(strong) > 0, _labels(strong)).otherwise(chosen)
    return (
        df.withColumn(task, chosen)
        .withColumn(f"{task}_best", best["label"])
        .withColumn(f"{task}_score", best["score"])
    )


def lexicon_scorers() -> dict[str, Callable[[Column], Column]]:
    """A cue-word scorer of each of the seven enrichments, by name."""
    zero_shot = {t: lexicon_scorer(label_cues(TASKS[t]["labels"]), TASKS[t]["multi"]) for t in TASKS}
    return {"emotions": lexicon_scorer(EMOTION_CUES), **zero_shot, "sentiment": lexicon_scorer(SENTIMENT_CUES)}


def enrichments() -> dict[str, word_vectors.Task]:
    """Labels and template of each of the seven enrichments, by name."""
    zero_shot = {t: word_vectors.Task(TASKS[t]["labels"], TASKS[t]["template"], TASKS[t]["multi"]) for t in TASKS}
    return {"emotions": word_vectors.Task(EMOTIONS, "{}", False), **zero_shot,
            "sentiment": word_vectors.Task(SENTIMENTS, "{}", False)}


def _selected(wide: DataFrame) -> DataFrame:
    """What is kept of the scores of all enrichments in ``_<name>``."""
    wide = top_label(select_emotions(wide, "_emotions"), "_sentiment")
    for task in TASKS:
        wide = select_labels(wide, task, f"_{task}")
    return wide.select("book_id", *enrichments())


def default_features(df: DataFrame, model: word_vectors.WordVectors) -> DataFrame:
    """``book_id`` and all seven enrichments, scored by the word vectors of ``model``; every
    text is read once."""
    tasks = {f"_{name}": task for name, task in enrichments().items()}
    return _selected(word_vectors.score_tasks(df, ["book_id"], F.col("description"), model, tasks))


def lexicon_features(df: DataFrame) -> DataFrame:
    """``book_id`` and all seven enrichments by cue words; every text is read once."""
    text = F.coalesce(F.col("description"), F.lit(""))
    return _selected(df.select("book_id", *[score(text).alias(f"_{name}") for name, score in lexicon_scorers().items()]))


def enrich(
    df: DataFrame, root: str, tasks: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    features: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run the enrichments for books not done yet, store each under ``root``,
    and return the merged features.

    The seven built-in ones share one pass over the texts of the books that lack any of
    them. They are scored by word vectors fitted on the books of the first run and
    stored with them, so that later books are scored alike; ``features`` scores them in
    another way. ``tasks`` replaces them by functions from books to ``(book_id, <name>)``.
    """
    spark = df.sparkSession
    names = list(tasks or enrichments())
    paths = {name: f"{root}/{name}" for name in names}
    known = {name: tables.read(spark, path) for name, path in paths.items() if tables.exists(spark, path)}
    if tasks is None:
        whole = merge_features([t.select("book_id") for t in known.values()]) if len(known) == len(names) else None
        if features is None:
            model = word_vectors.WordVectors.of(tables.train_or_load(
                spark, f"{root}/word_vectors", lambda: word_vectors.fit(df, "description").params()))
            features = lambda books: default_features(books, model)
        pending = written(features(df if whole is None else only_new(df, whole)), "features")
    for name in names:
        done = known.get(name)
        if tasks is None:
            fresh = pending.select("book_id", name)
        else:
            fresh = tasks[name](df if done is None else only_new(df, done))
        tables.append_unique(fresh, paths[name])
    return merge_features([tables.read(spark, path) for path in paths.values()])
