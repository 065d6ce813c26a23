"""Composed pipelines: one lazy plan each, from tables to scored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import project_number
from ..operators import tables as B
from ..operators.scoring import sentence_scores


def updates_pipeline(projects: DataFrame, updates: DataFrame, done: DataFrame, scorer: Callable[[Column], Column], url_pattern: str = "(?i)ks.example") -> DataFrame:
    """Updates of the projects that match, have data and aren't done yet, each once, with its features.

    projects has id and project_url, updates id, project_id and body, done project_id.  Null ids match nothing;
    null bodies have 0 words and no sentences.  One plan: filter, semi and anti joins, one join, features.
    """
    p = projects.filter(F.coalesce(F.col("project_url").rlike(url_pattern), F.lit(False))).select(project_number(F.col("id")).alias("project")).filter("project is not null").distinct()
    p = p.join(done.select(project_number(F.col("project_id")).alias("project")).filter("project is not null"), "project", "left_anti")
    u = B.first_by(updates.select("id", "project_id", "body"), ["id"], [F.col("body"), F.col("project_id")], keep_null_keys=True)
    u = u.withColumn("project", project_number(F.col("project_id"))).join(p, "project", "left_semi")
    row = F.struct("id", "project", X.word_count(F.col("body")).alias("n_words"), F.round(X.simple_quality(F.col("body")), 9).alias("quality"))
    s = sentence_scores(u.select(row.alias("row"), "body"), "row", "body", scorer)
    return s.select("row.*", F.round("mean", 6).alias("sentence_mean"))
