"""The queries of the text operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries_tables import pid
from ..session import saved, ship_package, spread
from ..session import table as read_table
from .bpe import encode_corpus
from .packing import pack
from .reading import reading_levels
from .residue import template_residue
from .survivor import filled_survivors, story_features, survivors
from .textstats import text_quality


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one of texts is spread over all cores, as its queries work more than they read."""
    df = read_table(spark, d, name)
    return spread(df) if name in ("documents", "stories", "combined_all_columns") else df


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(table(spark, d, "stories")).filter("is_residue").select("story_row_id")


def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every row of stories with what it shows instead of a story."""
    return template_residue(table(spark, d, "stories"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "stories")).select("platform", "project_id", "story_row_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving story of each project, its nulls filled from the next layers."""
    return filled_survivors(table(spark, d, "stories"))


def p2_policy(spark: SparkSession, d: str) -> DataFrame:
    """The same, with every text usable that isn't blank: what SQL can say too."""
    s = table(spark, d, "stories")
    f = story_features(s).withColumn("usable", F.when(F.col("blank"), 0).otherwise(1))
    return survivors(s, f).select("platform", "project_id", "story_row_id", "n_rows")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return text_quality(table(spark, d, "combined_all_columns"), table(spark, d, "common_words"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).filter("not is_prose").select("row_id")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every row's text statistics, distance, contributions and verdict."""
    return _quality(spark, d)


def _vocabulary(name: str = "byte_bpe_50k") -> str:
    """The file of a public tokenizer; the folder is a parameter of the environment."""
    folder = os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, f"{name}.tiktoken")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return encode_corpus(table(spark, d, "documents"), _vocabulary())


def _lengths(spark: SparkSession, d: str, tokenizer: str) -> DataFrame:
    ship_package(spark)
    return saved(encode_corpus(table(spark, d, "documents"), _vocabulary(tokenizer), ids=False))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container in the packing of each target: the capacities of its tokenizer up to the target's
    are permitted lengths, the number of containers comes before their room."""
    out, lengths = None, {}
    targets = table(spark, d, "packing_targets").orderBy("target_id").collect()  # three rows
    for t in targets:
        if t["tokenizer"] not in lengths:
            lengths[t["tokenizer"]] = _lengths(spark, d, t["tokenizer"])
        top = t["capacity_tokens"]
        permitted = sorted({x["capacity_tokens"] for x in targets if x["tokenizer"] == t["tokenizer"] and x["capacity_tokens"] <= top})
        one = pack(lengths[t["tokenizer"]], permitted, overhead=top).select(F.lit(t["target_id"]).alias("target_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p8_joint(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container if all permitted lengths are used together and room alone counts."""
    targets = table(spark, d, "packing_targets").filter("tokenizer = 'byte_bpe_50k'").collect()  # three rows
    return pack(_lengths(spark, d, "byte_bpe_50k"), sorted({t["capacity_tokens"] for t in targets}))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), table(spark, d, "common_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).filter("level = 5").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every document's reading level, with its distribution."""
    return _levels(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: documents, pieces and tokens laid, containers, those over the capacity or the target's least number, texts split though they fit."""
    p = p8_containers(spark, d)
    cap = table(spark, d, "packing_targets").select("target_id", "capacity_tokens")
    doc = p.groupBy("target_id", "doc_id").agg(F.count("*").alias("_pieces"), F.sum("n_tokens").alias("_tokens")).join(F.broadcast(cap), "target_id")
    docs = doc.groupBy("target_id").agg(F.count("*").alias("documents"), F.sum("_tokens").alias("tokens"), F.count_if(F.col("_pieces") != F.greatest(F.ceil(F.col("_tokens") / F.col("capacity_tokens")), F.lit(1))).alias("wrongly_split"))
    box = p.filter("n_tokens > 0").groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("_used"), F.min("container_size").alias("_low"), F.max("container_size").alias("_size")).join(F.broadcast(cap), "target_id")
    boxes = box.groupBy("target_id").agg(F.count("*").alias("containers"), F.count_if((F.col("_used") > F.col("_size")) | (F.col("_low") != F.col("_size")) | (F.col("_size") > F.col("capacity_tokens"))).alias("overfull"), F.max("capacity_tokens").alias("_c"))
    out = docs.join(boxes, "target_id")
    return out.select("target_id", "documents", "wrongly_split", "overfull", (F.col("containers") <= F.ceil(F.col("tokens") / F.col("_c")) * 1.01 + 1).alias("tight"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each platform: rows of stories, and those without a text, which never are residue."""
    s = table(spark, d, "stories").select("story_row_id", "platform", (F.coalesce(F.regexp_replace("story_content", r"[\s\u00A0]+", ""), F.lit("")) == "").alias("_none"))
    v = template_residue(table(spark, d, "stories"), carry={"platform": F.col("platform")})
    j = v.join(s.drop("platform"), "story_row_id")
    return j.groupBy("platform").agg(F.count("*").alias("n_rows"), F.count_if("_none").alias("n_none"), F.count_if(F.col("_none") & F.col("is_residue")).alias("n_none_residue"), F.count_if(F.col("kind").isNotNull() != F.col("is_residue")).alias("n_unlike"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_verdicts, p1_counts, p2_found, p2_policy, p2_survivors, p6_found, p6_statistics, p7_ids, p8_containers, p8_joint, p8_report, p9_found, p9_levels)
}
_WS = r"[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_POLICY = rf"""WITH s AS (SELECT story_row_id, platform, {pid('id')} AS project_id, list_distinct(list_transform(string_split(story_content, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g')))) AS lines, is_throttled, scraped_at FROM stories),
 f AS (SELECT *, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS n FROM s WHERE platform IS NOT NULL AND project_id IS NOT NULL),
 r AS (SELECT *, count(*) OVER (PARTITION BY platform, project_id) AS n_rows, row_number() OVER (PARTITION BY platform, project_id ORDER BY n = 0, coalesce(is_throttled, false), n DESC, scraped_at DESC NULLS LAST, story_row_id) AS rn FROM f)
SELECT platform, project_id, story_row_id, CAST(n_rows AS BIGINT) AS n_rows FROM r WHERE rn = 1 AND n_rows >= 2"""
# What SQL can say: how many of each there are, and what never holds.  The operators themselves are tested by brute
# force, round trips and held-out accuracy.
SQL: dict[str, str] = {
    "p1_counts": r"""SELECT platform, CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(coalesce(regexp_replace(story_content, '[\s\x{A0}]+', '', 'g'), '') = '') AS BIGINT) AS n_none, CAST(0 AS BIGINT) AS n_none_residue, CAST(0 AS BIGINT) AS n_unlike FROM stories GROUP BY 1""",
    "p2_policy": _POLICY,
    "p8_report": "SELECT target_id, CAST((SELECT count(*) FROM documents) AS BIGINT) AS documents, CAST(0 AS BIGINT) AS wrongly_split, CAST(0 AS BIGINT) AS overfull, true AS tight FROM packing_targets",
}
