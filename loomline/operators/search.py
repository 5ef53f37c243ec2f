"""Hybrid retrieval over the index: filter, score, rank, cut, render.

Filters come before scoring and reach the scan; the query's vector and terms are literals, so scoring is one pass with
no join, and the cut is a top-k per task followed by one of the tasks' results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.score import WEIGHTS, cosine, hashed_embedding, instant, matched_terms, recency, tag_hit
from loomline.functions.text import extract_terms, snippet, timestamp_anchor
from loomline.operators.chunking import with_tag


@dataclass
class SearchOptions:
    query: str
    limit: int = 20
    since_days: int | None = None
    tag: str | None = None


def analyse(spark: SparkSession, query: str, embed=None) -> tuple[list[str], list[float]]:
    """Terms and vector of a query."""
    row = spark.range(1).select(F.lit(query).alias("q")).select(extract_terms(F.col("q")).alias("terms"), "q")
    row = row.select("terms", (embed(F.col("q")) if embed else hashed_embedding(F.col("terms"))).alias("v")).first()
    return list(row.terms), [float(x) for x in row.v]


def score(index: DataFrame, terms: list[str], vector: list[float], now: str) -> DataFrame:
    """The index with ``vector_score, keyword_score, tag_score, recency_score, total`` and ``matched_terms``, rounded to six places."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    hits = matched_terms(F.col("terms"), terms)
    out = index.withColumn("matched_terms", hits).withColumns({
        "vector_score": F.round(F.greatest(cosine(q, F.col("vector")), F.lit(0.0)), 6),
        "keyword_score": F.round(F.size("matched_terms") / len(terms), 6) if terms else F.lit(0.0),
        "tag_score": F.when(tag_hit(F.col("tags"), terms), 1.0).otherwise(0.0),
        "recency_score": F.round(recency(F.col("created_at"), now), 6),
    })
    total = sum(w * F.col(f"{k}_score") for k, w in WEIGHTS.items())
    return out.withColumn("total", F.round(total, 6))


def since(index: DataFrame, days: int, now: str) -> DataFrame:
    """Chunks of the last ``days`` days; those without a date are out."""
    return index.filter(instant(F.col("created_at")) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(max(days, 0))))


def search(index: DataFrame, options: SearchOptions, now: str, vector: list[float] | None = None, embed=None) -> DataFrame:
    """The best chunks, each with its parts of the score and a snippet."""
    terms, own = analyse(index.sparkSession, options.query, embed)
    rows = index
    if options.since_days is not None:
        rows = since(rows, options.since_days, now)
    if options.tag:
        rows = with_tag(rows, options.tag)
    ranked = score(rows, terms, vector or own, now).filter("total > 0").orderBy(F.desc("total"), F.desc("created_at"), "id").limit(max(options.limit, 1))
    return ranked.select("id", "note_id", "note_title", "note_kind", "created_at", "start_ms", "end_ms", snippet(F.col("text")).alias("snippet"), "matched_terms", "vector_score", "keyword_score", "tag_score", "recency_score", "total")


def result_lines(results: DataFrame) -> DataFrame:
    """One text line a result."""
    anchor = F.coalesce(F.concat(F.lit(" ["), timestamp_anchor(F.col("start_ms"), F.col("end_ms")), F.lit("]")), F.lit(""))
    return results.select(F.format_string("%.3f\t%s%s\t%s\t%s", "total", "note_title", anchor, "note_id", "snippet").alias("line"))


def context_pack(results: DataFrame, options: SearchOptions, generated: str) -> str:
    """The results, at most ``limit``, as a Markdown document."""
    rows = results.withColumn("anchor", timestamp_anchor(F.col("start_ms"), F.col("end_ms"))).orderBy(F.desc("total"), F.desc("created_at"), "id").collect()
    head = ["# Context Pack", "", f"- Query: `{options.query}`", f"- Generated: `{generated}`"]
    head += [f"- Since: last {options.since_days} days"] if options.since_days is not None else []
    head += [f"- Tag: `{options.tag}`"] if options.tag else []
    if not rows:
        return "\n".join([*head, "", "No matching chunks found.", ""])
    parts = ["\n".join([*head, ""])]
    for n, r in enumerate(rows, 1):
        facts = [f"- Note ID: `{r.note_id}`", f"- Chunk ID: `{r.id}`"]
        facts += [f"- Timestamp: `{r.anchor}`"] if r.anchor else []
        facts += ["- Matched terms: " + ", ".join(f"`{t}`" for t in r.matched_terms)] if r.matched_terms else []
        facts.append(f"- Score: {r.total:.3f} (vector {r.vector_score:.3f}, keyword {r.keyword_score:.3f}, tag {r.tag_score:.3f}, recency {r.recency_score:.3f})")
        quoted = r.snippet.replace("\n", "\n> ")
        parts.append(f"## {n}. {r.note_title} ({r.created_at})\n\n" + "\n".join(facts) + f"\n\n> {quoted}\n")
    return "\n".join(parts) + "\n"
