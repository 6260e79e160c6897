"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Candidates are found in every whole text by regular expressions. The hash of each candidate's value is then counted
over the corpus: in how many repositories (source and language) and by how many owners (source) it occurs. Values that
many owners share are copied examples; values of one owner that look random are taken as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, table, written

#: Fixed: kind, pattern, group that holds the value, least length of that group.
BASE_KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the base kinds miss: long mixed strings, kept as spans only where they look live.
EXTRA_KIND = ("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: Matches of a text whose places are summed up at a time.
PART = 64
#: A value that so many owners have is a copied example.
SHARED_OWNERS = 3


def occurrences(text: Column, kind: int, name: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, name, value>> of the matches, leftmost and non-overlapping, whose group is long enough.

    The texts between matches and the matches alternate, so their lengths give the places, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    # arrays are copied when they grow: a part of the matches at a time, then the parts
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.array_append(acc["all"], acc["at"] + x["g"]).alias("all"))
    part = lambda at, i: F.aggregate(F.slice(lengths, i * PART + 1, F.lit(PART)), F.struct(at.alias("at"), F.array().cast("array<int>").alias("all")), step)
    grown = lambda acc, p: F.struct(p["at"].alias("at"), F.array_append(acc["all"], p["all"]).alias("all"))
    parts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
    starts = F.aggregate(parts, none, lambda acc, i: grown(acc, part(acc["at"], i)), lambda acc: F.flatten(acc["all"]))
    spans = F.transform(
        F.arrays_zip(starts.alias("s"), found.alias("m"), values.alias("v")),
        lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(name).alias("name"), x["v"].alias("value")),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,name:string,value:string>>")
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: F.length(x["value"]) >= least)).otherwise(empty)


def live_looking(value: Column) -> Column:
    """Letters and digits that change often, as random keys have and words or numbers have not."""
    letters, digits = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(F.regexp_replace(value, "[^0-9]", ""))
    turns = F.regexp_count(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"))
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (letters >= 4) & (digits >= 3) & (turns >= 3) & (kinds >= 10)


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repository, and the base and extra candidates of each row. A null text counts as empty, a null source as ''."""
    text = F.coalesce("text", F.lit(""))
    per_kind = [occurrences(text, i, *k) for i, k in enumerate(BASE_KINDS)]
    extra = occurrences(text, len(BASE_KINDS), *EXTRA_KIND)
    owner = F.coalesce("source", F.lit(""))
    found = docs.select("doc_id", owner.alias("owner"), F.concat_ws("/", owner, F.coalesce("lang", F.lit(""))).alias("repository"), F.array_sort(F.concat(*per_kind)).alias("base"), extra.alias("extra"))
    apart = F.filter("extra", lambda x: live_looking(x["value"]) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.withColumn("extra", apart)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_repositories, n_owners, n_places of each candidate value.

    Summed per value, repository and owner before anything is counted by value, so a value that a third of the corpus
    holds reaches the last step as one row for each repository.
    """
    local = candidates.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("n"))
    return local.groupBy("value_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n_places"))


def secrets(docs: DataFrame, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """One row for each row of docs: spans, counts of shared and of owner-specific values, and of those that look live.

    An extra candidate becomes a span if it looks live and fewer than shared_owners owners have it. Rows with no
    candidate have empty spans. Repeated rows are each scanned; rows of a null doc_id keep it. An empty table gives none. Columns
    other than doc_id, text, lang and source are not read. A value that very many places share is joined by a broadcast.
    """
    found = written(scan(docs).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    every = found.select("_row", "repository", "owner", F.explode(F.concat("base", "extra")).alias("x"))
    every = every.select("_row", "repository", "owner", "x", F.sha2("x.value", 256).alias("value_hash"), live_looking(F.col("x.value")).alias("live"))
    counts = written(ownership(every).withColumnRenamed("n_places", "copies"), "owners")
    total = counts.agg(F.sum("copies")).first()[0] or 0
    judged = met(every, counts, "value_hash", total).withColumn("shared", F.col("n_owners") >= shared_owners)
    kept = F.when((F.col("x.kind") < len(BASE_KINDS)) | ~F.col("shared"), F.col("x"))
    by_row = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(kept)).alias("spans"),
        F.count_if("shared").alias("n_shared"),
        F.count_if(~F.col("shared")).alias("n_owner_specific"),
        F.count_if(~F.col("shared") & F.col("live")).alias("n_live"),
    )
    return found.join(by_row.hint("merge"), "_row", "left").select(
        "doc_id", "base", F.coalesce("spans", F.array().cast(found.schema["base"].dataType)).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_owner_specific", "n_live")]
    )


def query_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["name"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k[0]) for k in BASE_KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_shared", "n_owner_specific", "n_live")
