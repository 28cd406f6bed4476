"""Readers and writers: CSV and JSONL corpora with row numbers, link and citation exports, corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import settled


def read_csv(spark: SparkSession, path: str, columns: list[str], malformed: bool = False) -> DataFrame:
    """All-string columns; quoted fields may span lines; bad rows are dropped unless `malformed` keeps what can be read."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("mode", "PERMISSIVE" if malformed else "DROPMALFORMED").csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Objects of a JSONL file; blank, malformed and non-object lines are left out."""
    line = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull()).select(line.alias("r")).select("r.*")


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Gapless row numbers in the order of files: partition counts first, then an offset to each; no global sort.

    The rows are settled with their place first, so a plan that is run again gives the same numbers.
    """
    spark = df.sparkSession
    p = settled(df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = {r["_p"]: r["n"] for r in p.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a number a partition
    at, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p int, _s long")
    return p.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """line_no, and the object's fields: objects of a JSONL file with their physical line, from 1; other lines are left out."""
    lines = numbered(spark.read.text(path), "line_no").withColumn("line_no", F.col("line_no") + 1)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    ok = lines.where(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull())
    return ok.select("line_no", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r")).select("line_no", "r.*")


def graph_of(rows: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus: what rows cite, parsed out of their text. rows: citation, text, row_no. Origin bit 1 for rows, 2 for what is only cited."""
    from ..functions import parsers as P
    from ..operators.graph import distinct_edges, merge_nodes

    refs = rows.select(F.col("citation").alias("source"), F.explode(P.all_references("text")).alias("r")).select("source", F.col("r.citation").alias("target"))
    edges = distinct_edges(refs)
    own = rows.select("citation", F.lit(1).alias("origin_mask"), "row_no", F.col("row_no").alias("seq"))
    none = F.lit(None).cast("long")
    said = edges.select(F.col("target").alias("citation"), F.lit(2).alias("origin_mask"), none.alias("row_no"), none.alias("seq"))
    return merge_nodes(own.unionByName(said), ["citation"], "seq").withColumn("dataset", F.lit(dataset)), edges


def classified(nodes: DataFrame) -> DataFrame:
    """Nodes with what their citation is and its parts, parsed anew whatever a file said."""
    from ..functions import parsers as P

    rest = [c for c in nodes.columns if c != "citation"]
    return nodes.select("citation", *rest, P.classified(F.col("citation")).alias("x")).select("citation", *rest, "x.family", "x.subfamily", F.struct(*[f"x.{c}" for c in P.REFERENCE.names if c not in ("citation", "family", "subfamily")]).alias("segments"))


def write_classified(nodes: DataFrame, path: str) -> None:
    classified(nodes).write.mode("errorifexists").json(path)


def segment_table(classified_: DataFrame) -> DataFrame:
    """One flat row a citation of the corpus itself (origin bit 1) with all its parts."""
    own = classified_.where(F.col("origin_mask").bitwiseAND(F.lit(1)) == 1)
    return own.select("citation", "family", "subfamily", "segments.*").withColumn("units", F.array_join(F.transform("units", lambda u: F.concat_ws(" ", u["marker"], u["value"])), " "))


def picked(rows: DataFrame, ids: DataFrame, key: str, columns: list[str], other: DataFrame | None = None) -> DataFrame:
    """The rows of a set of ids, some columns of them, with those of another source where it has the id."""
    out = rows.join(ids.select(key).distinct(), key, "left_semi").select(key, *columns)
    return out if other is None else out.join(other.dropDuplicates([key]), key, "left")


def targets(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of a JSONL or JSON array file of targets, the first `limit` in file order if one is given."""
    rows = spark.read.schema(schema).json(path, multiLine=not path.endswith(".jsonl"))
    return rows if limit is None else numbered(rows).where(F.col("row_no") < limit).drop("row_no")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an exported table of adjacency lists."""
    return spark.read.schema("source string, references array<string>").json(path).select("source", F.explode("references").alias("target"))


def write_split_csv(df: DataFrame, path: str, rows: int) -> None:
    """CSV files of at most so many rows, each with a header."""
    df.write.mode("errorifexists").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def write_postings(postings: DataFrame, lengths: DataFrame, path: str, parts: int) -> None:
    """An index as tables: postings dealt and sorted by term, so a query's terms read few files; document lengths."""
    postings.repartitionByRange(parts, "term").sortWithinPartitions("term", "doc_id").write.mode("errorifexists").parquet(f"{path}/postings")
    lengths.write.mode("errorifexists").parquet(f"{path}/lengths")


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of an index; with terms, those alone, found by the files' statistics."""
    p = spark.read.parquet(f"{path}/postings")
    return (p.where(F.col("term").isin(terms)) if terms else p), spark.read.parquet(f"{path}/lengths")


def export_citations(nodes: DataFrame, path: str) -> None:
    """All citations in order, as one sorted table in ranges, and beside it one row of counts."""
    unique = nodes.select("citation").distinct()
    unique.orderBy("citation").write.mode("errorifexists").json(f"{path}/citations")
    unique.agg(F.count("*").alias("citations")).coalesce(1).write.mode("errorifexists").json(f"{path}/counts")


def expanded_lists(df: DataFrame, key: str, column: str, children: DataFrame, sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """(df with a list column whose items are replaced by their children, counts of what happened). children: article, child."""
    items = expand_list(df.select(key, column), column, sep)
    j = items.join(children, F.col("item") == F.col("article"), "left")
    out = j.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("child", "item").alias("item")))), lambda x: x["item"])).alias("_l"))
    stats = j.agg(F.count_distinct(key, "pos").alias("items"), F.count_distinct(F.when(F.col("child").isNotNull(), F.struct(key, "pos"))).alias("expanded"), F.count("*").alias("rows"))
    return df.join(out, key, "left").select(*[F.array_join("_l", sep).alias(c) if c == column else F.col(c) for c in df.columns]), stats


def chunk(df: DataFrame, number: str, chunks: int, index: int) -> DataFrame:
    return df.where(F.pmod(F.col(number), F.lit(chunks)) == index)


def write_unique(nodes: DataFrame, path: str) -> None:
    nodes.select("citation").distinct().orderBy("citation").write.mode("errorifexists").json(path)


def write_links(edges: DataFrame, path: str) -> None:
    from ..operators.graph import adjacency

    adjacency(edges).write.mode("errorifexists").json(path)


def write_corpus(docs: DataFrame, path: str, force: bool = False) -> None:
    """Documents by family, and one table a link array: statute_links, case_links."""
    mode = "overwrite" if force else "errorifexists"
    docs.write.mode(mode).partitionBy("family").parquet(f"{path}/documents")
    for c in ("statute_links", "case_links", "adjacent_law_links"):
        if c in docs.columns:
            docs.select("doc_id", F.explode(c).alias("target")).write.mode(mode).parquet(f"{path}/{c}")


def embedding_input(docs: DataFrame, families: list[str] | None = None) -> DataFrame:
    d = docs.where(F.col("family").isin(families)) if families else docs
    return d.select("doc_id", "family", "citation", "vector_text", F.length("vector_text").alias("char_len")).orderBy("family", "doc_id")


def expand_list(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """A list column as rows with their position."""
    return df.select("*", F.posexplode(F.split(column, sep)).alias("pos", "item")).withColumn("item", F.trim("item")).where("item <> ''")


def overlay(base: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`base` with the update's values where it has any; the last of several updates of a key wins (column seq)."""
    last = update.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("_u")).select(key, "_u")
    j = base.join(last, key, "left")
    return j.select(*[F.coalesce(F.col("_u")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
