"""Writers: FASTA by label, tables, distance matrices, run configurations, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta_text(header: Column, seq: Column, width: int = 60) -> Column:
    """A record's lines."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", ""))


def write_fasta(rows: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    rows.select(fasta_text(F.col(header), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_fasta_by_label(rows: DataFrame, path: str, label: str = "label", header: str = "header", seq: str = "seq") -> None:
    """A folder for each label; those of labels that are gone are removed."""
    rows.select(F.col(label).alias("label"), fasta_text(F.col(header), F.col(seq)).alias("value")).write.partitionBy("label").mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").options(header=True, escape='"').format(fmt).save(path)


def write_distances(pairs: DataFrame, path: str, decimals: int = 5) -> None:
    """The distance table, rounded; the pairs are the matrix."""
    pairs.select("id_a", "id_b", F.round("d", decimals).alias("d")).write.mode("overwrite").parquet(path)


def run_config(rows: DataFrame, version: str, arguments: dict[str, str], started: str, label: str = "subtype") -> DataFrame:
    """config: one JSON document of a run's arguments and counts."""
    args = F.create_map(*[F.lit(str(x)) for kv in arguments.items() for x in kv]) if arguments else F.create_map().cast("map<string,string>")
    facts = rows.agg(F.count(F.lit(1)).alias("n_sequences"), F.count_distinct(label).alias("n_subtypes"))
    return facts.select(F.to_json(F.struct(F.lit(version).alias("version"), args.alias("args"), "n_sequences", "n_subtypes", F.lit(started).alias("started"))).alias("config"))


def write_text(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)
