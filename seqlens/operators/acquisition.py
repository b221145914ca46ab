"""The two older passes of acquisition, label by label and then at large, and runs that go on from their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions import fixed, metadata
from seqlens.operators import curation, relational, similarity
from seqlens.operators.components import checkpointed
from seqlens.sources import readers


def narrow_pass(records: DataFrame, label: str, genus: str, validate: bool = True, retrieved: str = "") -> DataFrame:
    """The provenance rows, with ord and seq, of the records that a search for a label finds and whose own claim doesn't contradict it.

    Without validation all that is found stays, as unchecked."""
    title = F.col("description")
    gene = readers.contains_any(title, readers.NARROW_TITLE) | readers.contains_any(F.col("name"), readers.NARROW_ANYWHERE)
    found = records.where(readers.contains_any(title, readers.label_titles(label)) & gene & ~readers.contains_any(title, readers.NOT_IN_TITLE[:4]))
    if validate:
        declared = metadata.declared_labels(F.col("features"), F.col("name"), F.col("description"), genus)
        found = found.withColumn("_v", metadata.validate_claim(declared, F.lit(label))).where("_v.keep")
        confidence, reason = F.col("_v.confidence"), F.col("_v.reason")
    else:
        confidence, reason = F.lit("unchecked"), F.lit("validation disabled")
    told = found.withColumns({"source": F.lit("pass1_narrow"), "query": F.lit(readers.narrow_query(genus, label))})
    return told.select("ord", "seq", *curation.manifest_row(genus, F.lit(label), confidence, reason, F.lit(retrieved)))


def second_pass(first: DataFrame, references: DataFrame, broad: DataFrame, genus: str, min_length: int = fixed.MIN_LENGTH, max_length: int = fixed.MAX_LENGTH, max_dist: float = fixed.PLACEMENT_REJECT, retrieved: str = "") -> DataFrame:
    """What references and a broad search add to a first pass (provenance rows with ord and seq): provenance rows with ord and seq.

    References get their curated labels; what the broad search finds beyond both is placed among the first pass and the references. Records that
    the first pass has, by accession with or without its version or by content, go; of equal contents a reference stays before a placed record,
    and the first by ord."""
    first = checkpointed(first)
    bare = metadata.bare_accession(F.col("accession"))
    known = metadata.literal_map(fixed.CURATED_LABELS)
    label = F.coalesce(F.try_element_at(known, F.col("accession")), F.try_element_at(known, bare))
    new = lambda rows: relational.without_known(curation.length_filter(rows, min_length, max_length), first.select("accession"), "accession")
    refs = checkpointed(new(references).withColumn("label", label).where("label IS NOT NULL"))
    seeds = first.select(F.col("accession").alias("id"), "seq", F.col("subtype").alias("label")).unionByName(refs.select(F.col("accession").alias("id"), "seq", "label"))
    unseen = new(broad).where(label.isNull()).join(refs.select("accession"), "accession", "left_anti").withColumn("_md5", metadata.content_hash(F.col("seq")))
    unseen = unseen.join(first.select(F.col("md5").alias("_md5")).distinct(), "_md5", "left_anti")
    # equal contents are placed alike, so the first stands for all
    head = relational.first_per_key(unseen.where("accession IS NOT NULL").select("ord", "accession", "_md5"), ["_md5"], ["ord"]).toDF("_ord", "_accession", "_md5")
    rest = checkpointed(unseen.join(head.drop("_md5"), unseen["ord"].eqNullSafe(head["_ord"]) & (unseen["accession"] == head["_accession"]), "left_semi").drop("_md5"))
    placed = similarity.place(rest.select(F.col("accession").alias("id"), "seq"), seeds, max_dist=max_dist).where("assigned <> 'Unplaced'")
    found = rest.drop("label", "confidence").join(placed.withColumnRenamed("id", "accession"), "accession")
    row = lambda rows, p, source, query, shown, confidence, reason: rows.withColumns({"source": F.lit(source), "query": F.lit(query)}).select(F.lit(p).alias("_p"), "ord", "seq", *curation.manifest_row(genus, shown, confidence, reason, F.lit(retrieved)))
    added = row(refs, 0, "pass2_reference", "REFERENCE_LOOKUP", F.col("label"), F.lit("curated_reference"), F.concat(F.lit("literature-curated reference (mapped to "), F.col("label"), F.lit(")")))
    more = row(found, 1, "pass2_placement", readers.broad_query(genus), F.col("assigned"), F.col("confidence"), F.concat(F.lit("placement_"), F.col("confidence"), F.format_string(" (d=%.3f)", "d")))
    fresh = added.unionByName(more).join(first.select("md5").distinct(), "md5", "left_anti").select(*added.columns)
    return relational.first_per_key(fresh, ["md5"], ["_p", "ord"]).drop("_p")


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; if there is none, or none that was written to its end, what make() gives is written there first.

    So a run whose steps are each resumed goes on where an earlier one stopped."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
