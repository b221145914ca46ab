"""From records to labelled, deduplicated ones with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqlens.functions import fixed, metadata
from seqlens.operators import clustering, relational, similarity
from seqlens.operators.components import checkpointed


def registry(spark: SparkSession) -> DataFrame:
    """label, status, human, note."""
    return spark.createDataFrame([(a, b, c == "yes", d) for a, b, c, d in fixed.REGISTRY], "label string, status string, human boolean, note string")


def curated(spark: SparkSession) -> DataFrame:
    """accession, label."""
    return spark.createDataFrame(list(fixed.CURATED_LABELS.items()), "accession string, label string")


def selected_labels(labels: str = "", contested: bool = False, statuses: str = "") -> list[str]:
    """The labels to work on: those named, else all but the avian ones, contested ones only if asked for, of these statuses."""
    if labels:
        return [x.strip().upper() for x in labels.split(",")]
    allowed = {x.strip().lower() for x in statuses.split(",")} if statuses else None
    return [a for a, s, _, _ in fixed.REGISTRY if not a.startswith("NMAST") and (contested or s != "contested") and (allowed is None or s in allowed)]


def enriched(rows: DataFrame, label: str = "subtype") -> DataFrame:
    """rows with st_status, human_report and st_note of their label."""
    reg = F.broadcast(registry(rows.sparkSession).select(F.col("label").alias(label), "status", "human", "note"))  # 52 rows
    status = F.when(F.col(label).startswith("novel_"), "novel").when(F.col(label) == "ST_unassigned", "unassigned").otherwise(F.coalesce("status", F.lit("unknown")))
    joined = rows.join(reg, label, "left")
    return joined.select(*rows.columns, status.alias("st_status"), F.coalesce("human", F.lit(False)).alias("human_report"), F.coalesce("note", F.lit("")).alias("st_note"))


def quality_filter(records: DataFrame) -> DataFrame:
    """Records that are neither predicted nor of a molecule type that is no gene."""
    return records.where(metadata.drop_reason(F.col("accession"), F.col("features")).isNull())


def drop_report(records: DataFrame, examples: int = 5) -> DataFrame:
    """reason, n, examples: how many records each reason drops, and the first few."""
    told = records.select("ord", "accession", metadata.drop_reason(F.col("accession"), F.col("features")).alias("reason")).where("reason IS NOT NULL")
    first = F.slice(F.sort_array(F.collect_list(F.struct("ord", "accession"))), 1, examples)
    ranked = told.withColumn("r", F.row_number().over(relational.Window.partitionBy("reason").orderBy("ord"))).where(F.col("r") <= examples)
    return relational.counts(told, "reason").join(ranked.groupBy("reason").agg(F.transform(first, lambda x: x["accession"]).alias("examples")), "reason")


def length_filter(records: DataFrame, low: int = fixed.MIN_LENGTH, high: int = fixed.MAX_LENGTH) -> DataFrame:
    return records.where(F.length("seq").between(low, high))


def metadata_columns(genus: str) -> dict[str, Column]:
    """The metadata of a record, by name."""
    features = F.col("features")
    source = metadata.first_source(features)
    names = ("structured_comment", "comment", "features", "description", "name")
    host = metadata.coalesce_host(features, F.col("organism"), genus)
    return {
        "host": metadata.normalise_host(host["host"], genus),
        "host_source": host["host_source"],
        "country": metadata.country(metadata.qualifier(source, "geo_loc_name"), metadata.qualifier(source, "country")),
        "collection_date": F.coalesce(metadata.qualifier(source, "collection_date"), F.lit(metadata.UNKNOWN)),
        "isolation_source": F.coalesce(metadata.qualifier(source, "isolation_source"), F.lit(metadata.UNKNOWN)),
        "seq_tech": metadata.technology(metadata.technology_text({n: F.col(n) for n in names})),
        "md5": metadata.content_hash(F.col("seq")),
        "length": F.length("seq").cast("bigint"),
    }


def labelled(records: DataFrame, genus: str, validate: bool = True) -> DataFrame:
    """records with label, confidence, reason: by the curated accessions (only for records fetched as such), else by what they declare; null if by neither.

    Without validation sole labels are "unchecked", which makes them no seeds."""
    declared = metadata.declared_labels(F.col("features"), F.col("name"), F.col("description"), genus)
    records = records.withColumn("_own", metadata.label_of(declared))
    own = F.col("_own")
    known = metadata.literal_map(fixed.CURATED_LABELS)
    by_curation = F.coalesce(F.try_element_at(known, metadata.bare_accession(F.col("accession"))), F.try_element_at(known, F.col("accession")))
    curated_row = F.col("source") == "curated_reference"
    confidence = F.when(curated_row, F.lit("curated_reference")).when(own["confidence"] == "high", F.lit("high" if validate else "unchecked")).otherwise(own["confidence"])
    out = records.withColumn("label", F.when(curated_row, by_curation).otherwise(own["label"])).withColumn("confidence", confidence)
    return out.where(~curated_row | F.col("label").isNotNull()).drop("_own")


def seeds(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("confidence").isin("high", "curated_reference"))


def manifest_row(genus: str, label: Column, confidence: Column, reason: Column, retrieved: Column) -> list[Column]:
    """The columns of the provenance table, in order."""
    m = metadata_columns(genus)
    made = {"accession": F.col("accession"), "subtype": label, "length": m["length"], "md5": m["md5"], "host": m["host"], "host_source": m["host_source"], "country": m["country"], "collection_date": m["collection_date"], "isolation_source": m["isolation_source"], "seq_tech": m["seq_tech"], "st_confidence": confidence, "st_validation": reason, "acquisition_pass": F.col("source"), "retrieved_at_utc": retrieved, "ncbi_query": F.col("query")}
    return [c.alias(n) for n, c in made.items()]


def deduplicated(rows: DataFrame, hash_col: str = "md5", order: str = "ord") -> DataFrame:
    """The first row of each content hash; rows without one go."""
    return relational.first_per_key(rows.where(F.col(hash_col).isNotNull()), [hash_col], [order])


def deduplicated_within(rows: DataFrame, label: str = "label", seq: str = "seq", order: str = "ord") -> DataFrame:
    """The first row of each gapless sequence within its label."""
    keyed = rows.withColumn("_s", F.md5(F.translate(F.upper(seq), "-", "")))
    return relational.first_per_key(keyed, [label, "_s"], [order]).select(*rows.columns)


class StepCounts:
    """How many records each step of a run has seen, counted while the run's result is written: nothing is computed a second time.

    A step is an Observation on a plan's rows; its numbers are there once an action over all of them has ended, such as a write. Actions that stop early (limit, first) and
    branches that run more than once give numbers of what they saw."""

    def __init__(self) -> None:
        self.steps: dict[str, Observation] = {}

    def of(self, name: str, rows: DataFrame, **more: Column) -> DataFrame:
        """rows, of which the number and more counts of conditions are observed as a step."""
        self.steps[name] = Observation(name)
        return rows.observe(self.steps[name], F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in more.items()])

    def found(self) -> list[tuple[str, str, int]]:
        """(step, what, number) in order of the steps; waits for the action that runs them."""
        return [(name, what, n) for name, seen in self.steps.items() for what, n in seen.get.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.found(), "step string, what string, n long")


def prepared(records: DataFrame, genus: str, min_length: int = fixed.MIN_LENGTH, max_length: int = fixed.MAX_LENGTH, counts: StepCounts | None = None) -> DataFrame:
    """labelled() of the records that the quality and the length filter keep. counts: gets what each step drops, by reason."""
    if counts is None:
        return labelled(length_filter(quality_filter(records), min_length, max_length), genus)
    reason = metadata.drop_reason(F.col("accession"), F.col("features"))
    told = counts.of("read", records.withColumn("_reason", reason), predicted=F.col("_reason") == "predicted", molecule_type=F.col("_reason") == "molecule_type")
    good = told.where("_reason IS NULL").drop("_reason")
    sized = counts.of("quality", good, too_short=F.length("seq") < min_length, too_long=F.length("seq") > max_length)
    by_source = {"curated": F.col("source") == "curated_reference"}
    rows = labelled(counts.of("length", length_filter(sized, min_length, max_length), **by_source), genus)
    return counts.of("labelled", rows, declared=F.col("label").isNotNull(), undeclared=F.col("label").isNull(), seeds=F.col("confidence").isin("high", "curated_reference"))


def curate(records: DataFrame, genus: str, min_length: int = fixed.MIN_LENGTH, max_length: int = fixed.MAX_LENGTH, retrieved: str = "", counts: StepCounts | None = None) -> DataFrame:
    """The provenance table of records: filtered, labelled by declaration, placement or cluster, and deduplicated over all labels.

    What the labelling starts from is written once, as five steps read it. counts: gets the numbers of each step up to there, and of what placement and
    clustering decide."""
    rows = checkpointed(prepared(records, genus, min_length, max_length, counts))
    known = rows.where("label IS NOT NULL").withColumn("reason", F.concat(F.lit("declared; "), F.col("confidence")))
    unknown = rows.where("label IS NULL").drop("label", "confidence")
    as_seed = seeds(known).select(F.col("accession").alias("id"), "seq", "label")
    placed = similarity.place(unknown.select(F.col("accession").alias("id"), "seq"), as_seed)
    joined = unknown.join(placed.withColumnRenamed("id", "accession"), "accession")
    if counts is not None:
        joined = counts.of("placed", joined, **{k: F.col("confidence") == k for k in ("high", "medium", "low", "rejected")})
    joined = checkpointed(joined)
    hit = joined.where("confidence <> 'rejected'").withColumn("label", F.col("assigned")).withColumn("reason", F.concat(F.lit("placement_"), F.col("confidence"), F.format_string(" (d=%.3f)", "d")))
    left = joined.where("confidence = 'rejected'").drop("confidence")
    groups = clustering.novel_groups(left.select(F.col("accession").alias("id"), "seq"))
    novel = left.join(groups.withColumnRenamed("id", "accession"), "accession").withColumn("confidence", F.when(F.col("label").startswith("novel_"), "novel_cluster").otherwise("unplaced")).withColumn("reason", clustering.novel_reason("label", "size"))
    names = [*records.columns, "label", "confidence", "reason"]
    everything = known.select(*names, F.lit(0).alias("_p")).unionByName(hit.select(*names, F.lit(1).alias("_p"))).unionByName(novel.select(*names, F.lit(2).alias("_p")))
    made = everything.select("_p", "ord", *manifest_row(genus, F.col("label"), F.col("confidence"), F.col("reason"), F.lit(retrieved)))
    return relational.first_per_key(made, ["md5"], ["_p", "ord"]).drop("_p", "ord")
