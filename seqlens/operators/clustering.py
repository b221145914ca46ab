"""Average-linkage clusters cut at a height, and members that stand apart from their label.

Every merge of average linkage below a height joins clusters whose closest pair is no farther, so a cut's clusters lie inside
the components of the graph of pairs within that height; each component is linked on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions import fixed
from seqlens.operators import distance, linkage, relational, setjoin
from seqlens.operators.components import checkpointed, connected_components


def clusters(ids: DataFrame, pairs: DataFrame, cuts: dict[str, float], far: float = 1.0) -> DataFrame:
    """id and for each cut the least id of the id's cluster. pairs: all distances (id_a < id_b) that are less than far.

    Each component of the pairs within the greatest cut is linked on its own; what is in none is alone."""
    most = max(cuts.values())
    component = checkpointed(connected_components(pairs.where(F.col("d") <= most).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))))
    a = component.select(F.col("node").alias("id_a"), "component")
    b = component.select(F.col("node").alias("id_b"), F.col("component").alias("cb"))
    inner = checkpointed(pairs.join(a, "id_a").join(b, "id_b").where("component = cb").select("component", "id_a", "id_b", "d"))
    found = linkage.linked(component.select(F.col("node").alias("id"), "component", F.lit(1).cast("long").alias("weight")), inner, cuts, far)
    return ids.select("id").join(found, "id", "left").select("id", *[F.coalesce(c, "id").alias(c) for c in cuts])


def novel_groups(rows: DataFrame, k: int = fixed.KMER, cutoff: float = fixed.NOVEL_CUTOFF, min_size: int = fixed.NOVEL_MIN_SIZE) -> DataFrame:
    """id, label, size of rows (id, seq): novel_1, novel_2 ... by falling size (ties: the one with the least id) for groups of min_size at least, else ST_unassigned.

    Groups are average-linkage clusters of the k-mer sets, cut at the cutoff."""
    own = setjoin.clusters(rows, k, {"cluster": cutoff})
    sized = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = relational.ranked(sized.where(F.col("size") >= min_size), [F.desc("size"), F.asc("cluster")], "rank")
    label = F.when(F.col("rank").isNotNull(), F.concat(F.lit("novel_"), F.col("rank").cast("string"))).otherwise(F.lit("ST_unassigned"))
    return own.join(sized, "cluster").join(ranked.select("cluster", "rank"), "cluster", "left").select("id", label.alias("label"), F.when(F.col("rank").isNotNull(), F.col("size")).alias("size"))


def novel_reason(label: str, size: str, cutoff: float = fixed.NOVEL_CUTOFF) -> F.Column:
    grouped = F.concat(F.lit("clustered with "), F.col(size).cast("string"), F.lit(f" other unplaced records at Jaccard d<{cutoff}"))
    return F.when(F.col(label).startswith("novel_"), grouped).otherwise(F.lit("no source ST tag, >max-placement-dist from all seeds, and no coherent novel cluster"))


def outliers(labels: DataFrame, pairs: DataFrame, multiplier: float = fixed.OUTLIER_MULTIPLIER, variant_cut: float = fixed.CLUSTER_CUTS["cluster_variant"]) -> DataFrame:
    """id, dist_from_medoid, potential_novel_variant, novel_variant_reason. labels has id, label, cluster.

    A member of a label of three or more stands apart if it is farther from the medoid than multiplier times the label's median
    distance (0.002 at least) and than twice the finest cut, or if it isn't in the cluster that holds over 0.6 of its label. Labels that are Unknown or smaller have
    no distance and nobody apart."""
    sized = labels.where("label <> 'Unknown'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    own = labels.join(sized, "label")
    inner = checkpointed(distance.labelled(pairs, own.select("id", "label")).where("same").select("label_a", "id_a", "id_b", "d"))
    medoid = checkpointed(distance.medoids_within(inner).select("label", "medoid"))
    median = relational.quantiles(inner.select(F.col("label_a").alias("label"), "d"), ["label"], "d", {"median": 0.5}).drop("n")
    by_cluster = own.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("m"))
    dominant = by_cluster.groupBy("label").agg(F.min_by("cluster", F.struct(-F.col("m"), F.col("cluster"))).alias("dominant"), (F.max("m") / F.sum("m")).alias("share"))
    ends = inner.join(medoid, inner["label_a"] == medoid["label"]).where("medoid IN (id_a, id_b)")
    to_medoid = ends.select(F.when(F.col("id_a") == F.col("medoid"), F.col("id_b")).otherwise(F.col("id_a")).alias("id"), "medoid", "d")
    facts = own.join(medoid, "label").join(median, "label").join(dominant, "label").join(to_medoid, ["id", "medoid"], "left")
    d = F.when(F.col("id") == F.col("medoid"), 0.0).otherwise(F.col("d"))
    cutoff = F.greatest(F.lit(multiplier) * F.greatest(F.col("median"), F.lit(fixed.OUTLIER_FLOOR)), F.lit(2 * variant_cut))
    far = F.when(d > cutoff, F.concat(F.lit("d_medoid="), F.format_string("%.4f", d), F.lit(" > "), F.format_string("%.4f", cutoff)))
    minor = F.when((F.col("cluster") != F.col("dominant")) & (F.col("share") > fixed.DOMINANT_SHARE), F.concat(F.lit("minority cluster ("), F.col("cluster").cast("string"), F.lit(")")))
    told = facts.select("id", d.alias("dist_from_medoid"), F.concat_ws("; ", far, minor).alias("reason"))
    out = labels.select("id").join(told, "id", "left")
    return out.select("id", "dist_from_medoid", (F.coalesce("reason", F.lit("")) != "").alias("potential_novel_variant"), F.coalesce("reason", F.lit("")).alias("novel_variant_reason"))
