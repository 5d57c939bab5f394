"""Parameter vectors that differ from a baseline in one layer: their profile, evidence, and what is decided from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio, reason_list
from panelwright.operators.states import WEAK_DELTA, nested_states, weak_state

#: Scale that makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


def q_registry(spark: SparkSession, layers: list[str], qs: list[float], base: float) -> DataFrame:
    """The baseline and every vector that changes one layer's q, one row each."""
    cells = [("BASELINE", base, "baseline")] + [(c, q, "nonbaseline") for c in layers for q in qs if q != base]
    rows = []
    for layer, q, role in cells:
        vector = [q if c == layer else base for c in layers]
        rows.append(("_".join(f"{c}{round(v * 100):02d}" for c, v in zip(layers, vector)), layer, q, role, *vector))
    return spark.createDataFrame(rows, "vector_id string, changed_layer string, changed_q double, role string, " + ", ".join(f"q{c} double" for c in layers))


def vectors(layers: list[str], qs: list[float], base: float) -> dict[str, dict[str, float]]:
    """Each vector of ``q_registry`` with its layers' q, the baseline first."""
    cells = [(layers[0], base)] + [(c, q) for c in layers for q in qs if q != base]
    each = [{c: q if c == layer else base for c in layers} for layer, q in cells]
    return {"_".join(f"{c}{round(v * 100):02d}" for c, v in one.items()): one for one in each}


def vector_days(wide: DataFrame, registry: DataFrame, layers: list[str], delta: float = WEAK_DELTA) -> DataFrame:
    """A row for each day and vector with its nested states; ``wide`` holds a row for each day with a struct of each dimension's scores."""
    keys = ["security_id", "trading_date"]
    out = wide.crossJoin(F.broadcast(registry))  # some rows a layer
    out = nested_states(out.select(*keys, *registry.columns, *[weak_state(F.col(f"q{c}"), delta, f"{c}.").alias(c) for c in layers]), layers)
    return out.select(*keys, *registry.columns, *layers, *[f"s{k + 1}" for k in range(len(layers))])


def yearly_counts(days: DataFrame, layers: list[str]) -> DataFrame:
    """Known and true days of every state by vector and year: a few rows a vector, from one pass over the days."""
    keys = ["vector_id", "changed_layer", "changed_q", "role"]
    states = [f"s{k + 1}" for k in range(len(layers))]
    cells = [F.struct(F.lit(s).alias("state"), F.count(s).alias("n_known"), F.count_if(F.col(s)).alias("n_true")) for s in states]
    out = days.groupBy(*keys, F.year("trading_date").alias("period")).agg(F.array(*cells).alias("cells"))
    return out.select(*keys, "period", F.explode("cells").alias("c")).select(*keys, "period", "c.*")


def affected(yearly: DataFrame, layers: list[str]) -> DataFrame:
    """Only the first state that a vector's changed layer takes part in (the baseline: the first of all)."""
    state = F.lit("s1")
    for k, c in enumerate(layers):
        state = F.when(F.col("changed_layer") == c, f"s{k + 1}").otherwise(state)
    return yearly.where(F.col("state") == state)


def coverage(yearly: DataFrame, by: list[str]) -> DataFrame:
    rows = yearly.groupBy(*by).agg(F.sum("n_known").alias("n_known"), F.sum("n_true").alias("n_true"))
    return rows.withColumn("coverage", ratio(F.col("n_true"), F.col("n_known")))


def envelopes(yearly: DataFrame, fallback: float) -> DataFrame:
    """(state, period, n_known, n_true) -> how far a state's coverage strays: the largest change when a year is left
    out, the scaled median absolute deviation of its years, or the fallback, whichever is largest."""
    w = Window.partitionBy("state")
    known, true = F.sum("n_known").over(w), F.sum("n_true").over(w)
    rows = yearly.withColumns({"pooled": ratio(true, known), "year": ratio(F.col("n_true"), F.col("n_known")), "without": ratio(true - F.col("n_true"), known - F.col("n_known"))})
    rows = rows.withColumn("_median", F.percentile("year", 0.5).over(w))
    out = rows.groupBy("state").agg(F.max("pooled").alias("pooled"), F.coalesce(F.max(F.abs(F.col("without") - F.col("pooled"))), F.lit(0.0)).alias("loyo"), F.coalesce(F.percentile(F.abs(F.col("year") - F.col("_median")), 0.5), F.lit(0.0)).alias("_mad"))
    return out.select("state", "pooled", "loyo", (F.col("_mad") * MAD_SCALE).alias("mad"), F.greatest("loyo", F.col("_mad") * MAD_SCALE, F.lit(fallback)).alias("envelope"))


def layer_impact(profile: DataFrame) -> DataFrame:
    """Span of the coverage over q for each layer, its rank, and a class (dominant: rank 1 and a span over 0.05; low: 0.01 at most)."""
    out = profile.where("role <> 'baseline'").groupBy("changed_layer").agg((F.max("coverage") - F.min("coverage")).alias("span"), F.count("*").alias("n_vectors"))
    place = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("span")))  # a row a layer
    return out.withColumn("place", place).withColumn("impact", F.when((F.col("place") == 1) & (F.col("span") > 0.05), "dominant").when(F.col("span") <= 0.01, "low").otherwise("moderate"))


def evidence(profile: DataFrame, bounds: DataFrame) -> DataFrame:
    """Vectors against the baseline's coverage of the same state: change, whether it leaves the envelope, and whether
    the nearest vectors of the layer on both sides change in the same direction."""
    out = profile.where("role <> 'baseline'").join(F.broadcast(bounds), "state")  # a row a state
    out = out.withColumn("change", F.col("coverage") - F.col("pooled"))
    out = out.withColumns({"improves": F.col("change") > F.col("envelope"), "degrades": F.col("change") < -F.col("envelope")})
    w = Window.partitionBy("changed_layer").orderBy("changed_q")
    same = lambda other: F.coalesce(F.sign(other) == F.sign("change"), F.lit(True))
    out = out.withColumn("supported", same(F.lag("change").over(w)) & same(F.lead("change").over(w)))
    return out.withColumn("dominance", F.when(F.col("degrades"), "baseline_dominates").when(F.col("improves"), "tradeoff_not_dominated").otherwise("equivalent"))


def requests(found: DataFrame, floor: int) -> DataFrame:
    """Centres (most true days of a layer, at least ``floor``) and their immediate neighbours in q."""
    w = Window.partitionBy("changed_layer").orderBy("changed_q")
    best = F.row_number().over(Window.partitionBy("changed_layer").orderBy(F.desc("n_true"), "vector_id"))
    out = found.withColumn("_centre", (best == 1) & (F.col("n_true") >= floor))
    beside = F.coalesce(F.lag("_centre").over(w), F.lit(False)) | F.coalesce(F.lead("_centre").over(w), F.lit(False))
    out = out.withColumn("request_role", F.when(F.col("_centre"), "center").when(beside, "immediate_neighbor"))
    return out.where("request_role is not null").drop("_centre")


def recommend(found: DataFrame, floor: int, base: float) -> DataFrame:
    """For each layer the first passing vector by warnings, distance to the baseline and id."""
    warnings = (~F.col("supported")).cast("int") + (F.col("dominance") == "baseline_dominates").cast("int")
    rows = found.where(F.col("n_true") >= floor).withColumns({"warnings": warnings, "distance": F.round(F.abs(F.col("changed_q") - base), 6)})
    best = rows.groupBy("changed_layer").agg(F.min_by(F.struct("vector_id", "warnings", "distance"), F.struct("warnings", "distance", "vector_id")).alias("b"), F.count("*").alias("n_passing"))
    out = found.select("changed_layer").distinct().join(best, "changed_layer", "left")
    return out.select("changed_layer", F.when(F.col("b").isNull(), "no_pass").otherwise("recommended").alias("status"), F.col("b.vector_id").alias("recommended"), F.col("b.warnings").alias("warnings"), F.col("b.distance").alias("distance"), F.coalesce("n_passing", F.lit(0)).alias("n_passing"))


def handoff(asked: DataFrame, floor: int) -> DataFrame:
    """Failed gates of each request and what follows from them and its role."""
    failed = reason_list(existence=F.col("n_true") < floor, neighborhood=~F.col("supported"), dominance=F.col("dominance") == "baseline_dominates")
    out = asked.withColumn("failed_gates", F.array_join(failed, ";"))
    return out.withColumn("handoff", F.when(F.col("failed_gates") != "", "do_not_freeze").when(F.col("request_role") == "center", "freeze_candidate").otherwise("review_candidate"))


def shortlist(handed: DataFrame) -> DataFrame:
    """One canonical row for each layer: frozen candidates before reviewed ones before none, then by true days."""
    order = F.when(F.col("handoff") == "freeze_candidate", 0).when(F.col("handoff") == "review_candidate", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("changed_layer").orderBy(order, F.desc("n_true"), "vector_id"))
    return handed.withColumn("place", place).withColumn("disposition", F.when(order == 2, "rejected").when(F.col("place") == 1, "canonical").otherwise("evidence"))


def decisions(found: DataFrame, floor: int, max_year_share: float, year_share: DataFrame) -> DataFrame:
    """Ladder of every vector: too few days, one year's work, isolated, dominated, prefer the baseline, else accept."""
    rows = found.join(year_share, "vector_id", "left")
    rung = (
        F.when(F.col("n_true") < floor, "insufficient").when(F.col("top_year_share") > max_year_share, "year_concentrated").when(~F.col("supported"), "isolated_peak")
        .when(F.col("degrades"), "baseline_dominates").when(~F.col("improves"), "prefer_baseline").otherwise("accept")
    )
    return rows.withColumn("decision", rung)
