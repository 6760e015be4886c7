"""Models over bar features with pyspark.ml: direction forests, meta-labels, regime mixture; binned mutual information."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import stored

Source = Callable[[SparkSession, str], DataFrame]
INPUTS = ["r1", "r5", "vol20", "rng", "vs20"]


def frame(bars: DataFrame) -> DataFrame:
    """Five causal inputs and the direction of the next bar; rows with a missing cell are dropped (models need all)."""
    w = Window.partitionBy("series").orderBy("us")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    b = bars.withColumn("r1", F.col("close") / F.lag("close").over(w) - 1)
    b = b.withColumns(
        {
            "r5": F.col("close") / F.lag("close", 5).over(w) - 1, "vol20": F.stddev_samp("r1").over(last(20)), "rng": (F.col("high") - F.col("low")) / F.col("close"),
            "vs20": F.col("close") / F.avg("close").over(last(20)) - 1, "next": F.lead("close").over(w) / F.col("close") - 1,
        }
    )
    ok = " and ".join(f"{c} is not null and abs({c}) < 1" for c in [*INPUTS, "next"])
    return b.where(ok).withColumn("y", (F.col("next") > 0).cast("double")).select("series", "us", *INPUTS, "next", "y")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier 70 percent of the time span trains, the rest tests."""
    cut = df.agg(F.percentile_approx("us", 0.7, 1000)).first()[0] or 0
    return df.where(F.col("us") <= cut), df.where(F.col("us") > cut)


def direction_models(source: Source) -> Source:
    """Held-out accuracy of a scaled L1 logistic model and of a forest, beside the majority and always-long baselines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        train, test = _split(frame(source(spark, sf_dir)))
        asm = VectorAssembler(inputCols=INPUTS, outputCol="raw")
        scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True)
        out = None
        for name, model in (
            ("logistic_l1", LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=0.001, maxIter=20)),
            ("forest", RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=10, maxDepth=4, seed=7)),
        ):
            scored = Pipeline(stages=[asm, scale, model]).fit(train).transform(test)
            row = scored.agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("model"), "accuracy", "n")
            out = row if out is None else out.unionByName(row)
        base = test.agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n"))
        return out.unionByName(base.select(F.lit("always_long").alias("model"), F.col("p").alias("accuracy"), "n")).unionByName(
            base.select(F.lit("majority").alias("model"), F.greatest("p", 1 - F.col("p")).alias("accuracy"), "n")
        )

    return run


def labelled(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Inputs with the barrier label (0 down, 1 neither, 2 up) and a weight: the class' inverse frequency over the least one,
    times the label's uniqueness where given."""
    f = frame(bars).join(labels, ["series", "us"]).where("label_i is not null").withColumn("label", F.col("label_i").cast("double"))
    counts = {r["label"]: r["n"] for r in f.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    top = max(counts.values(), default=1)
    by_class = F.lit(1.0)
    for k, n in counts.items():
        by_class = F.when(F.col("label") == k, top / n).otherwise(by_class)
    return f.withColumn("weight", by_class * F.coalesce(F.col("uniqueness"), F.lit(1.0)))


def _three_class(name: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    model = (
        RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=20, maxDepth=5, seed=7)
        if name == "forest"
        else LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=0.001, maxIter=20)
    )
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])


def three_class(source: Source, labels: Source) -> Source:
    """Confusion matrix of a forest and a multinomial L1 logistic model on the later part: model, label, predicted, rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _split(stored(labelled(source(spark, sf_dir), labels(spark, sf_dir))))
        out = None
        for name in ("forest", "logistic_l1"):
            part = _three_class(name).fit(train).transform(test).groupBy("label", F.col("prediction").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
            part = part.select(F.lit(name).alias("model"), "label", "predicted", "n")
            out = part if out is None else out.unionByName(part)
        return out

    return run


def meta_features(p: str) -> dict:
    """Greatest probability, those of up and down, margin between the two greatest, entropy; from an array of three."""
    a, order = F.col(p), F.sort_array(F.col(p), False)
    ent = F.aggregate(a, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return {"p_max": F.array_max(a), "p_up": a[2], "p_down": a[0], "margin": order[0] - order[1], "entropy": ent}


def meta_label(source: Source, labels: Source) -> Source:
    """A second model predicts whether the first is right where it says up or down, from five features of its
    probabilities; what each threshold of a grid keeps and how often that is right, on the last part of the time span."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        train, test = _split(stored(labelled(source(spark, sf_dir), labels(spark, sf_dir))))
        scored = _three_class("forest").fit(train).transform(test).withColumn("p", vector_to_array("probability")).where("prediction <> 1")
        meta = stored(scored.select("us", *(e.alias(n) for n, e in meta_features("p").items()), (F.col("prediction") == F.col("label")).cast("double").alias("right")))
        fit, last = _split(meta)
        gate = Pipeline(stages=[VectorAssembler(inputCols=list(meta_features("p")), outputCol="m"), LogisticRegression(featuresCol="m", labelCol="right", maxIter=10)]).fit(fit)
        grid = F.explode(F.array(*(F.lit(x / 100) for x in range(30, 66, 5)))).alias("threshold")
        kept = gate.transform(last).select("right", vector_to_array("probability")[1].alias("q"), grid).where("q >= threshold")
        return kept.groupBy("threshold").agg(F.count(F.lit(1)).alias("kept"), F.avg("right").alias("precision"))

    return run


def regime_mixture(source: Source) -> Source:
    """Three regimes by a Gaussian mixture on return, size of return and volatility, numbered by mean return."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        df = frame(source(spark, sf_dir)).withColumn("size", F.abs("r1"))
        stages = [VectorAssembler(inputCols=["r1", "size", "vol20"], outputCol="v"), StandardScaler(inputCol="v", outputCol="x"), GaussianMixture(featuresCol="x", k=3, seed=11, maxIter=10)]
        got = Pipeline(stages=stages).fit(df).transform(df)
        means = got.groupBy("prediction").agg(F.avg("r1").alias("m"), F.avg("vol20").alias("mean_volatility"), F.count(F.lit(1)).alias("bars"))
        return means.select((F.row_number().over(Window.orderBy("m")) - 1).alias("regime"), F.col("m").alias("mean_return"), "mean_volatility", "bars")

    return run


def mutual_information(source: Source, bins: int = 10) -> Source:
    """Binned mutual information of every input with next direction and with size of the next move, and its class."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frame(source(spark, sf_dir)).withColumn("move", F.abs("next"))
        cuts = df.agg(*(F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in [*INPUTS, "move"])).first()
        bucket = lambda c, q: sum(((F.col(c) > v).cast("int") for v in q), F.lit(0))
        t = df.select(
            F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), bucket(c, cuts[c]).alias("b")) for c in INPUTS))), F.col("y").cast("int").alias("dir"), bucket("move", cuts["move"]).alias("vol")
        )
        out = None
        for target in ("dir", "vol"):
            joint = t.groupBy("feature", "b", target).agg(F.count(F.lit(1)).alias("n"))
            tot, fb, ft = Window.partitionBy("feature"), Window.partitionBy("feature", "b"), Window.partitionBy("feature", target)
            n = F.sum("n").over(tot)
            mi = F.col("n") / n * F.log(F.col("n") * n / (F.sum("n").over(fb) * F.sum("n").over(ft)))
            got = joint.withColumn("mi", mi).groupBy("feature").agg(F.sum("mi").alias(f"mi_{target}"))
            out = got if out is None else out.join(got, "feature")
        ratio = F.col("mi_dir") / (F.col("mi_vol") + 1e-12)
        return out.withColumn("kind", F.when(F.col("mi_dir") + F.col("mi_vol") < 1e-3, "NOISE").when(ratio > 2, "DIRECTIONAL").when(ratio < 0.5, "VOLATILITY").otherwise("DUAL"))

    return run


def platt_blend(source: Source, share: float = 0.6) -> Source:
    """A forest's probability calibrated by a logistic model on held-back rows, blended with a second model's: accuracy and
    log loss of raw, calibrated and blended probabilities on the last rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        train, test = _split(frame(source(spark, sf_dir)))
        fit, held = _split(train)
        asm = VectorAssembler(inputCols=INPUTS, outputCol="x")
        forest = Pipeline(stages=[asm, RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=10, maxDepth=4, seed=7)]).fit(fit)
        plain = Pipeline(stages=[asm, LogisticRegression(featuresCol="x", labelCol="y", maxIter=10)]).fit(fit)
        p = lambda m, d, n: m.transform(d).select("series", "us", "y", *[c for c in d.columns if c in ("raw", "x2", *INPUTS)], vector_to_array("probability")[1].alias(n))
        platt = Pipeline(stages=[VectorAssembler(inputCols=["raw"], outputCol="z"), LogisticRegression(featuresCol="z", labelCol="y", maxIter=20)]).fit(p(forest, held, "raw"))
        scored = platt.transform(p(forest, test, "raw")).select("series", "us", "y", "raw", vector_to_array("probability")[1].alias("platt"))
        both = scored.join(p(plain, test, "other").select("series", "us", "other"), ["series", "us"])
        both = both.withColumn("blend", F.col("platt") * share + F.col("other") * (1 - share))
        tall = both.select("y", F.inline(F.array(*(F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in ("raw", "platt", "blend")))))
        q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("p")))
        return tall.groupBy("model").agg(
            F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"), F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.count(F.lit(1)).alias("n")
        )

    return run


def dual_importance(source: Source) -> Source:
    """Importance of every input for the next direction and for a large next move, and its class by the ratio."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        df = frame(source(spark, sf_dir)).withColumn("move", F.abs("next"))
        cut = df.agg(F.percentile_approx("move", 0.8, 1000)).first()[0] or 0.0
        df = df.withColumn("large", (F.col("move") > cut).cast("double"))
        gains = []
        for target in ("y", "large"):
            m = Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="x"), RandomForestClassifier(featuresCol="x", labelCol=target, numTrees=10, maxDepth=4, seed=7)]).fit(df)
            gains.append([float(v) for v in m.stages[-1].featureImportances.toArray()])
        rows = [(c, a, b, "DIRECTIONAL" if a > 2 * b else "VOLATILITY" if b > 2 * a else "DUAL") for c, a, b in zip(INPUTS, *gains, strict=True)]
        return spark.createDataFrame(rows, "feature string, direction double, volatility double, kind string")

    return run
