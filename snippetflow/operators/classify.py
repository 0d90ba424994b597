"""Stage 2: classifiers (M4-M7, M9, S10) and the Naive Bayes job.

* ``train_classifier``: Spark ML pipeline (tokens -> hashed term counts ->
  IDF -> multinomial logistic regression with class weights), one fit per
  candidate setting, the best chosen by validation macro-F1 (A23).  Hashing
  keeps the feature space fixed: no vocabulary is gathered on the driver.
* ``classify``: a fitted ``PipelineModel``, a ``CueTable`` (argmax of cue
  scores) or a ``BatchModel`` (external model over Arrow batches).
* ``fit_naive_bayes`` / ``predict_naive_bayes``: multinomial Naive Bayes as
  joins and aggregates; the model is a sparse (token, weights) table.  Rows are scored by
  their place in the table (``schema.unique_key``), never by an id that others may share.
  Several models are scored in one pass (``stack_naive_bayes``), a row's two views as well
  (``predict_two_views``), and a categorical column may join the tokens (M9).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snippetflow.functions.cues import CueTable
from snippetflow.functions.text import CROP_CHARS, TOKEN_SPLIT, crop_head, crop_tail
from snippetflow.operators import labels as L
from snippetflow.operators.detect import cached_model
from snippetflow.operators import metrics as M
from snippetflow.schema import unique_key
from snippetflow.session import cut_lineage

DEFAULT_CANDIDATES = ({"regParam": 0.01, "maxIter": 20}, {"regParam": 0.1, "maxIter": 20})
DEFAULT_FEATURES = 1 << 14
NB_SPLIT = r"[^\p{L}]+"
NB_ALPHAS = (0.1, 1.0, 10.0)


def feature_stages(num_features: int = DEFAULT_FEATURES, code: str = "code", language_feature: str | None = None) -> tuple[list, str]:
    """The text features' stages and the name of their output.  ``language_feature``
    adds a one-hot of a string column (stage-1 ``detected_language``, M9).
    ``num_features`` is the fixed size of the hash space: tokens collide as the
    vocabulary outgrows it, so raise it with the data."""
    from pyspark.ml.feature import (IDF, HashingTF, OneHotEncoder, RegexTokenizer, StringIndexer,
                                    VectorAssembler)
    stages = [RegexTokenizer(inputCol=code, outputCol="_tokens", pattern=TOKEN_SPLIT, toLowercase=True),
              HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_tfidf")]
    if not language_feature:
        return stages, "_tfidf"
    stages += [StringIndexer(inputCol=language_feature, outputCol="_lang_ix", handleInvalid="keep"),
               OneHotEncoder(inputCol="_lang_ix", outputCol="_lang_oh", handleInvalid="keep"),
               VectorAssembler(inputCols=["_tfidf", "_lang_oh"], outputCol="_features")]
    return stages, "_features"


def regression(features: str, reg_param: float = 0.01, max_iter: int = 30, label: str = "label", weight: str | None = "weight"):
    """M4 estimator over ready features."""
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                            regParam=reg_param, maxIter=max_iter, predictionCol="_prediction",
                            probabilityCol="_probability", rawPredictionCol="_raw")
    return lr.setWeightCol(weight) if weight else lr


def predict_model(model, df: DataFrame, out: str = "predicted_label") -> DataFrame:
    """M5 with a fitted PipelineModel: argmax label as int; narrow."""
    res = model.transform(df).withColumn(out, F.col("_prediction").cast("int"))
    return res.drop(*[c for c in res.columns if c.startswith("_") and c not in df.columns])


def evaluate_predictions(pred: DataFrame, truth: str = "label", out_pred: str = "predicted_label") -> DataFrame:
    """M7: one row (macro_f1, accuracy) - macro, not Spark's weighted 'f1'."""
    s = M.summary_metrics(M.confusion_counts(pred, truth, out_pred))
    return s.select("macro_f1", "accuracy")


@dataclass
class TrainResult:
    model: object
    candidates: DataFrame       # (candidate, reg_param, max_iter, val_macro_f1, val_accuracy)
    best: DataFrame             # the chosen row
    models: list | None = None  # every fitted candidate, in candidate order


def train_classifier(train: DataFrame, val: DataFrame, candidates=DEFAULT_CANDIDATES,
                     class_weighted: bool = True, num_features: int = DEFAULT_FEATURES,
                     label: str = "label", language_feature: str | None = None) -> TrainResult:
    """M4 + M7 + A23: fit each candidate with class weights (A9/J5), score the
    validation rows, keep the first best macro-F1.  The candidate table and
    the returned model are computed once; the choice of model is a driver
    decision over at most len(candidates) numbers."""
    from snippetflow.operators.ensemble import best_candidate
    spark = train.sparkSession
    # every candidate's IDF pass, optimizer iterations and validation pass
    # read these: materialize the needed columns once instead of re-running
    # sampling / dedup / stage 1 per pass
    need = [c for c in ("id", "code", label, language_feature) if c and c in train.columns]
    tr = cut_lineage(train.select(*need))
    val = cut_lineage(val.select(*[c for c in need if c in val.columns]))
    if class_weighted:
        tr = L.with_class_weight(tr, L.class_weights(tr, label), label, "weight")
    from pyspark.ml import Pipeline, PipelineModel
    stages, feats = feature_stages(num_features, "code", language_feature)
    prep = Pipeline(stages=stages).fit(tr)
    # features are computed once and kept; only the regression is fitted per candidate
    weight = "weight" if class_weighted else None
    tr = cut_lineage(prep.transform(tr).select(feats, label, *([weight] if weight else [])))
    val = cut_lineage(prep.transform(val).select(feats, label))
    rows, models = [], []
    for i, cand in enumerate(candidates):
        lr = regression(feats, cand["regParam"], cand["maxIter"], label, weight).fit(tr)
        model = PipelineModel(stages=[*prep.stages, lr])
        pred = lr.transform(val).select(label, F.col("_prediction").cast("int").alias("predicted_label"))
        ev = evaluate_predictions(pred, label).first()
        rows.append((i, float(cand["regParam"]), int(cand["maxIter"]), float(ev["macro_f1"]),
                     float(ev["accuracy"])))
        models.append(model)
    schema = "candidate int, reg_param double, max_iter int, val_macro_f1 double, val_accuracy double"
    table = spark.createDataFrame(rows, schema)
    best_i = max(range(len(rows)), key=lambda k: (rows[k][3], -k))   # strict '>' -> earliest wins
    return TrainResult(models[best_i], table, best_candidate(table, "candidate", "val_macro_f1"), models)


def save_model(model, path: str) -> None:
    """Write a fitted PipelineModel."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Read a PipelineModel back."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def classify(df: DataFrame, model, code: str = "code", out: str = "predicted_label") -> DataFrame:
    """M5: add the integer prediction with whichever model kind is given."""
    if isinstance(model, CueTable):
        return model.apply(df, code, out, "index")
    if isinstance(model, NaiveBayesModel):
        return predict_naive_bayes(model, df, None, code, out)
    if hasattr(model, "transform"):
        return predict_model(model, df, out)
    if callable(model):
        return df.withColumn(out, model(F.col(code)))
    raise TypeError(f"unsupported classifier {model!r}")


_SCORER_CACHE: dict = {}


def batch_scores_udf(make_predict_fn, batch_size: int = 32, failed: int | None = None):
    """External scorer over Arrow batches (M5): ``make_predict_fn()`` returns
    ``fn(list[str]) -> list[int]`` and is called once per Python worker.  A null text is not
    sent and scores null; a failing batch is retried row by row and a failing row gets ``failed``."""
    token = uuid.uuid4().hex

    @F.pandas_udf(T.IntegerType())
    def _predict(texts: pd.Series) -> pd.Series:
        fn = cached_model(_SCORER_CACHE, token, make_predict_fn)
        vals = texts.tolist()
        out: list = [None] * len(vals)
        for s in range(0, len(vals), batch_size):
            idx = [i for i in range(s, min(s + batch_size, len(vals))) if vals[i] is not None]
            if not idx:
                continue
            try:
                got = list(fn([vals[i] for i in idx]))
                if len(got) != len(idx):
                    raise ValueError("model returned a wrong number of answers")
                for i, x in zip(idx, got):
                    out[i] = int(x)
            except Exception:
                for i in idx:
                    try:
                        out[i] = int(list(fn([vals[i]]))[0])
                    except Exception:
                        out[i] = failed
        return pd.Series(out, dtype="Int32")
    return _predict


# ------------------------------------------------------------ Naive Bayes --

@dataclass
class NaiveBayesModel:
    weights: DataFrame    # (token, w): w[k] = log(count(token, class k) + a), dense over the K classes
    classes: DataFrame    # (label, prior, norm): log-prior, log(total_c + a*|V|)
    labels: list          # the K class labels in order
    alpha: float
    values: DataFrame | None = None     # (value, w): w[k] = log of the share of the categorical value in class k (M9)


@dataclass
class NaiveBayesStack:
    """Several models of the same classes, scored together."""
    weights: DataFrame    # (token, w, known): w[m * K + k], and known[m] = 1 where model m has the token
    classes: DataFrame    # (model, label, prior, norm)
    labels: list
    size: int             # models


@dataclass
class NaiveBayesCounts:
    """The sufficient statistics of a fit: one row per token with its K class
    counts, one row per class with its documents and tokens."""
    tokens: DataFrame     # (token, c)
    classes: DataFrame    # (label, n_c, tot)
    labels: list
    n_vocab: int

    def model(self, alpha: float = 1.0) -> NaiveBayesModel:
        """Smoothed by ``alpha`` (the prior as well: log((n_c + a) / (n + K a)))."""
        weights = self.tokens.select("token", F.transform("c", lambda x: F.log(x + alpha)).alias("w"))
        allw = Window.partitionBy(F.lit(0))     # K rows
        classes = self.classes.select(
            "label", F.log((F.col("n_c") + alpha) / (F.sum("n_c").over(allw) + F.count(F.lit(1)).over(allw) * alpha)).alias("prior"),
            F.log(F.col("tot") + alpha * self.n_vocab).alias("norm"))
        return NaiveBayesModel(weights, classes, self.labels, alpha)

    def stack(self, alphas) -> NaiveBayesStack:
        """The models of all ``alphas`` from the one token table, without a join."""
        w = F.concat(*[F.transform("c", _log_plus(a)) for a in alphas])
        classes = None
        for i, a in enumerate(alphas):
            c = self.model(a).classes.withColumn("model", F.lit(i))
            classes = c if classes is None else classes.unionByName(c)
        return NaiveBayesStack(self.tokens.select("token", w.alias("w"), F.array_repeat(F.lit(1), len(alphas)).alias("known")), classes, self.labels, len(alphas))


def _log_plus(alpha: float):
    return lambda x: F.log(x + alpha)


def count_naive_bayes(train: DataFrame, label: str = "label", code: str = "code", pattern: str = NB_SPLIT) -> NaiveBayesCounts:
    """One pass over the text: (token, label) counts with partial aggregation, folded
    to one row per token with a sum per class (fixed width).  Both tables are written once; the K
    class labels and the vocabulary's size reach the driver.  Rows without a label do not train."""
    t = train.select(F.col(label).alias("label"), F.col(code).alias("code")).where("label is not null")
    docs = t.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    toks = t.select("label", F.explode(F.split(F.lower(F.col("code")), pattern)).alias("token")).filter(F.col("token") != "")
    counts = cut_lineage(toks.groupBy("token", "label").agg(F.count(F.lit(1)).alias("cnt")))
    totals = counts.groupBy("label").agg(F.sum("cnt").alias("tot"))
    classes = cut_lineage(docs.join(totals, "label", "left").select("label", "n_c", F.coalesce("tot", F.lit(0)).alias("tot")))
    ks = [r["label"] for r in classes.select("label").orderBy("label").collect()]       # K values
    per = counts.groupBy("token").agg(*[F.sum(F.when(F.col("label") == k, F.col("cnt"))).alias(f"c{i}") for i, k in enumerate(ks)])
    tokens = cut_lineage(per.select("token", F.array(*[F.coalesce(f"c{i}", F.lit(0)) for i in range(len(ks))]).alias("c")))
    return NaiveBayesCounts(tokens, classes, ks, tokens.count())


def fit_naive_bayes(train: DataFrame, label: str = "label", code: str = "code", alpha: float = 1.0, pattern: str = NB_SPLIT,
                    language: str | None = None) -> NaiveBayesModel:
    """Multinomial NB with additive smoothing.  ``language`` names a categorical column (stage 1's
    language, M9) whose likelihood log((n_kv + a) / (n_k + a V)) over its V values counts beside the tokens."""
    model = count_naive_bayes(train, label, code, pattern).model(alpha)
    if language is None:
        return model
    pairs = train.select(F.col(label).alias("label"), F.col(language).alias("value")).where("label is not null and value is not null")
    seen = cut_lineage(pairs.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n")))
    n_values = seen.select("value").distinct().count()
    totals = seen.groupBy("label").agg(F.sum("n").alias("n"))
    totals = {r.label: r.n for r in totals.collect()}        # K rows
    w = [F.log((F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) + alpha) / (totals.get(k, 0) + alpha * n_values)) for k in model.labels]
    model.values = cut_lineage(seen.groupBy("value").agg(F.array(*w).alias("w")))
    return model


def stack_naive_bayes(models: list[NaiveBayesModel]) -> NaiveBayesStack:
    """M8: one weight table for several fitted models: a token's row has the weights of all."""
    labels = models[0].labels
    if any(m.labels != labels for m in models):
        raise ValueError("stacked models need the same classes")
    rows, classes = None, None
    for i, m in enumerate(models):
        r, c = m.weights.select("token", "w", F.lit(i).alias("model")), m.classes.select("label", "prior", "norm", F.lit(i).alias("model"))
        rows, classes = (r, c) if rows is None else (rows.unionByName(r), classes.unionByName(c))
    own = [F.max(F.when(F.col("model") == i, F.col("w"))) for i in range(len(models))]
    none = F.array_repeat(F.lit(0.0), len(labels))
    weights = rows.groupBy("token").agg(F.concat(*[F.coalesce(w, none) for w in own]).alias("w"),
                                        F.array(*[F.when(w.isNull(), 0).otherwise(1) for w in own]).alias("known"))
    return NaiveBayesStack(cut_lineage(weights), classes, labels, len(models))


@dataclass
class NaiveBayesSearch:
    models: list            # one per candidate
    candidates: DataFrame   # (candidate, alpha, val_macro_f1, val_accuracy)
    best: DataFrame         # the chosen row
    model: NaiveBayesModel


def search_naive_bayes(train: DataFrame, val: DataFrame, alphas=NB_ALPHAS, label: str = "label", id_col: str | None = None,
                       code: str = "code") -> NaiveBayesSearch:
    """M4 + M7 + A23 in closed form: one count of the training rows, a model per alpha, all
    scored on the validation rows, the first best macro-F1 kept."""
    from snippetflow.operators.ensemble import best_candidate
    counts = count_naive_bayes(train, label, code)
    models = [counts.model(a) for a in alphas]
    # all candidates read and tokenize the validation rows once
    scored = predict_stack(counts.stack(alphas), val, id_col, code).select(label, F.posexplode("predicted_labels").alias("candidate", "predicted_label"))
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("candidate") + 1)
    table = cut_lineage(M.grouped_summary(scored, "candidate", label).select(
        "candidate", alpha.alias("alpha"), F.col("macro_f1").alias("val_macro_f1"), F.col("accuracy").alias("val_accuracy")))
    best = best_candidate(table, "candidate", "val_macro_f1")
    return NaiveBayesSearch(models, table, best, models[best.first()["candidate"]])


def save_naive_bayes(model: NaiveBayesModel, path: str) -> None:
    """The model's two tables and its settings."""
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")
    spark = model.weights.sparkSession
    spark.range(1).select(F.lit(float(model.alpha)).alias("alpha"), F.lit(model.values is not None).alias("has_values")).write.mode("overwrite").parquet(f"{path}/settings")
    if model.values is not None:
        model.values.write.mode("overwrite").parquet(f"{path}/values")


def load_naive_bayes(spark, path: str) -> NaiveBayesModel:
    classes = spark.read.parquet(f"{path}/classes")
    labels = [r["label"] for r in classes.select("label").orderBy("label").collect()]
    settings = spark.read.parquet(f"{path}/settings").first()
    values = spark.read.parquet(f"{path}/values") if "has_values" in settings and settings["has_values"] else None
    return NaiveBayesModel(spark.read.parquet(f"{path}/weights"), classes, labels, settings["alpha"], values)


def _keyed(df: DataFrame, id_col: str | None) -> tuple[DataFrame, str]:
    return (df, id_col) if id_col else unique_key(df)


def _class_scores(classes: DataFrame, size: int, k: int, sums, known) -> Column:
    """Per model the array of class scores: prior + sum of weights - known tokens * norm."""
    rows = sorted((r.model, r.label, r.prior, r.norm) for r in classes.collect())        # models x K rows
    prior, norm = (F.array(*[F.lit(r[i]) for r in rows]) for i in (2, 3))

    def of_model(m):
        def of_class(c):
            at = m * k + c
            return F.get(prior, at) + F.coalesce(F.get(sums, at), F.lit(0.0)) - F.coalesce(F.get(known, m), F.lit(0)) * F.get(norm, at)
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of_class)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), of_model)


def _best_label(scores, labels: list):
    """The label of the highest score, the lowest label among equal ones."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))


def _occurrences(df: DataFrame, key: str, code, pattern: str) -> DataFrame:
    return df.select(F.col(key).alias("_nb_id"), F.explode(F.split(F.lower(code), pattern)).alias("token")).where("token <> ''")


# Room for the weights that go to every task: all of a table that fits, else those of its most frequent tokens.
BROADCAST_BYTES = 32 << 20
FREQUENCY_STEPS = 8     # per unit of a weight, the logarithm of a count


def _weighted(terms: DataFrame, weights: DataFrame, width: int) -> DataFrame:
    """Token occurrences with the weights of their tokens; unknown tokens have no row.

    The tokens are counted by their largest weight, which grows with the token's count, in steps.  The most frequent
    ones that fit BROADCAST_BYTES (rows times the width of a row) are broadcast, and their occurrences, nearly all
    in any natural text, stay in their tasks.  Only occurrences of the other tokens are shuffled, however long
    the table grows."""
    step = F.floor(F.array_max("w") * FREQUENCY_STEPS)
    sizes = sorted(weights.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)     # a row per step of a logarithm
    room, least = BROADCAST_BYTES // (64 + 8 * width), None
    if sum(r.n for r in sizes) <= room:
        return terms.join(F.broadcast(weights), "token")
    for r in sizes:
        room -= r.n
        if room < 0:
            break
        least = r.step
    if least is None:
        return terms.join(weights, "token")
    frequent = weights.where(step >= least)
    others = terms.join(F.broadcast(frequent.select("token")), "token", "left_anti").join(weights.where(step < least), "token")
    return terms.join(F.broadcast(frequent), "token").unionByName(others)


def _stack_scores(stack: NaiveBayesStack, df: DataFrame, key: str, code: str, pattern: str) -> DataFrame:
    """``df`` with ``_nb``: per model the scores of the K classes.

    Token occurrences meet the one-row-per-token weight table by token (``_weighted``);
    a single aggregate per row then sums the scores and the known tokens of
    all models."""
    k = len(stack.labels)
    terms = _weighted(_occurrences(df, key, F.col(code), pattern), stack.weights, stack.size * (k + 1))
    per_row = terms.groupBy("_nb_id").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(stack.size * k)]).alias("_nb_s"),
                                          F.array(*[F.sum(F.col("known")[i]) for i in range(stack.size)]).alias("_nb_n"))
    met = df.join(per_row, F.col(key) == F.col("_nb_id"), "left")
    return met.withColumn("_nb", _class_scores(stack.classes, stack.size, k, F.col("_nb_s"), F.col("_nb_n"))).drop("_nb_id", "_nb_s", "_nb_n")


def predict_stack(stack: NaiveBayesStack, df: DataFrame, id_col: str | None = None, code: str = "code",
                  out: str = "predicted_labels", pattern: str = NB_SPLIT) -> DataFrame:
    """M8 in one pass: the array of every model's label.  ``id_col``: a column known to be unique and
    not null; without it rows are told apart by their place in the table."""
    names = df.columns
    df, key = _keyed(df, id_col)
    scored = _stack_scores(stack, df, key, code, pattern)
    labels = stack.labels
    return scored.withColumn(out, F.transform("_nb", lambda s: _best_label(s, labels))).select(*names, out)


def predict_naive_bayes(model: NaiveBayesModel, df: DataFrame, id_col: str | None = None, code: str = "code",
                        out: str = "predicted_label", pattern: str = NB_SPLIT, language: str | None = None) -> DataFrame:
    """argmax_k prior_k + sum_t x_t * w[t][k] - n_known * norm_k, ties -> lowest label.

    Rows without any known token keep the prior.  ``id_col``: a column known to be unique and not null; without
    it rows are told apart by their place in the table, so repeated and null ids do no harm.
    A model fitted with a categorical column adds its likelihood (``language`` names the column; an unseen or null value adds nothing).
    """
    names = df.columns
    df, key = _keyed(df, id_col)
    one = NaiveBayesStack(model.weights.select("token", "w", F.array(F.lit(1)).alias("known")), model.classes.withColumn("model", F.lit(0)), model.labels, 1)
    scored = _stack_scores(one, df, key, code, pattern).withColumn("_nb", F.col("_nb")[0])
    if model.values is not None and language is not None:
        v = model.values.select(F.col("value").alias("_nb_v"), F.col("w").alias("_nb_vw"))
        scored = scored.join(v, F.col(language) == F.col("_nb_v"), "left")
        scored = scored.withColumn("_nb", F.when(F.col("_nb_vw").isNull(), F.col("_nb")).otherwise(F.zip_with("_nb", "_nb_vw", lambda a, b: a + b)))
    return scored.withColumn(out, _best_label(F.col("_nb"), model.labels)).select(*names, out)


def predict_two_views(model: NaiveBayesModel, df: DataFrame, n: int = CROP_CHARS, id_col: str | None = None, code: str = "code",
                      out: str = "predicted_label", pattern: str = NB_SPLIT) -> DataFrame:
    """M6 with a fitted model: the class probabilities of the head and of the tail view
    (their first and last ``n`` characters), averaged; argmax, ties -> lowest label.
    Both views of a row are scored in one join and one aggregate."""
    names, k = df.columns, len(model.labels)
    df, key = _keyed(df, id_col)
    views = df.select(F.col(key).alias("_nb_id"), F.posexplode(F.array(crop_head(code, n), crop_tail(code, n))).alias("view", "code"))
    terms = views.select("_nb_id", "view", F.explode(F.split(F.lower("code"), pattern)).alias("token")).where("token <> ''")
    terms = _weighted(terms, model.weights, k)
    mine = lambda v, x: F.sum(F.when(F.col("view") == v, x))
    per_row = terms.groupBy("_nb_id").agg(F.array(*[mine(v, F.col("w")[i]) for v in (0, 1) for i in range(k)]).alias("_nb_s"),
                                          F.array(*[mine(v, F.lit(1)) for v in (0, 1)]).alias("_nb_n"))
    classes = model.classes.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1))))
    met = df.join(per_row, F.col(key) == F.col("_nb_id"), "left").withColumn("_nb", _class_scores(classes, 2, k, F.col("_nb_s"), F.col("_nb_n")))

    def probabilities(s):
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    met = met.withColumn("_nb", F.transform("_nb", probabilities)).withColumn("_nb", F.zip_with(F.col("_nb")[0], F.col("_nb")[1], lambda a, b: (a + b) / 2.0))
    return met.withColumn(out, _best_label(F.col("_nb"), model.labels)).select(*names, out)
