"""Soft-membership mixing to target weights, in DataFrame functions only.

A classifier fitted to the labelled rows predicts every document's posterior over domains. Nonnegative document rates
are then fitted by distributed projected gradient descent on least squares: the expected token totals of the domains,
at those rates, should meet the target weights times a token budget. A document's rate follows from its posterior and
the history of residuals (three numbers an iteration), so an iteration is one aggregation over the documents and
nothing per document travels.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WORD_GAP, fresh_path, materialize, side_files

#: Domains by label, in the order of the classes: low quality, good, toxic.
DOMAINS = ["low", "good", "toxic"]
#: Target shares of tokens.
TARGETS = {"low": 0.03, "good": 0.96, "toxic": 0.01}
#: The classifier is fitted to at most SAMPLE labelled documents, chosen by a hash; the lexicon has LEXICON words.
SAMPLE, LEXICON = 8000, 200
FEATURES = ["symbols", "shouts", "uppers", "bars", "digits", "repeats", "word_length", "lexicon_low", "lexicon_toxic"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def with_features(df: DataFrame, text_col: str, lexicons: dict[str, list[str]]) -> DataFrame:
    """df with _n, the number of words, and the columns _f_* of FEATURES."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_w", _words(text)).withColumn("_u", F.array_distinct("_w"))
    n, chars = F.greatest(F.size("_w"), F.lit(1)).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]+", "")) / chars
    hits = lambda k: F.size(F.array_intersect("_u", F.array(*map(F.lit, lexicons[k])) if lexicons.get(k) else F.array().cast("array<string>"))).cast("double")
    values = [share("#*$%&<>"), share("!"), share("A-Z"), share("|"), share("0-9"), 1 - F.size("_u") / n, chars / n, hits("low") / F.sqrt(n), hits("toxic")]
    named = {f"_f_{k}": v for k, v in zip(FEATURES, values, strict=True)}
    return rows.withColumn("_n", F.size("_w").cast("long")).withColumns(named).drop("_w", "_u")


def lexicon(sample: DataFrame, text_col: str, label: int, size: int) -> list[str]:
    """The words whose document frequency speaks most for a class: smoothed log odds times the root of the frequency."""
    words = sample.select((F.col("_label") == label).cast("int").alias("is"), F.explode(F.array_distinct(_words(F.col(text_col)))).alias("word"))
    totals = sample.agg(F.sum((F.col("_label") == label).cast("int")), F.count(F.lit(1))).first()
    inside, outside = (totals[0] or 0) + 1.0, totals[1] - (totals[0] or 0) + 1.0
    each = words.groupBy("word").agg(F.sum("is").alias("a"), F.count(F.lit(1)).alias("n")).filter("a >= 5")
    odds = F.log((F.col("a") + 0.1) / inside) - F.log((F.col("n") - F.col("a") + 0.1) / outside)
    best = each.withColumn("s", odds * F.sqrt("a")).filter(odds > 1).orderBy(F.desc("s"), "word").limit(size)
    return [r.word for r in best.collect()]


def posteriors(df: DataFrame, labelled: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[list[Column], dict[str, list[str]]]:
    """Column expressions of the domain posteriors over with_features(df), and the lexicons that it needs.

    labelled: rows with text_col and _label (0 low, 1 good, 2 toxic). At most `sample` of them, by a hash of their text,
    are fitted. Without two classes the posterior is the only class there is, or even shares without labels.
    """
    rows = labelled.filter(F.col("_label").isNotNull() & F.col(text_col).isNotNull()).select(text_col, "_label")
    # Hashes alone are sorted; texts stay in their tasks. Equal rows have equal hashes, so those at the border count one each.
    order = F.xxhash64(text_col, "_label")
    last = rows.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    border = rows.filter(order == F.lit(last)).limit(1)
    few = materialize(rows.filter(order < F.lit(last)).unionAll(border), "labelled", small=True)
    counts = {r[0]: r[1] for r in few.groupBy("_label").count().collect()}
    if len(counts) < 2:
        only = next(iter(counts), None)
        return [F.lit(1.0 / len(DOMAINS) if only is None else float(k == only)) for k in range(len(DOMAINS))], {}
    words = {"low": lexicon(few, text_col, 0, LEXICON), "toxic": lexicon(few, text_col, 2, LEXICON)}
    names = [f"_f_{k}" for k in FEATURES]
    rows = with_features(few, text_col, words).select(*names, F.col("_label").cast("double").alias("label")).coalesce(1).sortWithinPartitions(*names, "label")
    # At most `sample` short rows of numbers; LogisticRegression keeps its own blocks of them while it runs.
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(rows)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    linear = [reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(c) for w, c in zip(weights[k], names, strict=True)), F.lit(float(bias[k]))) if k in counts else None for k in range(len(bias))]
    linear += [None] * (len(DOMAINS) - len(linear))
    top = F.greatest(*[x for x in linear if x is not None])
    powers = [F.exp(x - top) if x is not None else F.lit(0.0) for x in linear]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers], words


#: A fit looks at the residuals of at most this many steps; targets that nonnegative rates can meet need about ten.
TRIALS = 60


def fit_rates(rows: DataFrame, targets: list[float], budget: float = 1.0, tolerance: float = 1e-4, trials: int = TRIALS) -> tuple[list[list[float]], float]:
    """The steps of projected gradient descent over rows of (_n, _p0, _p1, ...), for rate(), and the largest residual left.

    First the gradient is taken in the metric of the Gram matrix (as many rows and columns as there are domains) of the
    posteriors whose rates are above zero. When such a step no longer lowers the residual by a hundredth, accelerated
    projected gradient steps of the inverse Lipschitz constant follow, started anew where they overshoot. The fit ends
    within the tolerance, when five steps together lower the residual by less than a hundredth, or after `trials`: the
    caller learns from the residual how far the targets, which then lie outside what rates can reach or at its edge, are missed.
    """
    k = len(targets)
    p, n = [F.col(f"_p{i}") for i in range(k)], F.col("_n")
    total = rows.agg(F.sum(n)).first()[0]
    if not total:
        return [], 0.0
    goal = np.array(targets, float) / sum(targets) * budget

    def looked_at(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The residuals at the rates and at the point ahead of them that momentum leads to, and the Gram matrix of the rates above zero."""
        s = rows.select(n.alias("_n"), *p, _moved(p, steps).alias("_s"))
        r, m = F.col("_s.r"), F.col("_n")
        cells = [F.sum(F.when(r > 0, m * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]
        found = np.array(s.agg(*[F.sum(m * F.col(f"_s.{part}") * x) for part in ("r", "y") for x in p], *cells).first(), float) / float(total)
        return found[:k] - goal, found[k : 2 * k] - goal, found[2 * k :].reshape(k, k)

    steps: list[list[float]] = []
    error, _, gram = looked_at(steps)
    whole, size, used = gram, 1.0, 1
    plain = 1.0 / max(float(np.linalg.eigvalsh(whole)[-1]), 1e-12)
    while np.abs(error).max() > tolerance and size > 0.1 and used < trials:
        trial = [*steps, [*(size * np.linalg.pinv(gram, rcond=1e-9) @ error), 0.0]]
        found, _, active = looked_at(trial)
        used += 1
        if np.linalg.norm(found) < np.linalg.norm(error) * 0.99:
            steps, error, gram, size = trial, found, active, min(1.0, 2 * size)
        else:
            size /= 2
    norms, ahead, t = [float(np.linalg.norm(error))], error, 1.0
    while np.abs(error).max() > tolerance and used < trials:
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        steps = [*steps, [*(plain * ahead), (before - 1) / t]]
        error, ahead, _ = looked_at(steps)
        used += 1
        norms.append(float(np.linalg.norm(error)))
        if norms[-1] > norms[-2]:  # overshot: the momentum starts anew
            steps[-1][-1], ahead, t = 0.0, error, 1.0
        if len(norms) > 5 and norms[-1] > 0.99 * norms[-6]:
            break
    return steps, float(np.abs(error).max())


def _moved(p: list[Column], steps: list[list[float]]) -> Column:
    """A document's rate r, and the point y ahead of it: from 1 on, each step against the gradient and back to the nonnegative numbers."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return start
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def moved(at: Column, s: Column) -> Column:
        r = F.greatest(F.lit(0.0), at["y"] - reduce(lambda a, b: a + b, (x * F.get(s, i) for i, x in enumerate(p))))
        return F.struct(r.alias("r"), (r + F.get(s, len(p)) * (r - at["r"])).alias("y"))

    return F.aggregate(table, start, moved)


def rate(p: list[Column], steps: list[list[float]]) -> Column:
    """A document's rate after the steps."""
    return _moved(p, steps)["r"]


def mix(df: DataFrame, labelled: DataFrame, text_col: str = "text", carry: list[str] | None = None, targets: dict[str, float] | None = None, budget: float = 1.0, seed: int = 11) -> DataFrame:
    """carry (all columns by default) and n_tokens (words), p_low, p_good, p_toxic, rate, copies and residual.

    residual, the same in every row, is the largest difference that the fit leaves between a domain's expected share of
    tokens and its target; more than the tolerance of 0.0001 says that no nonnegative rates meet the targets.

    copies is the rate rounded up or down by a hash of the whole text and seed, so that it is right in expectation.
    A null or empty text has no tokens; it gets a rate all the same. Repeated rows count each. Columns of df named like
    a result are replaced. Empty tables give no rows.
    """
    goal = targets or TARGETS
    results = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies", "residual"]
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in results]
    held = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    path = fresh_path(df.sparkSession, "posteriors")
    with side_files(df.sparkSession):
        columns, words = posteriors(df, labelled, text_col)
    u = F.pmod(F.xxhash64(F.lit(seed), text_col, *[F.col(f"`{c}`") for c in names if c == "doc_id"]), F.lit(1 << 30)) / float(1 << 30)
    rows = with_features(df.select(held.alias("_row"), F.col(text_col).alias("_t"), u.alias("_u01")), "_t", words)
    rows = rows.select("_row", "_u01", "_n", *[c.alias(f"_p{i}") for i, c in enumerate(columns)])
    rows = materialize(rows, "posteriors", path=path)
    steps, residual = fit_rates(rows, [goal[d] for d in DOMAINS], budget)
    p = [F.col(f"_p{i}") for i in range(len(DOMAINS))]
    rows = rows.withColumn("_rate", rate(p, steps))
    out = rows.select("_row", F.col("_n").alias("n_tokens"), *[x.alias(f"p_{d}") for x, d in zip(p, DOMAINS, strict=True)], F.col("_rate").alias("rate"), F.floor(F.col("_rate") + F.col("_u01")).cast("int").alias("copies"), F.lit(residual).alias("residual"))
    return out.select(*(["_row.*"] if names else []), *results)


def labels_as_domains(labels: DataFrame) -> DataFrame:
    """doc_id and _label of each labelled document: toxic before quality; one row per id."""
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts with _label of at most `sample` labelled documents, chosen by a hash of the id before any text moves."""
    few = labels_as_domains(labels).filter("_label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows: a bounded broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "_label")


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with every row as many times as its copies say."""
    mixed = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text")), labelled_texts(docs, labels).withColumnRenamed("text", "_text"), "_text", ["_doc"], **options)
    return mixed.filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
