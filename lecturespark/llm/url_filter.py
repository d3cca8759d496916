"""URL filters: host and path rules, and logistic regression where no rule fits.

Main path: DataFrame functions alone. The model is a logistic regression on hashed
character n-grams of host and path, fitted to a small labelled URL table of at most
``MAX_LABELLED`` rows; its weights are a constant of the scoring expression. The threshold
comes from the same table, by cross-validation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import LOWER, UPPER, stored

BINS, GRAMS, MAX_LABELLED, MAX_RULES = 8192, (3, 4, 5), 10_000, 1_000
BLOCK_FROM = 0.5  # where the caller has no threshold of its own labels
FOLDS, WRONGLY_BLOCKED = 5, 2.0  # a wanted URL that is blocked costs as much as two unwanted ones that pass
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# The labelled table of the registered query is made from words that are common in hosts of wanted and of unwanted
# sites. They were written without looking at the table that the query judges.
WANTED = (
    "library", "news", "garden", "weather", "concert", "school", "history", "university", "recipes", "museum", "dictionary", "alpine",
    "orchestra", "bird", "stories", "health", "parliament", "map", "sailing", "chronicle", "farmers", "athletics", "freedom", "letters",
    "transport", "translation", "observatory", "geology", "cooking", "college", "poetry", "theatre", "bicycle", "ocean", "railway", "court",
)
UNWANTED = (
    "cheap", "pills", "replica", "diet", "pharmacy", "casino", "bonus", "slots", "jackpot", "lucky", "win", "bets",
    "betting", "spins", "cash", "prize", "adult", "dating", "xxx", "singles", "backlinks", "linkfarm", "spam", "ads",
    "click", "popup", "tracker", "seo", "payday", "loans", "poker", "viagra", "porn", "warez", "crack", "followers",
)
STEPS, LANGS = (1, 3, 7), ("en", "de", "fr", "es")


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _gram_bins(part: Column, name: str) -> Column:
    marked = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")

    def grams(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - n)
        joined = F.transform(starts, lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))
        return F.when(F.size(chars) >= n, joined).otherwise(F.array().cast("array<string>"))

    # An array of one element binds the letters, which are then split once per text and not once per n-gram.
    every = F.flatten(F.transform(F.array(marked), lambda chars: F.concat(*[grams(chars, n) for n in GRAMS])))
    return F.transform(every, lambda g: F.pmod(F.xxhash64(F.lit(name), g), F.lit(BINS)).cast("int"))


def url_bins(host: Column, path: Column) -> Column:
    """The distinct bins that the n-grams of host and path fall into."""
    return F.array_distinct(F.concat(_gram_bins(host, "host"), _gram_bins(path, "path")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted): each word as a host of its own and joined with the words ``STEPS`` places later."""
    hosts = [(k, i, "-".join(dict.fromkeys((words[i], words[(i + step) % len(words)])))) for k, words in ((0, WANTED), (1, UNWANTED))
             for i in range(len(words)) for step in (0, *STEPS)]
    rows = [f"('https://{'www.' if i % 3 == 0 else ''}{host}.example/{LANGS[i % len(LANGS)]}/{31 * n}', {k})" for n, (k, i, host) in enumerate(hosts)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, unwanted)")


def _points(rows: DataFrame) -> DataFrame:
    """``rows`` with a sparse vector ``features``, 1 at each bin of the url."""
    bins = url_bins(host_of(F.col("url")), path_of(F.col("url"))).cast("array<string>")
    # The vocabulary is the bins themselves.
    places = CountVectorizerModel.from_vocabulary([str(i) for i in range(BINS)], inputCol="bins", outputCol="features")
    return places.transform(rows.withColumn("bins", bins)).drop("bins")


def _regression(points: DataFrame) -> LogisticRegressionModel:
    rows = points.select(F.col("unwanted").cast("double").alias("label"), "features").coalesce(1)
    return LogisticRegression(maxIter=50, regParam=0.01, standardization=False).fit(rows)


def fit_url_model(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> UrlModel:
    """``labelled`` (url, unwanted 0/1), at most ``max_rows`` rows; rows with a null are left out.

    An empty table gives a model that allows all.
    """
    rows = labelled.select("url", "unwanted").dropna()
    n = rows.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"the labelled URL table has over {max_rows} rows")
    if n == 0:
        return UrlModel((0.0,) * BINS, -1.0)
    fitted = _regression(_points(rows))
    return UrlModel(tuple(float(w) for w in fitted.coefficients.toArray()), float(fitted.intercept))


def held_out_scores(labelled: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(url, unwanted, unwanted_probability): each row judged by the model of the other folds; rows with a null are left out.

    A row has no score where the other folds are empty.
    """
    points = stored(_points(labelled.select("url", "unwanted").dropna().withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(folds)))))
    judged = [points.filter("false").withColumn("unwanted_probability", F.lit(0.0))]
    for k in range(folds):
        others = points.filter(F.col("fold") != k)
        if not others.isEmpty():
            own = _regression(others).transform(points.filter(F.col("fold") == k))
            judged.append(own.select(*points.columns, vector_to_array("probability")[1].alias("unwanted_probability")))
    return stored(reduce(DataFrame.union, judged).select("url", "unwanted", "unwanted_probability"))


def threshold_of(scores: DataFrame, wrongly_blocked: float = WRONGLY_BLOCKED) -> float:
    """The probability from which blocking costs least on held-out rows; ``BLOCK_FROM`` if there are none of either kind.

    A wanted row at or above it costs ``wrongly_blocked``, an unwanted one below it 1. It lies half-way between
    neighbouring rows; of several, the highest is taken. ``scores`` has as many rows as the labelled table at most.
    """
    below = Window.orderBy("unwanted_probability").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("unwanted_probability").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unwanted = F.col("unwanted") == 1
    cost = F.count_if(unwanted).over(below) + wrongly_blocked * (F.count_if(~unwanted).over(every) - F.count_if(~unwanted).over(below))
    both = (F.count_if(unwanted).over(every) > 0) & (F.count_if(~unwanted).over(every) > 0)
    cuts = scores.select("unwanted_probability", cost.alias("cost"), both.alias("both")).filter("both").distinct()
    after = F.lead("unwanted_probability", 1, 1.0).over(Window.orderBy("unwanted_probability"))
    best = cuts.withColumn("cut", (F.col("unwanted_probability") + after) / 2).agg(F.max_by("cut", F.struct(-F.col("cost"), "cut")).alias("cut")).first()
    return BLOCK_FROM if best.cut is None else best.cut


def judge_urls(pages: DataFrame, model: UrlModel, url_col: str = "url", rules: tuple = RULES,
               block_from: float = BLOCK_FROM) -> DataFrame:
    """``pages`` with host, path, rule, verdict and unwanted_probability; rows stay.

    ``rules``: (verdict, "host/path") pairs, at most ``MAX_RULES``. The longest rule that
    fits decides, of equally long ones the first by code point; else the model does. A
    null url, or one without ``://``, has an empty host and path, which fit no rule.
    Columns of ``pages`` with one of the new names are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    host, path = F.col("_host"), F.col("_path")
    fits = []
    for verdict, rule in rules:
        on, _, below = rule.partition("/")
        good = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{below}")
        fits.append(F.when(good, F.struct(F.lit(-len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_min(F.filter(F.array(*fits), lambda r: r.isNotNull())) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    weights = F.array(*[F.lit(w) for w in model.weights])  # folded to one constant
    score = F.aggregate(F.transform(url_bins(host, path), lambda b: F.get(weights, b)), F.lit(model.bias), lambda a, w: a + w)
    judged = (pages.withColumn("_host", host_of(F.col(url_col))).withColumn("_path", path_of(F.col(url_col)))
              .withColumn("_best", best).withColumn("_score", 1 / (1 + F.exp(-score))))
    own = F.when(F.col("_score") >= block_from, F.lit("block")).otherwise(F.lit("allow"))
    added = {"host": host, "path": path, "rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", own), "unwanted_probability": F.col("_score")}
    return judged.select(*[c for c in pages.columns if c not in added], *[v.alias(k) for k, v in added.items()])


@query("op4_url_filter")
def url_filter_query(spark: SparkSession, folder: str) -> DataFrame:
    labelled = labelled_urls(spark)
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, fit_url_model(labelled), block_from=threshold_of(held_out_scores(labelled))).select("page_id", "host", "path", "rule", "verdict", "unwanted_probability")
