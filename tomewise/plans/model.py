"""Explicit-feedback ALS: configuration, fitting, grid search and scoring."""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, NumericType, ShortType

from tomewise.operators import half_step
from tomewise.operators.stats import rmse
from tomewise.session import cut, delete, fresh_dir, shared_dir

# The grid that is searched, and the configuration that is served.
RANKS = (10, 20, 50, 70)
REGS = (0.15, 0.20, 0.25)
SERVED_RANK, SERVED_REG, SERVED_ITERATIONS = 50, 0.20, 10

# What one block may hold; a task solves a block at a time.
RATINGS_PER_BLOCK = 5_000_000
# Half steps have more blocks than ALS where there are cores for them and at least so many ratings for each.
RATINGS_PER_TASK, TASKS_PER_CORE = 100_000, 3


@dataclass(frozen=True)
class AlsConfig:
    """``seed`` has no default on purpose: Spark's own differs between interpreter starts.

    ``blocks`` is a constant of the job, the same for every fit of it: it decides the starting point of the
    factors. A fit that has more than ``RATINGS_PER_BLOCK`` ratings to a block raises; a job takes ``for_ratings`` of
    all its ratings, once, so that it has enough.
    """

    seed: int
    rank: int = SERVED_RANK
    reg: float = SERVED_REG
    max_iter: int = SERVED_ITERATIONS
    blocks: int = 10

    def for_ratings(self, n_ratings: int) -> "AlsConfig":
        """This configuration with at least as many blocks as so many ratings need; there is no maximum."""
        return replace(self, blocks=max(self.blocks, -(-n_ratings // RATINGS_PER_BLOCK)))

    def estimator(self, n_ratings: int) -> ALS:
        blocks = self.blocks
        if n_ratings > blocks * RATINGS_PER_BLOCK:
            raise ValueError(f"{n_ratings} ratings need {-(-n_ratings // RATINGS_PER_BLOCK)} blocks, not {blocks}")
        return ALS(
            rank=self.rank,
            regParam=self.reg,
            maxIter=self.max_iter,
            seed=self.seed,
            numUserBlocks=blocks,
            numItemBlocks=blocks,
            nonnegative=True,
            implicitPrefs=False,
            coldStartStrategy="drop",
            # Every third iteration, so that a lost executor repeats at most three.
            checkpointInterval=3,
            userCol="user_id",
            itemCol="book_id",
            ratingCol="rating",
        )


def usable(ratings: DataFrame) -> DataFrame:
    """The columns that ALS reads. All rows are trained on, whatever their scale; a NULL or NaN among
    them makes the fit raise, so screen doubtful ratings first."""
    return ratings.select("user_id", "book_id", "rating")


@contextmanager
def sides(ratings: DataFrame, n: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The ratings in ``n`` blocks of users and in as many of books, kept for all half steps inside."""
    by_user = half_step.blocks(ratings, "user_id", "book_id", n)
    by_book = half_step.blocks(ratings, "book_id", "user_id", n)
    try:
        yield by_user, by_book
    finally:
        by_user.unpersist()
        by_book.unpersist()


def tasks(ratings: DataFrame, n_ratings: int, blocks: int) -> int:
    """In how many blocks half steps of so many ratings are solved; what is solved does not depend on it."""
    return max(blocks, min(TASKS_PER_CORE * ratings.sparkSession.sparkContext.defaultParallelism, n_ratings // RATINGS_PER_TASK))


def plain_ids(ratings: DataFrame) -> bool:
    """Whether ids are whole numbers that ALS takes as they are, and ratings numbers."""
    user, book, rating = (ratings.schema[c].dataType for c in ("user_id", "book_id", "rating"))
    return all(isinstance(kind, (ByteType, ShortType, IntegerType)) for kind in (user, book)) and isinstance(rating, NumericType)


def checked(ratings: DataFrame) -> tuple[int, bool]:
    """How many ratings there are, and whether all are such that ALS has nothing to convert or to refuse."""
    if not plain_ids(ratings):
        return ratings.count(), False
    rating = F.col("rating").cast("float")
    bad = F.col("user_id").isNull() | F.col("book_id").isNull() | rating.isNull() | F.isnan(rating)
    found = ratings.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad")).first()
    return found.rows, not found.bad


def starting(ratings: DataFrame, plain: bool) -> DataFrame:
    """Ratings that ALS starts from as from ``ratings``: users start by their ids alone, so a row for each is enough.
    Where ALS has something to refuse it sees all of them."""
    if not plain:
        return ratings
    return cut(ratings.select("user_id").distinct()).select("user_id", F.lit(0).alias("book_id"), F.lit(1.0).alias("rating"))


def start(als: ALS, ratings: DataFrame, rank: int) -> str:
    """The folder of the packed factors that users start from, given :func:`starting` ratings."""
    return half_step.written(half_step.pack(als.fit(ratings, {als.rank: rank, als.maxIter: 0}).userFactors))


def iterate(als: ALS, start: str, by_user: DataFrame, by_book: DataFrame) -> tuple[str, str]:
    """All half steps of ``als`` from the users' factors at ``start``, which stay: the folders of packed users and books."""
    spark, rank, reg = by_user.sparkSession, als.getRank(), als.getRegParam()
    users, books = start, None
    for i in range(als.getMaxIter()):
        old = [users, books] if i else []
        books = half_step.written(half_step.half_step(by_book, users, rank, reg, books))
        users = half_step.written(half_step.half_step(by_user, books, rank, reg, users if i else None))
        # What a half step has replaced is not read again.
        for folder in old:
            delete(spark, folder)
    return users, books


def saved(als: ALS, users: str, books: str, spark: SparkSession) -> ALSModel:
    """The model of packed factors, which are deleted."""
    path = fresh_dir(spark, "model")
    # A saved model is its parameters, which a fit of one rating has too, and two tables, which are replaced below.
    one = spark.createDataFrame([(0, 0, 1.0)], "user_id INT, book_id INT, rating DOUBLE")
    als.fit(one, {als.maxIter: 0}).write().save(path)
    for name, folder in [("userFactors", users), ("itemFactors", books)]:
        half_step.unpack(spark.read.parquet(folder)).write.mode("overwrite").parquet(f"{path}/{name}")
        delete(spark, folder)
    return ALSModel.load(path)


def fit(ratings: DataFrame, config: AlsConfig) -> ALSModel:
    """Spark's ALS with its own starting factors, and half steps that are solved exactly and shuffle no factors."""
    spark = ratings.sparkSession
    shared_dir(spark)
    ratings = usable(ratings)
    n, plain = checked(ratings)
    als = config.estimator(n)
    if not config.max_iter or config.reg <= 0:
        return als.fit(ratings)
    first = start(als, starting(ratings, plain), config.rank)
    with sides(ratings, tasks(ratings, n, config.blocks)) as (by_user, by_book):
        users, books = iterate(als, first, by_user, by_book)
    delete(spark, first)
    return saved(als, users, books, spark)


def score(model: ALSModel, ratings: DataFrame) -> DataFrame:
    """``ratings`` with a prediction; users and books unknown to the model are dropped."""
    return model.transform(ratings)


def grid_metrics(
    training: DataFrame,
    validation: DataFrame,
    config: AlsConfig,
    ranks=RANKS,
    regs=REGS,
    parallelism: int = 1,
) -> DataFrame:
    """Validation RMSE of every grid point: (grid_pos, rank, reg, rmse, scored).

    The RMSE is NULL where no validation row could be scored. ``parallelism`` fits run at once.
    """
    spark = training.sparkSession
    shared_dir(spark)
    training = usable(training).persist(StorageLevel.MEMORY_AND_DISK)
    validation = usable(validation).persist(StorageLevel.MEMORY_AND_DISK)
    n, plain = checked(training)
    als = config.estimator(n)
    # The first parameter varies slowest: ranks outside, regularisation inside.
    grid = ParamGridBuilder().addGrid(als.rank, ranks).addGrid(als.regParam, regs).build()

    def scored(users: str, books: str, rank: int) -> tuple[float | None, int]:
        found = sorted(half_step.errors(truth, users, books, rank).collect())
        rows = sum(block.scored for block in found)
        return (sum(block.total for block in found) / rows) ** 0.5 if rows else None, rows

    blocks, truth = tasks(training, n, config.blocks), None
    try:
        # The start depends on the rank alone.
        some = starting(training, plain)
        starts = {rank: start(als, some, rank) for rank in dict.fromkeys(ranks)}
        if plain_ids(validation):
            truth = half_step.compared(validation, blocks)
        with sides(training, blocks) as (by_user, by_book), ThreadPool(parallelism) as pool:

            @inheritable_thread_target(spark)
            def measure(position: int) -> Row:
                params = grid[position]
                rank, reg = params[als.rank], params[als.regParam]
                if not config.max_iter or reg <= 0:
                    found = rmse(score(als.fit(training, params), validation)).first()
                else:
                    fitted = als.copy(params)
                    users, books = iterate(fitted, starts[rank], by_user, by_book)
                    if truth is not None:
                        found = scored(users, books, rank)
                        for folder in (users, books):
                            delete(spark, folder)
                    else:
                        found = rmse(score(saved(fitted, users, books, spark), validation)).first()
                return Row(position, rank, reg, *found)

            measured = pool.map(measure, range(len(grid)))
        for folder in starts.values():
            delete(spark, folder)
    finally:
        for kept in (training, validation, truth):
            if kept is not None:
                kept.unpersist()
    return spark.createDataFrame(
        measured, "grid_pos INT, rank INT, reg DOUBLE, rmse DOUBLE, scored BIGINT"
    )


def best_point(metrics: DataFrame) -> DataFrame:
    """The first grid point with the least RMSE; empty if nothing was scored."""
    return metrics.filter(F.col("rmse").isNotNull()).orderBy("rmse", "grid_pos").limit(1)


def tuned(config: AlsConfig, metrics: DataFrame) -> AlsConfig:
    """``config`` with the best grid point; unchanged if nothing was scored."""
    best = best_point(metrics).first()
    return replace(config, rank=best.rank, reg=best.reg) if best else config


def tune_by_split(
    ratings: DataFrame,
    config: AlsConfig,
    ranks=RANKS,
    regs=REGS,
    train_ratio: float = 0.75,
    parallelism: int = 1,
):
    """The same search with Spark's own splitter; returns its fitted model."""
    shared_dir(ratings.sparkSession)
    ratings = usable(ratings)
    als = config.estimator(ratings.count())
    return TrainValidationSplit(
        estimator=als,
        estimatorParamMaps=ParamGridBuilder()
        .addGrid(als.rank, ranks)
        .addGrid(als.regParam, regs)
        .build(),
        evaluator=RegressionEvaluator(
            metricName="rmse", labelCol="rating", predictionCol="prediction"
        ),
        trainRatio=train_ratio,
        parallelism=parallelism,
        seed=config.seed,
    ).fit(ratings)
