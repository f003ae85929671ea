from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import index as I
from vecspark.operators.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]


def registrar() -> tuple[dict[str, tuple[Query, str | None]], Callable]:
    registry: dict[str, tuple[Query, str | None]] = {}

    def add(name: str, sql: str | None = None):
        def keep(f: Query) -> Query:
            registry[name] = (f, sql)
            return f

        return keep

    return registry, add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str, scaled: bool = False) -> DataFrame:
    """(id, vec, label); scaled: lengths 1 to 7, as unit vectors rank alike under every metric."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("long").alias("label"))
    return e.withColumn("vec", F.transform("vec", lambda x: x * (1 + F.col("id") % 7))) if scaled else e


def query_set(e: DataFrame) -> DataFrame:
    """The stated query set: the rows whose id is divisible by 20."""
    return e.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, d: str, name: str, make: Callable):
    """make(), done once in a session for the files that the embeddings of d are in; tables are written, and read by every query."""
    files = load(spark, d, "embeddings").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = files.agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size")).first()
    key = (spark.sparkContext.applicationId, d, name, *state)
    if key not in _kept:
        made = make()
        _kept[key] = cut(made) if isinstance(made, DataFrame) else made
    return _kept[key]


def near_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, pos, dst, distance): every row's 8 nearest others."""
    return kept(spark, d, "near_graph", lambda: I.near_graph(base(spark, d), 8))


def r6(c: str):
    return F.round(c, 6).alias(c)


def vec_text(v):
    """A vector as millionths, so that whole vectors are compared."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")


def vec_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda y: round(y * 1e6)::BIGINT), ',')"


#: SQL of base(), its scaled form, of the squared distance, and of the 8 nearest others of every row.
E_SQL = "E AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings)"
S_SQL = "E AS (SELECT vec_id::BIGINT AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS vec, label::BIGINT AS label FROM embeddings)"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
G_SQL = E_SQL + f", P AS (SELECT a.id AS src, b.id AS dst, {L2.format(a='a.vec', b='b.vec')} AS distance FROM E a JOIN E b ON a.id <> b.id), G AS (SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS pos, dst, distance FROM P) WHERE pos <= 8)"
#: The same, made once: what a recursion joins is made again at every step otherwise.
GM_SQL = G_SQL.replace("G AS (", "G AS MATERIALIZED (")
