"""Text-to-vector columns: inputs, encoders, incremental and full runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.hashing import DEFAULT_DIM, hash_embedding
from tessera.functions.scalars import is_blank, json_or
from tessera.sources.tables import among, replace_partitions, require_columns, require_string_columns

HASH_MODEL = "mock"
PROBE_TEXT = "probe"
SEPARATOR_PATH = "$.concat_separator"

# Encoders loaded by this Python worker, by model name.
_LOADED: dict[str, Callable[[list[str]], Sequence[Sequence[float]]]] = {}


# --- inputs ------------------------------------------------------------------------

def concat_sources(df: DataFrame, columns: Sequence[str], separator: str = " ") -> Column:
    """Join string columns in order; NULLs are skipped, ``''`` is kept, all NULL gives ``''``."""
    require_string_columns(df, columns)
    return F.concat_ws(separator, *columns)


def concat_sources_cast(columns: Sequence[str]) -> Column:
    """Variant that turns any column to text and always joins by one space."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows still without a vector; a table without the column has all rows open."""
    return df.where(F.col(target).isNull()) if target in df.columns else df


# --- encoders ----------------------------------------------------------------------

def probe_dimension(encode: Callable[[list[str]], Sequence[Sequence[float]]]) -> int:
    """Vector length of an encoder, learnt from one text before any job starts."""
    return len(encode([PROBE_TEXT])[0])


def with_model(df: DataFrame, text: Column, target: str, model_name: str,
               load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> DataFrame:
    """Fill ``target`` by any encoder, loaded once per Python worker and fed by batches.

    ``load`` returns ``encode(list of texts) -> list of vectors``.
    """
    dim = probe_dimension(load())

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model_name not in _LOADED:
            _LOADED[model_name] = load()
        encode = _LOADED[model_name]
        for texts in batches:
            out = encode(texts.tolist()) if len(texts) else []
            if any(len(v) != dim for v in out):
                raise ValueError(f"model {model_name!r} returned a vector that is not of length {dim}")
            yield pd.Series([[float(x) for x in v] for v in out], dtype=object)

    return df.withColumn(target, vectors(text))


ENDPOINT_RESULT = T.StructType([
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()),
])


def auth_headers(api_key: str = "", header: str = "Authorization") -> dict[str, str]:
    """Request headers; the key is a bearer token unless another header is named."""
    headers = {"Content-Type": "application/json"}
    if api_key:
        bearer = header.lower() == "authorization"
        headers["Authorization" if bearer else header] = f"Bearer {api_key}" if bearer else api_key
    return headers


def with_endpoint(df: DataFrame, text: Column, result: str, post: Callable[[dict, dict], dict], model_name: str,
                  batch_size: int = 64, headers: dict[str, str] | None = None) -> DataFrame:
    """Call an embedding endpoint in batches; add ``result`` as struct(vector, error).

    ``post(payload, headers)`` sends ``{"input", "model"}`` and returns the decoded
    reply with ``data[i].embedding``. A failed batch leaves its rows without a vector
    and says why; other batches go on. The call counts as non-deterministic, so a
    filter on its result doesn't make Spark send the texts a second time.
    """
    headers = headers or auth_headers()

    @F.pandas_udf(ENDPOINT_RESULT)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors, errors = [], []
            for start in range(0, len(texts), batch_size):
                chunk = texts.iloc[start:start + batch_size].tolist()
                try:
                    reply = post({"input": chunk, "model": model_name}, headers)
                    found = [item["embedding"] for item in reply["data"]]
                    if len(found) != len(chunk):
                        raise ValueError(f"{len(found)} vectors for {len(chunk)} texts")
                    vectors += found
                    errors += [None] * len(chunk)
                except Exception as exc:  # one bad batch must not lose the others
                    vectors += [None] * len(chunk)
                    errors += [f"{type(exc).__name__}: {exc}"] * len(chunk)
            yield pd.DataFrame({"vector": vectors, "error": errors}, dtype=object)

    return df.withColumn(result, call.asNondeterministic()(text))


# --- runs --------------------------------------------------------------------------

Encoder = Callable[[Column], Column]


def embed_full(df: DataFrame, columns: Sequence[str], target: str, encode: Encoder = hash_embedding,
               separator: str = " ") -> DataFrame:
    """Compute the whole target column."""
    return df.withColumn(target, encode(concat_sources(df, columns, separator)))


def embed_incremental(df: DataFrame, columns: Sequence[str], target: str, encode: Encoder = hash_embedding,
                      separator: str = " ") -> DataFrame:
    """Fill NULL targets and keep the others; the encoder sees open rows only.

    The text of a finished row is NULL before it reaches the encoder, so no join
    brings the new vectors back to their rows.
    """
    if target not in df.columns:
        return embed_full(df, columns, target, encode, separator)
    text = F.when(F.col(target).isNull(), concat_sources(df, columns, separator))
    return df.withColumn("_new", encode(text)).withColumn(target, F.coalesce(target, "_new")).drop("_new")


def write_back(df: DataFrame, computed: DataFrame, key: str, target: str) -> DataFrame:
    """Attach vectors computed elsewhere to their rows; old values stay where none came."""
    new = computed.select(key, F.col(target).alias("_new"))
    joined = df.join(new, key, "left")
    old = F.col(target) if target in df.columns else F.lit(None).cast(new.schema["_new"].dataType)
    return joined.withColumn(target, F.coalesce("_new", old)).drop("_new")


def embed_table(df: DataFrame, path: str, partition_col: str, columns: Sequence[str], target: str,
                encode: Encoder = hash_embedding, separator: str = " ") -> dict:
    """Incremental run on a stored table: rewrites only partitions with open rows.

    ``df`` must spell partition values as the directories do (``tables.stored`` reads
    them so); otherwise the run fails before it writes.
    """
    part = F.col(partition_col).cast("string")
    open_parts = [r[0] for r in null_target(df, target).select(part).distinct().collect()]
    if not open_parts:
        return {"rows_processed": 0, "status": "no_new_rows"}
    touched = df.where(among(part, open_parts))
    open_rows = null_target(touched, target).count()
    replace_partitions(embed_incremental(touched, columns, target, encode, separator), path,
                       partition_col, open_parts)
    return {"rows_processed": open_rows, "status": "completed"}


def hash_encoder(dim: int = DEFAULT_DIM) -> Encoder:
    return lambda text: hash_embedding(text, dim)


def embed_summary(df: DataFrame, result: str, batch: Column) -> DataFrame:
    """Rows done and failed, and batches, of a run with struct(vector, error) results."""
    done = F.col(f"{result}.vector").isNotNull()
    return df.agg(
        F.count_if(done).alias("succeeded"),
        F.count_if(~done).alias("failed"),
        F.count(F.lit(1)).alias("total_unvectorized"),
        F.countDistinct(batch).alias("batches"),
    )


# --- items of mixed modality -----------------------------------------------------------

def embed_items(items: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """Vector or error per item; ``items`` has id and payload struct(modality, text, binary, uri).

    Text is computed here. Other payloads need a model this library does not carry
    and come out as error rows, so no item is lost.
    """
    text = F.when(F.col("payload.modality") == "TEXT", F.col("payload.text"))
    code = (
        F.when((F.col("payload.modality") == "TEXT") & F.col("payload.text").isNull(), "EMPTY_PAYLOAD")
        .when(F.col("payload.modality") == "TEXT", F.lit(None))
        .when(F.coalesce(F.col("payload.uri"), F.col("payload.binary").cast("string")).isNull(), "EMPTY_PAYLOAD")
        .otherwise("UNSUPPORTED_MODALITY")
    )
    return items.select(
        "id",
        F.col("payload.modality").alias("modality"),
        hash_embedding(text, dim).alias("values"),
        code.alias("error_code"),
        F.when(code.isNotNull(), F.concat(F.lit("modality "), F.col("payload.modality"))).alias("error_message"),
    )


# --- rules -----------------------------------------------------------------------------

def auto_index_requests(rules: DataFrame, indexes: DataFrame) -> DataFrame:
    """Index builds asked for by ``extra.index_config.auto_build`` that do not exist yet."""
    asked = rules.where(F.get_json_object("extra", "$.index_config.auto_build") == "true").select(
        "dataset_uuid",
        F.coalesce(F.get_json_object("extra", "$.index_config.index_name"),
                   F.concat(F.lit("idx_"), "target_column")).alias("index_name"),
        F.col("target_column").alias("column_name"),
        json_or("extra", "$.index_config.index_type", "IVF_PQ").alias("index_type"),
    )
    one = asked.groupBy("dataset_uuid", "index_name").agg(
        F.min(F.struct("column_name", "index_type")).alias("_first"))
    wanted = one.select("dataset_uuid", "index_name", "_first.*", F.lit("BUILDING").alias("status"))
    return wanted.join(indexes.select("dataset_uuid", "index_name"), ["dataset_uuid", "index_name"], "left_anti")


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rules that break a constraint, one row per rule and cause."""
    require_columns(rules, ["rule_id", "dataset_uuid", "target_column", "source_columns", "trigger_type", "cron_expr"])
    causes = F.array_compact(F.array(
        F.when((F.col("trigger_type") == "SCHEDULED") & (F.coalesce("cron_expr", F.lit("")) == ""), "cron_missing"),
        F.when((F.size("source_columns") == 0) | F.exists("source_columns", is_blank), "blank_source"),
    ))
    own = rules.select("rule_id", F.explode(causes).alias("violation"))
    # a repeated (dataset, target) is counted by aggregate; only the repeated pairs travel back
    repeated = rules.groupBy("dataset_uuid", "target_column").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = rules.join(repeated, ["dataset_uuid", "target_column"], "left_semi").select(
        "rule_id", F.lit("duplicate_target").alias("violation"))
    return own.unionByName(twice)
