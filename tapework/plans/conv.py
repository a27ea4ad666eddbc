"""The conversation timeline: conversations as items, their turns as utterances with estimated token times.

A token lasts 100 ms for each half unit of visual weight; after a turn there is a pause of
((item * 7 + turn * 13) % 10) * 100 ms. Silences lie in pauses and reach into the speech on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import half_units_of_pieces
from ..operators.tokens import tokens_estimated

HALF_UNIT_US = 100_000
#: The delete types in the order in which annotations take turns.
TYPES = ["stutter", "false_start", "exact_repeat", "semantic_repeat", "filler", "redundant"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, utt, text, start_us, end_us, pause_us of each turn."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("utt"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"_length": half_units_of_pieces(F.col("text")) * HALF_UNIT_US, "pause_us": (F.col("item_id") * 7 + F.col("utt") * 13) % 10 * 100_000})
    # Turns are small but become many tokens, so their partitions mustn't be put together by what the turns take.
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id")
    before = Window.partitionBy("item_id").orderBy("utt").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start_us", F.coalesce(F.sum(F.col("_length") + F.col("pause_us")).over(before), F.lit(0)))
    return turns.withColumn("end_us", F.col("start_us") + F.col("_length")).drop("_length")


def conv_tokens(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """Tokens of all turns. turns: those of conv_turns(), where they are at hand; so below."""
    return tokens_estimated(conv_turns(spark, sf_dir) if turns is None else turns)


def conv_media(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """item_id and duration_us: the last turn and its pause."""
    turns = conv_turns(spark, sf_dir) if turns is None else turns
    return turns.groupBy("item_id").agg(F.max(F.col("end_us") + F.col("pause_us")).alias("duration_us"))


def conv_silences(spark: SparkSession, sf_dir: str, min_silence_us: int, turns: DataFrame | None = None) -> DataFrame:
    """Silences in pauses of at least min_silence_us, from 250 ms before the pause to 150 ms after it."""
    turns = conv_turns(spark, sf_dir) if turns is None else turns
    following = F.lead("start_us").over(Window.partitionBy("item_id").orderBy("utt"))
    pauses = turns.withColumn("_next", following).where(F.col("_next").isNotNull() & (F.col("pause_us") >= min_silence_us))
    return pauses.select("item_id", (F.col("end_us") - 250_000).alias("start_us"), (F.col("_next") + 150_000).alias("end_us"))


def conv_deletes(tokens: DataFrame) -> DataFrame:
    """Delete annotations: item_id, seq, type, confidence and positions, an array of token places. Every 29th token starts one."""
    counts = tokens.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(29).cast("long"))))
    j = (F.col("seq") / 29).cast("long")
    n = 1 + j % 3
    step = F.when((j % 11 == 10) & (n > 1), 2).otherwise(1)
    shift = F.when(j % 7 == 6, 28).otherwise(0)
    places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.col("seq") - shift + k * step)
    found = starts.select(
        "item_id", "seq", F.element_at(F.array(*map(F.lit, TYPES)), (j % 6 + 1).cast("int")).alias("type"),
        ((70 + F.col("seq") * 7 % 31) / F.lit(100.0)).alias("confidence"),
        F.filter(places, lambda p: (p >= 0) & (p < F.col("_n"))).alias("positions"),
    )
    return found


#: The same in DuckDB: turns, tokens, media, and silences(min_us) and deletes below.
TURNS_SQL = r"""
conv_pieces AS (
  SELECT conv_id AS item_id, turn AS utt, (conv_id * 7 + turn * 13) % 10 * 100000 AS pause_us,
         regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z0-9_+\-./#]+|\s+|.') AS p
  FROM conversations
), conv_cut AS (
  SELECT item_id, utt, k, piece, greatest(1, 2 * length(shown) - length(regexp_replace(shown, '[^\x00-\x7F]', '', 'g'))) AS units
  FROM (SELECT item_id, utt, k, piece, regexp_replace(piece, '\s', '', 'g') AS shown
        FROM (SELECT item_id, utt, unnest(p) AS piece, unnest(range(len(p))) AS k FROM conv_pieces))
), conv_turns AS (
  SELECT item_id, utt, pause_us, start_us, start_us + length_us AS end_us
  FROM (SELECT item_id, utt, pause_us, length_us,
               (coalesce(sum(length_us + pause_us) OVER (PARTITION BY item_id ORDER BY utt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_us
        FROM (SELECT item_id, utt, pause_us, (coalesce((SELECT sum(units) FROM conv_cut c WHERE c.item_id = p.item_id AND c.utt = p.utt), 0) * 100000)::BIGINT AS length_us
              FROM conv_pieces p))
), conv_tokens AS (
  SELECT c.item_id, c.utt, row_number() OVER (PARTITION BY c.item_id ORDER BY c.utt, k) - 1 AS pos,
         printf('u%04d-w%04d', c.utt, k + 1) AS token_id, piece AS text,
         (t.start_us + 100000 * (sum(units) OVER w - units))::BIGINT AS start_us, (t.start_us + 100000 * sum(units) OVER w)::BIGINT AS end_us
  FROM conv_cut c JOIN conv_turns t ON c.item_id = t.item_id AND c.utt = t.utt
  WINDOW w AS (PARTITION BY c.item_id, c.utt ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), conv_media AS (
  SELECT item_id, max(end_us + pause_us) AS duration_us FROM conv_turns GROUP BY item_id
)"""


def silences_sql(min_us: int) -> str:
    """CTE conv_silences."""
    return f"""
conv_silences AS (
  SELECT item_id, end_us - 250000 AS start_us, next_us + 150000 AS end_us
  FROM (SELECT *, lead(start_us) OVER (PARTITION BY item_id ORDER BY utt) AS next_us FROM conv_turns)
  WHERE next_us IS NOT NULL AND pause_us >= {min_us}
)"""


#: CTE conv_deletes: item_id, seq, type, confidence, positions.
DELETES_SQL = """
conv_deletes AS (
  SELECT item_id, seq, type, confidence, list_filter(list_transform(range(n), lambda k: seq - shift + k * step), lambda p: p >= 0 AND p < total) AS positions
  FROM (SELECT item_id, seq, total, 1 + j % 3 AS n, CASE WHEN j % 11 = 10 AND 1 + j % 3 > 1 THEN 2 ELSE 1 END AS step,
               CASE WHEN j % 7 = 6 THEN 28 ELSE 0 END AS shift, (70 + seq * 7 % 31) / 100.0::DOUBLE AS confidence,
               list_extract(['stutter', 'false_start', 'exact_repeat', 'semantic_repeat', 'filler', 'redundant'], j % 6 + 1) AS type
        FROM (SELECT item_id, total, s AS seq, s // 29 AS j
              FROM (SELECT item_id, total, unnest(range(0, total, 29)) AS s FROM (SELECT item_id, count(*) AS total FROM conv_tokens GROUP BY item_id))))
)"""
