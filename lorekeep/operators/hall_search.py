"""Search for sessions in two passes: a narrow one inside the hall that a question asks for, whose hits weigh in the wide one.

Both passes meet the questions' words with the sessions' by one join; in the narrow one a word's key also names the hall, so nothing outside
of a question's hall is met. Sessions are rows of words: no task needs all that a session says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import boosts as B
from lorekeep.functions import halls as H
from lorekeep.operators import retrieval as R

# What is left of a distance in the first hall asked for, in another one, and after a hit of the narrow pass; the hits of
# that pass; and above how many characters a turn of the assistant's is searched by itself.
FIRST_HALL, OTHER_HALL, CONFIRMED, NARROW, SPOKEN = 0.75, 0.90, 0.85, 10, 30


def words_of(turns: DataFrame, role: str = "user") -> DataFrame:
    """(id, token): the distinct words that one side says in each session of turns (conv_id, turn, role, text)."""
    said = turns.where((F.col("role") == role) & F.col("text").isNotNull())
    return said.select(F.col("conv_id").alias("id"), F.explode(R.tokens(F.col("text"))).alias("token")).distinct()


def question_words(questions: DataFrame) -> DataFrame:
    """(query_id, token, weight) of questions (query_id, question); each word weighs one."""
    return questions.select("query_id", F.explode(R.tokens(F.col("question"))).alias("token"), F.lit(1.0).alias("weight"))


def confirmed(turns: DataFrame, halls: DataFrame, asked: DataFrame, words: DataFrame, k: int = NARROW) -> DataFrame:
    """(query_id, id): sessions behind the best ``k`` units of each question's first hall, unless that is the general one.

    A unit is what the user says in a session; in the advice hall each longer turn of the assistant's is one too. ``asked`` is
    (query_id, halls).
    """
    halls = halls.select("id", "hall")
    unit = F.struct("id", "turn").alias("id")
    users = words_of(turns).withColumn("turn", F.lit(-1).cast("long"))
    spoken = turns.where((F.col("role") == "assistant") & (F.length("text") > SPOKEN))
    advice = spoken.select(F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), F.explode(R.tokens(F.col("text"))).alias("token"))
    advice = advice.distinct().join(halls.where(F.col("hall") == H.ADVICE).select("id"), "id", "left_semi")
    keyed = lambda df, *columns: df.where(F.col("hall") != H.GENERAL).select(*columns, F.concat("hall", F.lit(":"), "token").alias("token"))
    plain = words.where(~F.col("token").isin(list(R.STOP_WORDS)))
    mine = keyed(plain.join(asked.select("query_id", F.get("halls", 0).alias("hall")), "query_id"), "query_id", "weight")
    held = keyed(users.unionByName(advice).join(halls, "id"), unit)
    return R.best_by_words(held, mine, k).select("query_id", "id.id").distinct()


def search(turns: DataFrame, halls: DataFrame, questions: DataFrame, k: int = 50, narrow: int = NARROW, keyword_weight: float = B.KEYWORDS) -> DataFrame:
    """(query_id, id, hall, confirmed, distance, rank): each question's ``k`` nearest sessions that share a word with it, ranked anew by halls.

    ``turns`` has (conv_id, turn, role, text), ``halls`` one row (id, hall) for each session, ``questions`` (query_id, question, halls) with the
    halls likeliest first. A session's distance is one less the share of the question's words that its user says, less what keywords take
    off; of that remain 0.75 in the first hall (unless general), 0.90 in another of the halls, and 0.85 after a hit of the narrow pass. Ties go
    by id. Null texts say nothing; sessions without a hall, and questions without words or halls, have no bonus.
    """
    words = question_words(questions)
    asked = questions.select("query_id", "halls")
    wide = R.best_by_words(words_of(turns), words, k)
    hits = confirmed(turns, halls, asked, words, narrow).withColumn("confirmed", F.lit(True))
    found = wide.join(halls.select("id", "hall"), "id", "left").join(asked, "query_id").join(hits, ["query_id", "id"], "left")
    first = F.get("halls", 0)
    bonus = F.when((F.col("hall") == first) & (first != H.GENERAL), FIRST_HALL).when(F.array_contains("halls", F.col("hall")), OTHER_HALL).otherwise(1.0)
    fused = (1 - F.col("score")) * (1 - keyword_weight * F.col("score")) * bonus * F.when(F.col("confirmed"), CONFIRMED).otherwise(1.0)
    scored = found.select("query_id", "id", "hall", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.round(fused, 6).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
