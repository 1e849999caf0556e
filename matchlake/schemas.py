"""Explicit schemas of the fact, child and dimension tables (never inferred).

Times are epoch milliseconds (UTC); ``play_day`` is the calendar day of ``start_time``.
Unknown is NULL, never zero.
"""
from pyspark.sql import types as T

MATCHES = T.StructType([
    T.StructField("match_id", T.StringType(), False),
    T.StructField("player_id", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("event_key", T.StringType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("end_time", T.LongType()),
    T.StructField("play_day", T.DateType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("my_seat", T.IntegerType()),
    T.StructField("opponent_name", T.StringType()),
    T.StructField("opponent_platform", T.StringType()),
    T.StructField("play_draw", T.StringType()),
    T.StructField("my_result", T.StringType()),
    T.StructField("end_reason", T.StringType()),
    T.StructField("total_turns", T.IntegerType()),
    T.StructField("match_mode", T.StringType()),
    T.StructField("my_deck_tag", T.StringType()),
    T.StructField("my_deck_id", T.StringType()),
    T.StructField("my_deck_version", T.StringType()),
    T.StructField("opp_archetype_tag", T.StringType()),
    T.StructField("is_bot", T.IntegerType()),
    T.StructField("is_abnormal", T.IntegerType()),
])

GAMES = T.StructType([
    T.StructField("match_id", T.StringType(), False),
    T.StructField("game_no", T.IntegerType(), False),
    T.StructField("result", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("play_draw", T.StringType()),
    T.StructField("duration_sec", T.DoubleType()),
])

MULLIGANS = T.StructType([
    T.StructField("match_id", T.StringType(), False),
    T.StructField("game_no", T.IntegerType()),
    T.StructField("seat", T.IntegerType()),
    T.StructField("kept_on", T.IntegerType()),
])

COMMANDERS = T.StructType([
    T.StructField("match_id", T.StringType(), False),
    T.StructField("seat", T.IntegerType()),
    T.StructField("grp_id", T.StringType()),
    T.StructField("partner_idx", T.IntegerType()),
])

RANKS = T.StructType([
    T.StructField("player_id", T.StringType(), False),
    T.StructField("ts", T.LongType()),
    T.StructField("constructed_class", T.StringType()),
    T.StructField("constructed_level", T.IntegerType()),
    T.StructField("limited_class", T.StringType()),
    T.StructField("limited_level", T.IntegerType()),
])

HISTORY_LINE = T.StructType([
    T.StructField("player_id", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("dur", T.LongType()),
    T.StructField("deck", T.StringType()),
    T.StructField("deck_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("on_play", T.IntegerType()),
    T.StructField("win", T.IntegerType()),
])
