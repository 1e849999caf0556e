"""Small in-memory match rows."""
import datetime as dt

DAY_MS = 86_400_000
BASE = 1_704_067_200_000  # 2024-01-01 UTC

COLUMNS = ("match_id long, player_id long, start_time long, play_day date, my_result string, play_draw string, "
           "event_key string, match_mode string, my_seat int, opponent_name string, my_deck_tag string, "
           "my_deck_id string, my_deck_version string, duration_sec double, is_bot int, is_abnormal int, "
           "source string, opp_archetype_tag string, commanders array<string>, mulligan boolean")


def row(i, **kw):
    t = kw.get("start_time", BASE + i * 60_000)
    day = None if t is None else dt.datetime.fromtimestamp(t / 1000, dt.timezone.utc).date()
    base = dict(match_id=i, player_id=1, start_time=t, play_day=day, my_result="win", play_draw="play",
                event_key="Play_Brawl_Historic", match_mode="BO1", my_seat=1, opponent_name=None, my_deck_tag="d",
                my_deck_id="id", my_deck_version="v", duration_sec=300.0, is_bot=0, is_abnormal=0, source="log",
                opp_archetype_tag=None, commanders=[], mulligan=None)
    base.update(kw)
    base["start_time"] = t
    return base


def matches(spark, rows):
    names = [c.strip().split()[0] for c in COLUMNS.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def sides(spark, pattern, **kw):
    """'PP?D' style rows, one minute apart."""
    side = {"P": "play", "D": "draw", "?": None}
    return matches(spark, [row(i, play_draw=side[c], **kw) for i, c in enumerate(pattern)])


def results(spark, pattern, **kw):
    res = {"w": "win", "l": "loss", "?": None}
    return matches(spark, [row(i, my_result=res[c], **kw) for i, c in enumerate(pattern)])


def as_set(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())
