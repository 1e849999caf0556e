"""Display labels of event keys. Labels are presentation only and never used as keys."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import classify as C
from .winrate import as_col

# ---- fixed values: label vocabulary ---------------------------------------------------------
SETS = {
    "DMU": "多明纳里亚：众志成城", "MOM": "邪军压境", "MID": "依尼翠：黯夜猎踪", "VOW": "依尼翠：腥红婚誓",
    "NEO": "神河：霓朝纪", "ELD": "艾卓王权", "BLB": "斑隆洛", "OTJ": "光雷驿镖客",
    "DSK": "暮悲邸：鬼屋惊魂", "SNC": "新卡佩纳：喧嚣黑街", "BRO": "兄弟之战", "ONE": "非瑞克西亚：万界归一",
    "STX": "斯翠海文", "LCI": "依夏兰迷窟", "MKM": "卡洛夫庄园谋杀案", "HOB": "霍比特人",
    "SOS": "斯翠海文的秘密", "TMT": "忍者神龟", "TLA": "降世神通：最后的气宗", "FIN": "最终幻想",
    "HBG": "炼金新篇：博德之门",
}
EXACT = {
    "Ladder": "标准排位", "Traditional_Ladder": "传统标准排位", "Play": "标准自由对战",
    "Play_Brawl_Historic": "史迹争锋", "Play_Brawl": "标准争锋", "AIBotMatch": "机器人练习",
    "DualColorPrecons": "双色预组套牌对战", "Constructed_BestOf3": "传统构筑赛（BO3）",
    "DirectGameTournamentMode": "直接挑战（比赛模式）", "DirectGameTournamentExplorer": "直接挑战（探险）",
}
FORMATS = {"Standard": "标准", "Historic": "史迹", "Explorer": "探险", "Timeless": "无境",
           "Alchemy": "炼金", "Pioneer": "先驱"}
PREFIXES = {
    "PremierDraft_": "优选轮抽", "QuickDraft_": "快速轮抽", "PickTwoDraft_": "选两张轮抽",
    "TradDraft_": "传统轮抽", "TraditionalDraft_": "传统轮抽", "ContenderDraft_": "竞争者轮抽",
    "Trad_Sealed_": "传统现开", "TraditionalSealed_": "传统现开", "Sealed_": "现开", "MWM_": "周中",
    "Festival_": "节庆活动", "Jump_In_": "Jump In／跳入对战", "Brawl_Challenge_": "争锋挑战赛",
    "CompCons_Metagame_Challenge_": "构筑环境挑战赛", "Constructed_Event_": "标准构筑赛",
    "Traditional_Cons_Event_": "传统标准构筑赛", "Yargle_Day_": "雅骨尔日",
    "AlchemyPrecons_": "炼金预组套牌对战", "AlchemyRebalanceEvent_": "炼金调整活动",
    "AlchemyWelcome_": "炼金入门活动", "Constructed_": "构筑活动",
}
TERMS = {
    **FORMATS, "Brawl": "争锋", "BrawlBuilder": "争锋构筑", "Momir": "莫秘维", "OmniscienceDraft": "全知轮抽",
    "Omniscience": "全知", "Artisan": "工匠", "Pauper": "纯普", "HistoricPauper": "史迹纯普",
    "StandardPauper": "标准纯普", "HistoricArtisan": "史迹工匠", "ArtisanBrawl": "工匠争锋",
    "CascadeBrawl": "倾曳争锋", "HistoricBrawl": "史迹争锋", "HistoricShakeup": "史迹变局",
    "StandardShakeup": "标准变局", "Singleton": "单卡", "HistoricSingletonAA": "史迹单卡全卡开放",
    "AllAccess": "全卡开放", "BotDraft": "机器人轮抽", "Sealed": "现开", "Cube": "万智牌轮抽盒",
    "Cascade": "倾曳", "JumpIn": "Jump In／跳入对战", "AlchemyPrecons": "炼金预组套牌",
    "ChallengerDecks": "挑战者套牌", "FutureAlchemy": "未来炼金", "PioneerLegal": "先驱合法牌",
    "SlowStart": "缓慢开局", "SlowStartStandard": "标准缓慢开局", "SlowStartAlchemy": "炼金缓慢开局",
    "3Sets": "三系列构筑", "RuleOfLaw": "法治", "Storydecks": "故事套牌", "AprilFools": "愚人节",
    "TradDraft": "传统轮抽", "TradExplorer": "传统探险", "OmniDraft": "全知轮抽",
}
NO_EVENT = "赛事未记录"
TRADITIONAL = "传统"
QUEUES = {"_Ladder": "排位", "_Play": "自由对战"}
SERIES = {"_Event": "构筑赛", "_Challenge": "挑战赛"}
CONSTRUCTED = "构筑"
SEPARATOR = " · "
DECATHLON = r"^Decathlon(\d{4})_(\d+)_(.+)$"
# ---------------------------------------------------------------------------------------------


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def tail_label(text: Column) -> Column:
    """Translate the '_'-separated rest of a key: dates, constructed sets, terms, set codes, else raw."""
    words = {**SETS, **TERMS}

    def token(t: Column) -> Column:
        code = F.regexp_replace(t, "Constructed$", "")
        return (F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2),
                                                        F.substring(t, 7, 2)))
                .when(t.endswith("Constructed"),
                      F.concat(F.coalesce(F.try_element_at(_lookup(SETS), code), code), F.lit(CONSTRUCTED)))
                .otherwise(F.coalesce(F.try_element_at(_lookup(words), t), t)))

    parts = F.filter(F.transform(F.split(text, "_"), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_join(F.transform(parts, token), SEPARATOR)


def _after(text: Column, n: int) -> Column:
    return F.substring(text, n + 1, 1 << 20)


def _parts(head: Column, rest: Column | None = None) -> Column:
    return F.struct(head.alias("head"), (F.lit("") if rest is None else rest).alias("rest"))


def friendly_event(event="event_key") -> Column:
    """First matching rule gives a head and an untranslated rest; the rest is translated once."""
    e = as_col(event)
    core = F.regexp_replace(e, "^Traditional_", "")
    lead = F.when(e.startswith("Traditional_"), F.lit(TRADITIONAL)).otherwise(F.lit(""))
    rules: list[tuple[Column, Column]] = [
        (e.isNull() | e.isin("", "(unknown)"), _parts(F.lit(NO_EVENT))),
        (e.isin(*EXACT), _parts(F.try_element_at(_lookup(EXACT), e))),
        (e.rlike(DECATHLON), _parts(F.concat(
            F.lit("十项全能 "), F.regexp_extract(e, DECATHLON, 1), F.lit(SEPARATOR + "第 "),
            F.regexp_extract(e, DECATHLON, 2), F.lit(" 项")), F.regexp_extract(e, DECATHLON, 3))),
    ]
    for key, name in FORMATS.items():
        for suffix, queue in QUEUES.items():
            rules.append((core == key + suffix, _parts(F.concat(lead, F.lit(name + queue)))))
        for suffix, series in SERIES.items():
            stem = key + suffix
            rules.append(((core == stem) | core.startswith(stem + "_"),
                          _parts(F.concat(lead, F.lit(name + series)), _after(core, len(stem)))))
    for prefix, name in PREFIXES.items():
        rules.append((e.startswith(prefix), _parts(F.lit(name), _after(e, len(prefix)))))
    first, *more = rules
    chosen = reduce(lambda acc, r: acc.when(*r), more, F.when(*first)).otherwise(_parts(e))
    bound = F.transform(F.array(chosen), lambda c: F.concat_ws(
        SEPARATOR, c["head"], F.nullif(tail_label(c["rest"]), F.lit(""))))
    return F.element_at(bound, 1)


def event_dimension(matches: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per distinct event key: family, eligibility, default mode, label (override wins)."""
    dim = matches.select("event_key").filter("event_key is not null").distinct()
    label = friendly_event()
    if overrides is not None:
        dim = dim.join(overrides.select("event_key", F.col("label").alias("_custom")), "event_key", "left")
        label = F.coalesce(F.nullif(F.trim("_custom"), F.lit("")), label)
    return dim.select("event_key", C.event_family().alias("family"),
                      C.is_constructed_event().alias("constructed_eligible"),
                      C.match_mode().alias("event_mode"), label.alias("event_label"))


def with_event_labels(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``event_label``: each distinct key is translated once and joined back."""
    dim = event_dimension(rows, overrides).select("event_key", "event_label")
    return (rows.join(dim, "event_key", "left")
            .withColumn("event_label", F.coalesce("event_label", F.lit(NO_EVENT))))
