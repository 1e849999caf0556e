"""Projection columns derived from keys and codes: event family, eligibility, mode, runs, ranks, tags."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .winrate import as_col

# ---- fixed values ---------------------------------------------------------------------------
FAMILIES = ("weekly", "brawl", "draft", "sealed", "ladder", "play", "constructed", "other")
ARCHETYPES = ("Aggro", "Control", "Combo", "Ramp", "Midrange", "Other")
NEVER_CONSTRUCTED = ("Brawl", "Draft", "Sealed", "Momir", "Jump_In", "JumpIn", "Cube")
WEEKLY_DENIED = ("Momir", "Brawl", "Draft", "Sealed", "Cube", "Chaos", "Omniscience")
WEEKLY_ALLOWED = ("AllAccess", "Artisan", "Pauper", "Standard", "Historic", "Explorer", "Timeless",
                  "Alchemy", "Pioneer", "Shakeup", "Singleton", "Constructed")
CONSTRUCTED_MARKERS = ("Constructed", "Cons_Event", "Explorer_Event", "Metagame_Challenge",
                       "Standard_Challenge", "Explorer_Challenge", "AllAccess", "HistoricArtisan",
                       "Pauper", "Artisan")
# prefix, kind, win cap, loss cap, break-even wins
CAPPED_RUNS = (
    ("PickTwoDraft_", "picktwo", 4, 2, 2),
    ("PremierDraft_", "premier", 7, 3, 3),
    ("QuickDraft_", "quick", 7, 3, 4),
    ("TradDraft_", "trad", 3, 2, 2),
    ("TraditionalDraft_", "trad", 3, 2, 2),
    ("ContenderDraft_", "contender", 7, 3, 4),
    ("Trad_Sealed_", "trad_sealed", 4, 2, 4),
    ("TraditionalSealed_", "trad_sealed", 4, 2, 4),
    ("Sealed_", "sealed", 7, 3, 6),
)
RUN_BANDS = ("cap", "near", "even", "low", "bust")
RANKS = ("Bronze", "Silver", "Gold", "Platinum", "Diamond", "Mythic")
LIMITED_SHARE = 0.6
# ---------------------------------------------------------------------------------------------


def contains_any(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def _text(col) -> Column:
    return F.coalesce(as_col(col), F.lit(""))


def event_family(event="event_key") -> Column:
    e = _text(event)
    return (F.when(e.startswith("MWM_"), "weekly")
            .when(e.contains("Brawl"), "brawl")
            .when(e.contains("Draft"), "draft")
            .when(e.contains("Sealed"), "sealed")
            .when((e == "Ladder") | e.endswith("_Ladder"), "ladder")
            .when((e == "Play") | e.endswith("_Play"), "play")
            .when(e.contains("Event"), "constructed")
            .otherwise("other"))


def is_brawl(event="event_key") -> Column:
    return _text(event).contains("Brawl")


def is_draft(event="event_key") -> Column:
    return _text(event).contains("Draft")


def is_limited(event="event_key") -> Column:
    return _text(event).contains("Draft") | _text(event).contains("Sealed")


def is_constructed_event(event="event_key") -> Column:
    """Whether hand-given opponent archetypes make sense for this event."""
    e = _text(event)
    weekly_name = F.substring(e, 5, 1 << 20)
    weekly = ~contains_any(weekly_name, WEEKLY_DENIED) & contains_any(weekly_name, WEEKLY_ALLOWED)
    return (F.when((e == "") | contains_any(e, NEVER_CONSTRUCTED), False)
            .when(event_family(e).isin("ladder", "play"), True)
            .when(e.contains("Decathlon"), True)
            .when(e.startswith("MWM_"), weekly)
            .otherwise(contains_any(e, CONSTRUCTED_MARKERS)))


def match_mode(event="event_key", game_count=None) -> Column:
    e = _text(event)
    low = F.lower(e)
    games = F.lit(0) if game_count is None else F.coalesce(as_col(game_count), F.lit(0))
    best_of_three = ((games > 1) | e.startswith("Traditional") | e.startswith("TradDraft_")
                     | e.startswith("Trad_") | low.contains("bestof3"))
    best_of_one = (low.contains("bestof1") | e.isin("Ladder", "Play", "Play_Brawl_Historic")
                   | e.startswith("QuickDraft_") | e.startswith("PremierDraft_")
                   | e.startswith("PickTwoDraft_"))
    return F.when(best_of_three, "BO3").when(best_of_one, "BO1").otherwise("unknown")


def run_spec(event="event_key") -> Column:
    """struct(kind, cap_wins, cap_losses, break_even), NULL for events without fixed run borders."""
    e = as_col(event)
    out = None
    for prefix, kind, wins, losses, even in CAPPED_RUNS:
        spec = F.struct(F.lit(kind).alias("kind"), F.lit(wins).alias("cap_wins"),
                        F.lit(losses).alias("cap_losses"), F.lit(even).alias("break_even"))
        out = F.when(e.startswith(prefix), spec) if out is None else out.when(e.startswith(prefix), spec)
    return out


def run_band(wins, cap_wins, break_even) -> Column:
    wins, cap_wins, break_even = as_col(wins), as_col(cap_wins), as_col(break_even)
    return (F.when(wins >= cap_wins, "cap").when(wins == cap_wins - 1, "near")
            .when(wins <= 0, "bust").when(wins >= break_even, "even").otherwise("low"))


def band_order(band) -> Column:
    """1 for the best band."""
    return F.array_position(F.array(*[F.lit(b) for b in RUN_BANDS]), as_col(band))


def tag_list(text) -> Column:
    """Comma list -> ordered distinct list of the known archetypes."""
    known = F.array(*[F.lit(a) for a in ARCHETYPES])
    parts = F.transform(F.split(_text(text), ","), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: F.array_contains(known, t)))


def clean_tag_array(tags) -> Column:
    known = F.array(*[F.lit(a) for a in ARCHETYPES])
    return F.array_distinct(F.filter(F.transform(as_col(tags), lambda t: F.trim(t)),
                                     lambda t: F.array_contains(known, t)))


def join_tags(text) -> Column:
    return F.array_join(tag_list(text), ",")


def rank_score(cls, level) -> Column:
    """Monotone scale: Bronze 4 = 1 .. Diamond 1 = 20, Mythic = 21; NULL when not recognised."""
    cls, level = as_col(cls), as_col(level)
    idx = F.array_position(F.array(*[F.lit(r) for r in RANKS]), cls) - 1
    return (F.when(cls == "Mythic", F.lit(21))
            .when((idx >= 0) & level.between(1, 4), (idx * 4 + 5 - level).cast("int")))


def score_label(score) -> Column:
    score = as_col(score)
    step = (score - 1).cast("int")
    cls = F.element_at(F.array(*[F.lit(r) for r in RANKS]), F.floor(step / 4).cast("int") + 1)
    return F.when(score >= 21, "Mythic").otherwise(F.concat(cls, F.lit(" "), (4 - step % 4).cast("string")))


def stable_slot(evidence: list[Column], slots: Column | int) -> Column:
    """Same evidence, same slot: first eight hex digits of SHA-1 over '|'-joined parts, modulo n."""
    joined = F.concat_ws("|", *[c.cast("string") for c in evidence])
    n = slots if isinstance(slots, Column) else F.lit(slots)
    return F.conv(F.substring(F.sha1(joined), 1, 8), 16, 10).cast("bigint") % n


def minute_label(ms) -> Column:
    return F.date_format(F.timestamp_millis(as_col(ms)), "yyyy-MM-dd HH:mm")


def short_time(ms) -> Column:
    return F.date_format(F.timestamp_millis(as_col(ms)), "MM-dd HH:mm")


def scoop_note(side="play_draw", reason="end_reason") -> Column:
    return F.when(as_col(side).isNull() & (as_col(reason) == "Concede"), "scoop")


def front_face(name) -> Column:
    """Front face of a multi-face name without the rebalanced-card prefix."""
    name = as_col(name)
    face = F.trim(F.element_at(F.split(name, r"\s+/{2,3}\s+"), 1))
    face = F.when(face == "", name).otherwise(face)
    bare = F.trim(F.regexp_replace(face, r"(?i)^A-\s*", ""))
    return F.when(bare == "", face).otherwise(bare)


def deck_kind(n, brawl, limited) -> Column:
    n, brawl, limited = as_col(n), as_col(brawl), as_col(limited)
    return (F.when(n == 0, "unknown").when(limited / n >= LIMITED_SHARE, "limited")
            .when(brawl / n >= LIMITED_SHARE, "brawl").otherwise("constructed"))


def csv_safe(value) -> Column:
    """Blank for NULL; drop control and zero-width characters, trim, quote a leading formula sign."""
    s = as_col(value).cast("string")
    s = F.regexp_replace(s, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFEFF\\u200B]", "")
    s = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@", "\t", "\r"),
                             F.concat(F.lit("'"), s)).otherwise(s), F.lit(""))
