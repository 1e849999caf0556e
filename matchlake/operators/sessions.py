"""Rebuilding matches from parsed log records: segmentation, seats, decks, results, games, cards, mulligans.

File-wide state (which match is open, which deck an event uses) is carried with chunked scans; the
windows below run inside one match of one file, whose size is that of a single game session.

The work has two halves. ``extract`` reads records and yields what they say, without knowing whose log it is: starts with
their rosters, results, first active seats, hands, shown cards, decks, ranks, votes on the owner's id. ``resolve`` turns that
into facts for given identities. What is stored by a stream is the first half, so that an identity or a deck learned
late reaches every match read before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as C
from ..session import stored
from ..sources.logs import USER_ID, own_timestamp
from .ordered import running, running_rows

SEG = ["file", "seg"]
MATCH = ["owner", "match_id"]  # two players may log the same match


# what readers look for in a record's text: looked up once, when the record is segmented, and kept as bits of ``kind``
NAMES = {"start": "MatchGameRoomStateType_Playing", "completion": "MatchGameRoomStateType_MatchCompleted", "result": "finalMatchResult",
         "deck": "CourseDeckSummary", "state": "ameStateMessage", "choice": "ulliganResp", "rank": "constructedClass",
         "roster": "reservedPlayers"}
BITS = {name: 1 << i for i, name in enumerate(NAMES)}


def _names(name: str) -> Column:
    """Records whose text names this; the files of all other kinds are left unread."""
    return F.col("kind").bitwiseAND(BITS[name]) != 0


def _int(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).try_cast("int")


def segment(payloads: DataFrame) -> DataFrame:
    """Add ``seg`` (the place of the last match start in the file, 0 before the first), ``open`` and ``ts``.

    'Playing' opens a match and closes the one before; 'MatchCompleted' closes. The closing record still
    carries the place of the match it closes.
    """
    config = F.col("p.matchGameRoomStateChangedEvent.gameRoomInfo")["gameRoomConfig"]
    kind = sum(F.when(F.contains("text", F.lit(text)), bit).otherwise(0) for text, bit in zip(NAMES.values(), BITS.values()))
    keyed = payloads.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("kind", kind)
    proper = _names("start") & config["reservedPlayers"].isNotNull()
    users = F.when(_names("roster") & (F.col("part") == 0), F.regexp_extract_all("text", F.lit(USER_ID), F.lit(1)))
    place = F.col("pos") * 8 + F.least(F.col("part"), F.lit(6)) + 1
    # the text itself has said all it had to say: it is neither shuffled nor written
    keyed = keyed.withColumn("starts", F.coalesce(proper, F.lit(False))).withColumn("completes", _names("completion")).withColumn(
        "users", users).withColumn("stamp", own_timestamp()).withColumn(
        "state", F.when(proper, True).when(_names("start") | F.col("completes"), False)).select(
        "owner", "file", "chunk", "pos", "part", "p", "starts", "completes", "users", "stamp", "state", "kind")
    carried = running_rows(keyed, ["file"], "chunk", ["pos", "part"], lasts={
        "seg": F.when(F.col("starts"), place), "open": F.col("state"), "ts": F.col("stamp")}, by="kind")
    return carried.drop("stamp", "state").withColumn("open", F.coalesce("open", F.lit(False))).withColumn("seg", F.coalesce("seg", F.lit(0)))


def match_starts(events: DataFrame) -> DataFrame:
    """One row per match start: ids, event, time and roster."""
    config = F.col("p.matchGameRoomStateChangedEvent.gameRoomInfo.gameRoomConfig")
    begun = events.filter(_names("start")).filter("starts").withColumn("players", config["reservedPlayers"])
    return begun.select(
        "owner", "file", "chunk", "pos", "seg",
        # a match without id is told apart by where it was read
        F.coalesce(config["matchId"], F.concat(F.lit("?"), "file", F.lit("#"), "seg")).alias("match_id"),
        F.coalesce(config["eventId"], F.expr("get(filter(players, p -> p.eventId is not null), 0).eventId")).alias("event_key"),
        F.col("ts").alias("start_ts"), "players")


def seated(starts: DataFrame, identities: DataFrame) -> DataFrame:
    """Starts with the owner's seat and team and the first other named player, as far as the owner's id is known."""
    known = starts.join(identities, "owner", "left").withColumn("me", F.expr("get(filter(players, p -> p.userId = my_user), 0)"))
    other = F.expr(
        "get(filter(players, p -> p.userId is distinct from my_user and coalesce(p.playerName, '') <> ''), 0)")
    team = _int("me.teamId")
    return known.withColumn("opp", F.when(F.col("me").isNotNull(), other)).select(
        *starts.columns, team.alias("my_team"), F.coalesce(_int("me.systemSeatId"), team).alias("my_seat"),
        F.col("opp.playerName").alias("opponent_name"), F.col("opp.platformId").alias("opponent_platform"))


def open_matches(events: DataFrame, identities: DataFrame) -> DataFrame:
    """One row per match start: ids, event, own seat and team, first other named player."""
    return seated(match_starts(events), identities)


# ---- decks ----------------------------------------------------------------------------------
def course_decks(events: DataFrame) -> DataFrame:
    """Every 'this event uses this deck' record: name, id, build print, command zone."""
    top = F.struct(F.col("p.InternalEventName").alias("InternalEventName"),
                   F.col("p.CourseDeckSummary").alias("CourseDeckSummary"), F.col("p.CourseDeck").alias("CourseDeck"))
    every = F.concat(F.array(top, F.col("p.Course")), F.coalesce(F.col("p.Courses"), F.array()))
    rows = events.filter(_names("deck")).select(
        "owner", "file", "chunk", "pos", F.posexplode(every).alias("i", "c"))
    rows = rows.filter("c.InternalEventName is not null and c.CourseDeckSummary is not null")
    deck = F.col("c.CourseDeck")
    content = F.to_json(F.struct(*[F.array_sort(F.coalesce(deck[z], F.array())).alias(z)
                                   for z in ("MainDeck", "Sideboard", "CommandZone", "Companions")]))
    build = F.when(F.size(F.coalesce(deck["MainDeck"], F.array())) > 0,
                   F.concat(F.lit("local:"), F.substring(F.sha2(content, 256), 1, 16)))
    zone = F.array_distinct(F.transform(
        F.filter(F.coalesce(deck["CommandZone"], F.array()),
                 lambda x: x["cardId"].isNotNull() & (x["quantity"].try_cast("int") > 0)), lambda x: x["cardId"]))
    return rows.select("owner", "file", "chunk", "pos", F.col("c.InternalEventName").alias("event_key"), F.struct(
        F.col("c.CourseDeckSummary.Name").alias("tag"), F.col("c.CourseDeckSummary.DeckId").alias("id"),
        build.alias("version"), zone.alias("zone")).alias("deck"))


def attach_decks(starts: DataFrame, decks: DataFrame) -> DataFrame:
    """Latest deck of the same event before the match start; a mapping learned only later fills the gap."""
    both = decks.withColumn("seg", F.lit(None).cast("bigint")).select(
        "owner", "event_key", "file", "chunk", "pos", "seg", "deck").unionByName(
        starts.select("owner", "event_key", "file", "chunk", "pos", "seg").withColumn(
            "deck", F.lit(None).cast(decks.schema["deck"].dataType)))
    both = both.filter("event_key is not null").withColumn("piece", F.struct("file", "chunk"))
    carried = running(both, ["owner", "event_key"], "piece", ["pos"], lasts={"asof": F.col("deck")})
    at_start = carried.filter("seg is not null").select("file", "seg", "asof")
    first = decks.groupBy("owner", "event_key").agg(F.min_by("deck", F.struct("file", "chunk", "pos")).alias("first_deck"))
    return (starts.join(at_start, SEG, "left").join(first, ["owner", "event_key"], "left")
            .withColumn("deck", F.coalesce("asof", "first_deck"))
            .withColumn("deck_in_time", F.col("asof").isNotNull()).drop("asof", "first_deck"))


# ---- results --------------------------------------------------------------------------------
def routed_results(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Result payloads with the match they are addressed to.

    A result with an id goes to that match wherever it is; one without goes to the open match, or to the
    last closed one.
    """
    fmr = F.coalesce(F.col("p.finalMatchResult"), F.col("p.matchGameRoomStateChangedEvent.gameRoomInfo.finalMatchResult"))
    found = events.filter(_names("result")).select(
        "owner", *SEG, "chunk", "pos", "part", "open", fmr.alias("r")).filter("r.resultList is not null")
    ids = starts.select(*SEG, F.col("match_id").alias("seg_match"))
    routed = found.join(ids, SEG, "left").withColumn("rid", F.nullif(F.trim("r.matchId"), F.lit("")))
    return routed.withColumn("match_id", F.coalesce("rid", "seg_match")).filter("match_id is not null").withColumn(
        "late_legacy", F.col("rid").isNull() & ~F.col("open")).drop("rid")


def payload_entries(routed: DataFrame) -> DataFrame:
    """Result entries, each payload applied once per match."""
    at = F.struct("file", "chunk", "pos")
    seen = F.struct("r", "late_legacy", F.col("seg").alias("seen_seg"), F.col("open").alias("seen_open"), F.col("seg_match").alias("seen_match"))
    once = routed.withColumn("payload", F.sha2(F.to_json("r.resultList"), 256)).groupBy(*MATCH, "payload").agg(
        F.min(at).alias("at"), F.min_by(seen, at).alias("seen")).select(*MATCH, "at", "seen.*")
    return once.select(*MATCH, "at", "late_legacy", "seen_seg", "seen_open", "seen_match",
                       F.posexplode("r.resultList").alias("i", "e")).select(
        *MATCH, "at", "i", "late_legacy", "seen_seg", "seen_open", "seen_match", F.col("e.scope").alias("scope"),
        _int("e.winningTeamId").alias("winner"), F.regexp_replace("e.reason", "ResultReason_", "").alias("reason"))


def result_entries(entries: DataFrame, starts: DataFrame) -> DataFrame:
    """Entries without id-less blocks that come after their closed match was decided: these say nothing new."""
    decided = (entries.filter("scope = 'MatchScope_Match' and winner is not null and not late_legacy")
               .join(own_teams(starts).filter("my_team is not null"), MATCH).groupBy(*MATCH).agg(F.min("at").alias("decided_at")))
    stale = F.col("late_legacy") & F.coalesce(F.col("decided_at") < F.col("at"), F.lit(False))
    return entries.join(decided, MATCH, "left").filter(~stale).drop("decided_at")


def own_teams(starts: DataFrame) -> DataFrame:
    """(owner, match_id) -> the player's own team, the first known one."""
    at = F.struct("file", "chunk", "pos")
    return starts.groupBy(*MATCH).agg(F.min_by("my_team", F.when(F.col("my_team").isNotNull(), at)).alias("my_team"))


def decided_matches(entries: DataFrame, teams: DataFrame) -> DataFrame:
    """(owner, match_id) -> my_result, end_reason: the first that can be told. Late id-less blocks never override."""
    order = F.struct("late_legacy", "at", "i")
    known = entries.filter("scope = 'MatchScope_Match'").join(teams, MATCH)
    outcome = F.when(F.col("winner") == F.col("my_team"), "win").otherwise("loss")
    usable = F.col("winner").isNotNull() & F.col("my_team").isNotNull()
    return known.groupBy(*MATCH).agg(
        F.min_by(outcome, F.when(usable, order)).alias("my_result"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("end_reason"))


def decided_games(entries: DataFrame, teams: DataFrame) -> DataFrame:
    """(owner, match, game_no) -> result, reason: the k-th game result of a match belongs to its k-th game."""
    per_match = Window.partitionBy(*MATCH).orderBy("at", "i")  # games of one match
    outcome = F.when(F.col("winner").isNotNull() & F.col("my_team").isNotNull(),
                     F.when(F.col("winner") == F.col("my_team"), "win").otherwise("loss"))
    return (entries.filter("scope = 'MatchScope_Game'").join(teams, MATCH)
            .select(*MATCH, F.row_number().over(per_match).alias("game_no"), outcome.alias("result"), "reason"))


# ---- inside a match -------------------------------------------------------------------------
def _messages(events: DataFrame) -> DataFrame:
    rows = events.filter(_names("state")).filter("open and seg > 0")
    return rows.select(*SEG, "chunk", "pos", F.posexplode("p.greToClientEvent.greToClientMessages").alias("msg", "g")).select(
        *SEG, "chunk", "pos", "msg", F.coalesce("g.gameStateMessage", "g.queuedGameStateMessage").alias("s"))


def timeline(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Turns, game results and mulligan decisions of each match in order, with the running game index.

    Turn 1 opens a new game when a later turn or a game result was seen since the last game began.
    """
    order = ["chunk", "pos", "stage", "msg"]
    none = F.lit(None)
    turn = _int("s.turnInfo.turnNumber")
    turns = _messages(events).filter("s.turnInfo is not null").select(
        *SEG, "chunk", "pos", F.lit(1).alias("stage"), "msg", F.coalesce(turn, F.lit(0)).alias("turn"),
        _int("s.turnInfo.activePlayer").alias("active"), none.cast("string").alias("decision"),
        none.cast("int").alias("kept"), none.cast("int").alias("seat"))
    over = entries.filter("scope = 'MatchScope_Game' and seen_open and seen_match = match_id").select(
        F.col("at.file").alias("file"), F.col("seen_seg").alias("seg"), F.col("at.chunk").alias("chunk"),
        F.col("at.pos").alias("pos"), F.lit(0).alias("stage"), F.col("i").alias("msg"), F.lit(-1).alias("turn"),
        none.cast("int").alias("active"), none.cast("string").alias("decision"), none.cast("int").alias("kept"),
        none.cast("int").alias("seat"))
    resp = F.col("p.mulliganResp")
    choices = events.filter(_names("choice")).filter("open and seg > 0").filter(resp.isNotNull()).select(
        *SEG, "chunk", "pos", F.lit(2).alias("stage"), F.lit(0).alias("msg"), none.cast("int").alias("turn"),
        none.cast("int").alias("active"), F.coalesce(resp["decision"], F.lit("")).alias("decision"),
        _int(F.coalesce(resp["keptOn"], resp["requestedMulliganCount"])).alias("kept"),
        _int(F.coalesce(resp["playerSeatId"], resp["seatId"])).alias("seat"))
    rows = turns.unionByName(over).unionByName(choices)
    w = Window.partitionBy(*SEG).orderBy(*order)
    kind = F.when(F.col("turn") == 1, "first").when((F.col("turn") > 1) | (F.col("turn") == -1), "later")
    previous = F.last(kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("turn") == 1) & (previous == "later"), F.lit(False)).cast("int")
    return rows.withColumn("fresh", fresh).withColumn("game_no", (F.sum("fresh").over(w) + 1).cast("int"))


def first_seats(line: DataFrame) -> DataFrame:
    """(file, seg, game_no) -> active: the seat of the first turn-1 message that names one."""
    at = F.struct("chunk", "pos", "msg")
    seen = line.filter("turn = 1").groupBy(*SEG, "game_no").agg(F.min_by("active", F.when(F.col("active").isNotNull(), at)).alias("active"))
    top = seen.groupBy(*SEG).agg(F.max("game_no").alias("top"))
    every = top.select(*SEG, F.explode(F.sequence(F.lit(1), "top")).alias("game_no"))
    return every.join(seen, [*SEG, "game_no"], "left")


def sided_games(sides: DataFrame, starts: DataFrame) -> DataFrame:
    side = F.when(F.col("active") == F.col("my_seat"), "play").otherwise("draw")
    known = F.col("active").isNotNull() & F.col("my_seat").isNotNull()
    return sides.join(starts.select(*SEG, *MATCH, "my_seat"), SEG).select(
        *SEG, *MATCH, "game_no", F.when(known, side).alias("play_draw"))


def kept_hands(line: DataFrame) -> DataFrame:
    """One row per kept hand: mulligans taken since the last keep in the same game; explicit counts as given."""
    keep = F.col("decision").endswith("_Keep") | F.col("decision").endswith("_AcceptHand")
    rows = line.filter("decision is not null")
    w = Window.partitionBy(*SEG, "game_no").orderBy("chunk", "pos")
    implicit = rows.filter("kept is null").withColumn("keep", keep)
    implicit = implicit.withColumn("hand", F.sum(F.col("keep").cast("int")).over(w) - F.col("keep").cast("int"))
    hands = implicit.groupBy(*SEG, "game_no", "hand").agg(
        F.count(F.when(F.col("decision").endswith("_Mulligan"), 1)).cast("int").alias("kept_on"),
        F.max("keep").alias("kept")).filter("kept").select(*SEG, "game_no", F.lit(None).cast("int").alias("seat"), "kept_on")
    given = rows.filter("kept is not null").select(*SEG, "game_no", "seat", F.col("kept").alias("kept_on"))
    return hands.unionByName(given)


def mulligans_from(hands: DataFrame, starts: DataFrame) -> DataFrame:
    return hands.join(starts.select(*SEG, *MATCH, "my_seat"), SEG).select(
        F.col("owner").alias("player_id"), "match_id", "game_no", F.coalesce("seat", "my_seat").alias("seat"), "kept_on")


def shown_commanders(events: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, seg, seat, grp_id, partner_idx) of cards in the command zone of commander events, resolved to objects seen so far."""
    brawl = starts.filter(C.is_brawl())
    msgs = _messages(events).join(brawl.select(*SEG, *MATCH), SEG)
    at = ["chunk", "pos", "msg"]
    objects = msgs.select(*SEG, *MATCH, *at, F.posexplode("s.gameObjects").alias("j", "o")).select(
        *SEG, *MATCH, *at, F.lit(0).alias("is_ref"), F.col("j").alias("k"), F.col("o.instanceId").alias("instance"),
        F.col("o").alias("object"), F.lit(None).cast("string").alias("zone_seat"))
    refs = msgs.select(*SEG, *MATCH, *at, F.posexplode("s.zones").alias("zi", "z")).filter(
        "z.type = 'ZoneType_Command'").select(
        *SEG, *MATCH, *at, "zi", F.col("z.ownerSeatId").alias("zone_seat"),
        F.posexplode("z.objectInstanceIds").alias("k", "instance")).select(
        *SEG, *MATCH, *at, F.lit(1).alias("is_ref"), (F.col("zi") * 1000 + F.col("k")).alias("k"), "instance",
        F.lit(None).cast(objects.schema["object"].dataType).alias("object"), "zone_seat")
    w = Window.partitionBy(*SEG, "instance").orderBy(*at, "is_ref", "k")  # one card object of one match
    seen = objects.unionByName(refs).withColumn("object", F.last("object", ignorenulls=True).over(w))
    kind = F.coalesce(F.nullif("object.type", F.lit("")), F.lit("GameObjectType_Card"))
    hits = seen.filter("is_ref = 1").filter(kind == "GameObjectType_Card").select(
        *SEG, *MATCH, *at, "k", F.coalesce("object.grpId", "object.cardId").alias("grp_id"),
        F.coalesce(_int("object.ownerSeatId"), _int("zone_seat")).alias("seat")).filter(
        "grp_id is not null and seat is not null")
    first = hits.groupBy(*SEG, *MATCH, "seat", "grp_id").agg(F.min(F.struct(*at, "k")).alias("at"))
    per_message = Window.partitionBy(*SEG, "seat", "at.chunk", "at.pos", "at.msg").orderBy("at.k")
    idx = F.row_number().over(per_message) - 1
    return first.select(*SEG, "seat", "grp_id", F.when(idx < 2, idx).otherwise(0).alias("partner_idx"))


def commanders_from(shown: DataFrame, starts: DataFrame) -> DataFrame:
    """Shown commanders, plus the command zone of the player's own deck where the deck was known at the start."""
    brawl = starts.filter(C.is_brawl())
    seen = shown.join(brawl.select(*SEG, *MATCH), SEG).select(*MATCH, "seat", "grp_id", "partner_idx")
    own = brawl.filter("deck_in_time and my_seat is not null").select(
        *MATCH, F.col("my_seat").alias("seat"), F.posexplode("deck.zone").alias("partner_idx", "grp_id")).select(
        *MATCH, "seat", "grp_id", "partner_idx")
    both = own.withColumn("o", F.lit(0)).unionByName(seen.withColumn("o", F.lit(1)))
    return both.groupBy(F.col("owner").alias("player_id"), "match_id", "seat", "grp_id").agg(
        F.min_by("partner_idx", F.struct("o", "partner_idx")).alias("partner_idx"))


def ranks_from(events: DataFrame) -> DataFrame:
    nested = F.col("p.RankGetCombinedRankInfo")
    pick = lambda c: F.coalesce(nested[c], F.col(f"p.{c}"))
    rows = events.filter(_names("rank")).filter(pick("constructedClass").isNotNull())
    return rows.select("owner", "file", "chunk", "pos", "ts", pick("constructedClass").alias("constructed_class"),
                       _int(pick("constructedLevel")).alias("constructed_level"),
                       pick("limitedClass").alias("limited_class"), _int(pick("limitedLevel")).alias("limited_level"))


def votes_from(events: DataFrame) -> DataFrame:
    """(owner, file, pos, user_id, n): how often each record's player lists name a user id."""
    ids = events.filter(_names("roster") & (F.col("part") == 0)).select("owner", "file", "pos", F.explode("users").alias("user_id"))
    return ids.groupBy("owner", "file", "pos", "user_id").agg(F.count(F.lit(1)).alias("n"))


def elected(votes: DataFrame) -> DataFrame:
    """(owner, my_user): the user id named most often (first in order on ties)."""
    counts = votes.groupBy("owner", "user_id").agg(F.sum("n").alias("n"))
    return counts.groupBy("owner").agg(F.min_by("user_id", F.struct((-F.col("n")).alias("a"), "user_id")).alias("my_user"))


# ---- everything -----------------------------------------------------------------------------
def extract(payloads: DataFrame) -> dict[str, DataFrame]:
    """Parsed payloads (owner, file, chunk, pos, part, text, p) to what the records say, whoever the owner is.

    The segmented events and the narrow tables derived from them feed many outputs, so each is written once.
    """
    events = segment(payloads)
    begun = match_starts(events)
    routed = stored(routed_results(events, begun), "routed-results")
    entries = stored(payload_entries(routed), "payload-entries")
    line = stored(timeline(events, entries), "timeline")
    ends = events.filter(_names("completion")).filter("completes and seg > 0").groupBy(*SEG).agg(
        F.min_by("ts", F.struct("chunk", "pos")).alias("end_ts"))
    top_turn = line.filter("turn > 0").groupBy(*SEG).agg(F.max("turn").alias("total_turns"))
    return {"starts": begun.join(ends, SEG, "left").join(top_turn, SEG, "left"), "results": routed, "entries": entries, "decks": course_decks(events),
            "sides": first_seats(line), "hands": kept_hands(line), "shown": shown_commanders(events, begun),
            "ranks": ranks_from(events), "votes": votes_from(events)}


def resolve(said: dict[str, DataFrame], identities: DataFrame) -> dict[str, DataFrame]:
    """What the records say, with the owners' ids, to match, game, mulligan, commander and rank facts. Results without a match
    are returned as ``orphans``. A column ``arrival`` of the starts is handed on to the matches."""
    starts = stored(attach_decks(seated(said["starts"], identities), said["decks"]), "starts")
    entries = stored(result_entries(said.get("entries") or payload_entries(said["results"]), starts), "result-entries")
    teams = own_teams(starts)
    turn_games = sided_games(said["sides"], starts)
    game_results = decided_games(entries, teams)
    player = F.col("owner").alias("player_id")
    games = (turn_games.groupBy(*MATCH, "game_no").agg(F.max("play_draw").alias("play_draw"))
             .join(game_results, [*MATCH, "game_no"], "full_outer"))
    lacking = starts.select(*MATCH).distinct().join(games.select(*MATCH).distinct(), MATCH, "left_anti")
    games = games.select(player, "match_id", "game_no", "result", "reason", "play_draw").unionByName(lacking.selectExpr(
        "owner as player_id", "match_id", "1 as game_no", "cast(null as string) result", "cast(null as string) reason",
        "cast(null as string) play_draw"))
    sides = turn_games.filter("game_no = 1").select(*SEG, "play_draw")
    rows = starts.join(sides, SEG, "left").join(decided_matches(entries, teams), MATCH, "left")
    start = F.coalesce("start_ts", "end_ts")
    matches = rows.select(
        "match_id", F.col("owner").alias("player_id"), "file", "chunk", "pos", F.lit("log").alias("source"), "event_key",
        start.alias("start_time"), F.col("end_ts").alias("end_time"),
        F.to_date(F.timestamp_millis(start)).alias("play_day"),
        F.when(F.col("end_ts") >= start, (F.col("end_ts") - start) / 1000.0).alias("duration_sec"),
        "my_seat", "opponent_name", "opponent_platform", "play_draw", "my_result", "end_reason", "total_turns",
        F.col("deck.tag").alias("my_deck_tag"), F.col("deck.id").alias("my_deck_id"),
        F.col("deck.version").alias("my_deck_version"), *[c for c in ("arrival",) if c in starts.columns])
    orphans = entries.join(starts.select(*MATCH).distinct(), MATCH, "left_anti").select(
        player, "match_id", F.struct("at", "i").alias("entry_no"), "scope", F.col("winner").alias("winning_team"), "reason")
    return {"matches": matches, "games": games, "mulligans": mulligans_from(said["hands"], starts),
            "commanders": commanders_from(said["shown"], starts), "ranks": said["ranks"], "orphans": orphans}


def rebuild_facts(payloads: DataFrame, identities: DataFrame | None = None) -> dict[str, DataFrame]:
    """Facts of complete logs; without ``identities`` each owner's id is the one named most often in them."""
    said = extract(payloads)
    return resolve(said, elected(said["votes"]) if identities is None else identities)
