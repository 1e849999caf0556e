"""Session logs: file listing, line scan, logical records, JSON payloads, timestamps, ingest audit.

A line is addressed by (file, chunk, pos): ``chunk`` is the byte offset of the file split it was read
from and ``pos`` grows within the file, so one huge file is scanned by many tasks and every
order-dependent step works per chunk with a small carry between chunks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ordered import running
from ..session import many_files, settings, stored

# fixed values: log line prefix, timestamp pattern, user id pattern
PREFIX = "[UnityCrossThreadLogger]"
TIMESTAMP = r'"timestamp"\s*:\s*"(\d{13})"'
USER_ID = r'"userId"\s*:\s*"([^"]+)"'
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'  # possessive: no stack and no way back, however long the string
UNCLOSED_LINES = 10_000  # lines of an unclosed record in one row


# ---- files ----------------------------------------------------------------------------------
def list_logs(spark: SparkSession, dirs: list[str], pattern: str = "*.log") -> DataFrame:
    """File listing without reading contents: path, name, size, modified, dir_rank (order of ``dirs``)."""
    out = None
    for rank, folder in enumerate(dirs):
        with settings(spark, **many_files(spark)):
            found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        files = found.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"),
                             F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                             F.lit(rank).alias("dir_rank"))
        out = files if out is None else out.unionByName(files)
    return out


def drop_copies(files: DataFrame, owner: Column | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Of the files of one owner that agree in name and size (and contents, with ``sums(path, checksum)``) keep the one from
    the earliest folder. ``owner`` is a column over ``path``; without it all files belong to one player."""
    rest = [c for c in files.columns if c not in ("name", "size")]
    owned = files.withColumn("_owner", F.lit(None).cast("string") if owner is None else owner)
    key = ["_owner", "name", "size"]
    if sums is not None:
        owned, key = owned.join(sums, "path", "left"), [*key, "checksum"]
    return owned.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("dir_rank", "path")).alias("f")).select("name", "size", "f.*")


def twins(files: DataFrame, owner: Column) -> DataFrame:
    """Files whose owner, name and size another file shares: those whose contents must be compared."""
    owned = files.withColumn("_owner", owner)
    shared = owned.groupBy("_owner", "name", "size").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return owned.join(shared, ["_owner", "name", "size"], "left_semi").drop("_owner")


def checksums(lines: DataFrame) -> DataFrame:
    """(path, checksum) of files read by ``read_lines``: a sum over lines, by place within the split, so that no file has to
    fit into one row."""
    place = F.col("pos") - F.min("pos").over(Window.partitionBy("file", "chunk"))
    code = F.xxhash64("chunk", place, "text").cast("decimal(38,0)")
    return lines.select(F.col("file").alias("path"), code.alias("code")).groupBy("path").agg(F.sum("code").alias("checksum"))


def distinct_logs(spark: SparkSession, dirs: list[str], owner: Column, pattern: str = "*.log") -> DataFrame:
    """Lines of all log files below ``dirs`` without those of copies (same owner, name, size and contents).

    The folders are read as they are; the few dropped files leave by an anti-join on the file, so no list of paths passes
    the driver. Contents are compared only where owner, name and size agree.
    """
    few = many_files(spark)
    files = stored(list_logs(spark, dirs, pattern), "log-files", **few)
    alike = stored(twins(files, owner), "log-twins")
    lines = read_lines(spark, dirs, pattern)
    if alike.isEmpty():
        return lines
    sums = stored(checksums(lines.join(alike.select(F.col("path").alias("file")), "file", "left_semi")), "log-checksums", **few)
    dropped = stored(alike.join(drop_copies(alike, owner, sums), "path", "left_anti").select(F.col("path").alias("file")), "log-copies")
    return lines.join(dropped, "file", "left_anti")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, size, modified) the manifest does not already hold; replayed whole."""
    return files.join(manifest.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def read_lines(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Lines of the given files: file, chunk, pos, text. Undecodable bytes become replacement characters.

    Files are split as Spark sees fit; within a split row ids grow, between splits the offset decides.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    with settings(spark, **many_files(spark)):
        read = reader.text(paths)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` (1-based) within the file."""
    return running(lines, ["file"], "chunk", ["pos"], sums={"line_no": F.lit(1)})


# ---- records --------------------------------------------------------------------------------
def brace_delta(text: Column) -> Column:
    bare = F.regexp_replace(text, QUOTED, "")
    count = lambda ch: F.length(bare) - F.length(F.replace(bare, F.lit(ch), F.lit("")))
    return count("{") - count("}")


def assemble_records(lines: DataFrame) -> DataFrame:
    """Lines to logical records: file, chunk, pos (of the first line), text, lines, closed.

    A record ends where the brace depth (outside strings) is back at zero; a line with the logger prefix
    always starts a new record, so an unclosed brace spoils only its own record (``closed`` false). All its
    lines are kept: one row, or for a very long one a row for every UNCLOSED_LINES lines.
    A close without an open is ignored. Blank records are dropped.

    Lines are shuffled once, by split, and numbered there. Only what a split cannot know alone is stitched afterwards: the
    lines before its first prefix, and the record still open at its end.
    """
    level = stored(_numbered(lines), "log-levels", **many_files(lines.sparkSession))
    record = ["file", "chunk", "block", "rec"]
    single = level.filter("whole and not loose").select("file", "chunk", "pos", "text", F.lit(1).cast("bigint").alias("lines"),
                                                        F.lit(True).alias("closed"))
    multi = _texts(level.filter("not whole and not loose").withColumn("piece", F.lit(0)), [*record, "piece"],
                   F.count(F.lit(1)), F.max("ends"))
    return single.unionByName(multi).unionByName(_stitched(level)).filter(F.trim("text") != "")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their brace depth and record within the split, counted from depth zero at the first line.

    ``block`` counts prefixes, ``rec`` the records ended before, ``total`` sums the deltas of the split. Below the first prefix
    (block 0) the depth on entry matters: ``loose``, like the lines of the record that is open when the split ends.
    """
    split = Window.partitionBy("file", "chunk")
    run = split.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # blocks grow, so the least (-block, total) so far is the lowest total of the present block; its entry counts, too
    reached = F.when(F.col("starts") == 1, F.least("total", F.col("total") - F.col("delta"))).when(
        F.col("block") == 0, F.least("total", F.lit(0))).otherwise(F.col("total"))
    level = (lines.select("file", "chunk", "pos", "text", brace_delta(F.col("text")).alias("delta"),
                          F.col("text").startswith(PREFIX).cast("int").alias("starts"))
             .withColumn("total", F.sum("delta").over(run)).withColumn("block", F.sum("starts").over(run))
             .withColumn("low", F.min(F.when(F.col("block").isNotNull(), F.struct(
                 (-F.col("block")).alias("b"), reached.alias("t")))).over(run)["t"])
             .withColumn("depth", F.col("total") - F.col("low")).withColumn("ends", F.col("depth") == 0)
             .withColumn("rec", F.sum(F.col("ends").cast("int")).over(run) - F.col("ends").cast("int"))
             .withColumn("whole", F.col("ends") & (F.col("delta") == 0)))
    unended = F.col("rec") == F.max(F.col("rec") + F.col("ends").cast("int")).over(split)
    tail = (F.col("block") == F.max("block").over(split)) & unended
    return level.withColumn("loose", (F.col("block") == 0) | tail).drop("low", "starts", "delta")


def _texts(lines: DataFrame, key: list[str], count: Column, closed: Column) -> DataFrame:
    """One row per record (and piece) of its lines in order."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pos", "text"))), lambda r: r["text"])
    rows = lines.groupBy(*key).agg(F.min(F.struct("chunk", "pos")).alias("at"), count.alias("lines"), closed.alias("closed"),
                                   F.array_join(whole, "\n").alias("text"))
    return rows.select("file", "at.chunk", "at.pos", "text", "lines", "closed")


def _entry_depths(level: DataFrame) -> DataFrame:
    """(file, chunk, depth0, inner): depth at the start of each split, and whether the split has a prefix.

    A split is a function of the depth on entry: a constant if it has a prefix, else max(depth from zero, entry + total). The
    functions are composed by windows over one row per split.
    """
    ends = level.groupBy("file", "chunk").agg(F.max_by(F.struct("block", "depth", "total"), "pos").alias("e")).select(
        "file", "chunk", (F.col("e.block") > 0).alias("inner"), "e.depth", "e.total")
    order = Window.partitionBy("file").orderBy("chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("file", "_run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    rise = F.sum(F.when(F.col("inner"), 0).otherwise(F.col("total"))).over(since)
    known = F.coalesce(F.max(F.when(F.col("inner"), F.col("depth"))).over(since), F.lit(0))
    own = ends.withColumn("_run", F.sum(F.col("inner").cast("int")).over(upto)).withColumn("_rise", rise)
    floor = F.max(F.when(~F.col("inner"), F.col("depth") - F.col("_rise"))).over(since)
    after = own.withColumn("_after", F.greatest(known, floor) + F.col("_rise"))
    return after.select("file", "chunk", F.coalesce(F.lag("_after").over(order), F.lit(0)).alias("depth0"), "inner")


def _stitched(level: DataFrame) -> DataFrame:
    """Records of the loose lines: pieces of splits, joined where a record runs over the end of a split."""
    piece = ["file", "chunk", "block", "rec"]
    loose = level.filter("loose").drop("whole", "loose")
    head = loose.filter("block = 0").join(_entry_depths(level), ["file", "chunk"])
    head = head.withColumn("ends", F.greatest(F.col("total") + F.col("depth0"), F.col("depth")) == 0)
    upto = Window.partitionBy("file", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("rec", F.sum(F.col("ends").cast("int")).over(upto) - F.col("ends").cast("int"))
    fresh = (F.col("depth0") == 0) | (F.col("rec") > 0)
    columns = [*piece, "pos", "text", "ends", "fresh"]
    rows = stored(head.withColumn("fresh", fresh).select(*columns).unionByName(
        loose.filter("block > 0").withColumn("fresh", F.lit(True)).select(*columns)), "log-loose")
    sizes = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"), F.max("ends").alias("ended"), F.first("fresh").alias("fresh"))
    # at most the first and the last piece of a split belong to a longer record
    order = Window.partitionBy("file").orderBy("chunk", "block", "rec").rowsBetween(Window.unboundedPreceding, 0)
    edges = sizes.filter("not (fresh and ended)").withColumn("_no", F.sum(F.col("fresh").cast("int")).over(order))
    one = Window.partitionBy("file", "_no")
    earlier = one.orderBy("chunk", "block", "rec").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*piece, F.min(F.struct("chunk", "block", "rec")).over(one).alias("record"), F.sum("n").over(one).alias("lines"),
                         F.max("ended").over(one).alias("closed"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy("pos"))
    joined = rows.withColumn("_rank", inside).join(sizes.select(*piece, "n"), piece).join(edges, piece, "left").select(
        "file", "chunk", "pos", "text", F.coalesce("record", F.struct("chunk", "block", "rec")).alias("record"),
        F.coalesce("lines", "n").alias("lines"), F.coalesce("closed", F.lit(True)).alias("closed"),
        F.when(F.coalesce("closed", F.lit(True)), 0).otherwise(
            F.floor((F.col("_rank") + F.coalesce("offset", F.lit(0)) - 1) / UNCLOSED_LINES)).alias("piece"))
    return _texts(joined, ["file", "record", "piece"], F.max("lines"), F.max("closed"))


def own_timestamp() -> Column:
    return F.nullif(F.regexp_extract("text", TIMESTAMP, 1), F.lit("")).cast("bigint")


def carry_timestamps(records: DataFrame) -> DataFrame:
    """Add ``ts``: the record's own 13-digit timestamp, else the latest earlier one of its file."""
    return running(records, ["file"], "chunk", ["pos"], lasts={"ts": own_timestamp()})


_GSM = ("struct<turnInfo:struct<turnNumber:string,activePlayer:string>,zones:array<struct<type:string,ownerSeatId:string,"
        "objectInstanceIds:array<string>>>,gameObjects:array<struct<instanceId:string,grpId:string,cardId:string,"
        "ownerSeatId:string,type:string>>>")
_RESULT = "struct<matchId:string,resultList:array<struct<scope:string,winningTeamId:string,reason:string>>>"
_RANK = "constructedClass:string,constructedLevel:string,limitedClass:string,limitedLevel:string"
_CARDS = "array<struct<cardId:string,quantity:string>>"
_COURSE = (f"InternalEventName:string,CourseDeckSummary:struct<Name:string,DeckId:string>,CourseDeck:struct<MainDeck:{_CARDS},"
           f"Sideboard:{_CARDS},CommandZone:{_CARDS},Companions:{_CARDS}>")
PAYLOAD = (
    "struct<matchGameRoomStateChangedEvent:struct<gameRoomInfo:struct<state:string,gameRoomConfig:struct<matchId:string,"
    "eventId:string,reservedPlayers:array<struct<systemSeatId:string,teamId:string,playerName:string,platformId:string,"
    f"userId:string,eventId:string>>>,finalMatchResult:{_RESULT}>>,finalMatchResult:{_RESULT},"
    f"greToClientEvent:struct<greToClientMessages:array<struct<gameStateMessage:{_GSM},queuedGameStateMessage:{_GSM}>>>,"
    "mulliganResp:struct<decision:string,keptOn:string,requestedMulliganCount:string,playerSeatId:string,seatId:string>,"
    f"RankGetCombinedRankInfo:struct<{_RANK}>,{_RANK},{_COURSE},Course:struct<{_COURSE}>,Courses:array<struct<{_COURSE}>>,"
    "_bad:string>")

# tokens of a text with several top-level objects: strings, braces, anything else
_TOKENS = QUOTED + r'|[{}]|[^"{}]+'


def top_level_objects(text: Column) -> Column:
    """Every balanced top-level {...} of a text (used only where the text is not a single object)."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc, tok):
        depth = (F.when(tok == "{", acc["depth"] + 1)
                 .when(tok == "}", F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"]))
        inside = (acc["depth"] > 0) | (tok == "{")
        cur = F.when(inside, F.concat(acc["cur"], tok)).otherwise("")
        closed = (tok == "}") & (acc["depth"] == 1)
        return F.struct(depth.alias("depth"), F.when(closed, "").otherwise(cur).alias("cur"),
                        F.when(closed, F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"))

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def braced(text: Column) -> Column:
    """A text from its first opening to its last closing brace, '' without them."""
    first = F.instr(text, F.lit("{"))
    last = F.when(F.contains(text, F.lit("}")), F.length(text) - F.length(F.substring_index(text, "}", -1))).otherwise(0)
    return F.when((first > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(F.when(text.isNotNull(), ""))


def has_several(body: Column) -> Column:
    """Inside one JSON value a closing brace is followed by , ] } or nothing; anything else separates objects. Strings, which are cut
    out for that, only need to be found where a brace is followed by anything else at all."""
    apart = r"\}\s*[^\s,\]}]"
    return body.rlike(apart) & F.regexp_replace(body, QUOTED, "").rlike(apart)


def parse_payloads(records: DataFrame) -> DataFrame:
    """One row per JSON object of a record (or one without object): adds ``p`` (typed payload), ``bad``
    (starts an object but none can be read) and ``part`` (object number within the record)."""
    body = F.replace(braced(F.col("text")), F.lit('"MulliganResp"'), F.lit('"mulliganResp"'))
    one = F.from_json("body", PAYLOAD, {"columnNameOfCorruptRecord": "_bad"})
    src = records.withColumn("body", body)
    several = has_several(F.col("body"))
    objects = F.when(F.col("body") == "", F.array().cast("array<string>")).when(
        several, top_level_objects(F.col("body"))).otherwise(F.array("body"))
    opened = F.col("text").contains("{")
    exploded = src.withColumn("objects", objects).withColumn(
        "unread", opened & (F.size("objects") == 0)).select(
        *records.columns, "unread", F.posexplode_outer("objects").alias("part", "body"))
    parsed = exploded.withColumn("p", one)
    bad = F.col("unread") | F.col("p._bad").isNotNull()
    return parsed.withColumn("bad", bad).drop("unread", "body")


# ---- keys at any depth --------------------------------------------------------------------------
# fixed values: the key that tells an object, and where its fixed place in a payload is
WRAPPED = {"reservedPlayers": '{"matchGameRoomStateChangedEvent":{"gameRoomInfo":{"gameRoomConfig":%s}}}', "finalMatchResult": '%s',
           "CourseDeckSummary": '{"Courses":[%s]}'}


def holders_of(objects: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """(ident, path, key, holder): every JSON object, however deep in ``body``, that has one of the ``keys`` itself.

    The objects are opened level by level, all records at once, until no level is left; only values that still contain a
    searched key are followed. ``path`` holds the places on the way, so that its order is the order of a depth-first walk.
    """
    name = lambda k: f'"{k}"'
    inside = lambda c: F.lit(False) if not keys else F.array_max(F.array(*[F.contains(c, F.lit(name(k))) for k in keys]))
    level = objects.select(*ident, F.array().cast("array<int>").alias("path"), F.trim("body").alias("value")).filter(inside(F.col("value")))
    found = None
    while True:
        level = stored(level.withColumn("fields", F.when(F.col("value").startswith("{"), F.from_json("value", "map<string,string>"))), "json-level")
        if level.isEmpty():
            break
        held = F.array_intersect(F.map_keys("fields"), F.array(*[F.lit(k) for k in keys]))
        here = level.filter("fields is not null").select(*ident, "path", F.explode(held).alias("key"), F.col("value").alias("holder"))
        found = here if found is None else found.unionByName(here)
        children = F.coalesce(F.map_values("fields"), F.from_json("value", "array<string>"))
        level = level.select(*ident, "path", F.posexplode(children).alias("place", "value")).select(
            *ident, F.array_append("path", F.col("place")).alias("path"), F.trim("value").alias("value")).filter(
            inside(F.col("value")) & (F.col("value").startswith("{") | F.col("value").startswith("[")))
    empty = objects.select(*ident, F.array().cast("array<int>").alias("path"), F.lit("").alias("key"), F.lit("").alias("holder")).filter("false")
    return empty if found is None else found


def unwrapped(payloads: DataFrame) -> DataFrame:
    """Payloads, and one more for every roster, result or deck record that lies under foreign wrappers.

    An object is searched only if its text names the key and the key's fixed place is empty. The added payloads have the found
    object at its fixed place and part numbers behind the record's own. ``payloads`` should be a written table.
    """
    ident = ["file", "chunk", "pos", "part"]
    room = F.col("p.matchGameRoomStateChangedEvent.gameRoomInfo")
    place = {"reservedPlayers": room["gameRoomConfig"]["reservedPlayers"].isNotNull(),
             "finalMatchResult": F.col("p.finalMatchResult").isNotNull() | room["finalMatchResult"].isNotNull(),
             "CourseDeckSummary": F.col("p.CourseDeckSummary").isNotNull() | F.col("p.Course").isNotNull() | F.col("p.Courses").isNotNull()}
    lost = F.filter(F.array(*[F.when(F.contains("text", F.lit(k)) & ~F.coalesce(place[k], F.lit(False)), F.lit(k)) for k in WRAPPED]),
                    lambda k: k.isNotNull())
    keyed = payloads.filter("not bad").withColumn("lost", lost).filter(F.size("lost") > 0)
    objects = keyed.withColumn("body", braced(F.col("text"))).withColumn("body", F.when(
        has_several(F.col("body")), F.get(top_level_objects(F.col("body")), F.col("part"))).otherwise(F.col("body")))
    holders = holders_of(objects.select(*ident, "body"), list(WRAPPED), ident)
    wanted = holders.join(objects.select(*ident, "lost"), ident).filter(F.array_contains("lost", F.col("key")))
    wanted = wanted.filter("key <> 'CourseDeckSummary' or holder like '%\"InternalEventName\"%'")
    form = F.replace(F.element_at(F.create_map(*[x for k, v in WRAPPED.items() for x in (F.lit(k), F.lit(v))]), F.col("key")), F.lit("%s"), F.col("holder"))
    order = Window.partitionBy("file", "chunk", "pos").orderBy("part", "path", "key")  # objects of one record
    parsed = wanted.withColumn("_no", 1000 + F.row_number().over(order)).select(
        "file", "chunk", "pos", F.col("_no").alias("_part"), F.from_json(form, PAYLOAD, {"columnNameOfCorruptRecord": "_bad"}).alias("_p"))
    once = payloads.filter("part = 0 or part is null").drop("p", "part")
    added = once.join(parsed, ["file", "chunk", "pos"]).withColumnRenamed("_p", "p").withColumnRenamed("_part", "part")
    return payloads.unionByName(added.select(*payloads.columns))


# ---- audit ----------------------------------------------------------------------------------
def ingest_audit(payloads: DataFrame, facts: DataFrame, known: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Per file: records, unreadable ones, matches rebuilt, of these new and already stored.

    ``facts(file, match_id)``, ``known(match_id)``; ``skipped(file)`` are unchanged files.
    """
    per_file = payloads.groupBy("file").agg(F.count(F.lit(1)).alias("objects"),
                                            F.count(F.when(F.col("bad"), 1)).alias("unreadable"))
    marked = facts.select("file", "match_id").distinct().join(
        known.select("match_id").distinct().withColumn("stored", F.lit(True)), "match_id", "left")
    rebuilt = marked.groupBy("file").agg(F.count(F.lit(1)).alias("rebuilt"), F.count("stored").alias("updated"))
    zero = F.lit(0).cast("bigint")
    out = per_file.join(rebuilt, "file", "left").select(
        "file", "objects", "unreadable", F.coalesce("rebuilt", zero).alias("rebuilt"),
        (F.coalesce("rebuilt", zero) - F.coalesce("updated", zero)).alias("new"),
        F.coalesce("updated", zero).alias("updated"), F.lit(False).alias("skipped"))
    if skipped is not None:
        out = out.unionByName(skipped.select("file", *[zero.alias(c) for c in (
            "objects", "unreadable", "rebuilt", "new", "updated")], F.lit(True).alias("skipped")))
    return out


def detect_identity(records: DataFrame, owner: str = "owner") -> DataFrame:
    """Per log owner the user id named most often in player lists (first in order on ties)."""
    ids = (records.filter(F.col("text").contains("reservedPlayers"))
           .select(owner, F.explode(F.regexp_extract_all("text", F.lit(USER_ID), F.lit(1))).alias("user_id")))
    counts = ids.groupBy(owner, "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(owner).agg(F.min_by("user_id", F.struct((-F.col("n")).alias("a"), "user_id")).alias("my_user"))
