import pytest
from pyspark.sql import functions as F

from helpers import BASE, as_set, matches, row
from matchlake.operators import deck_detail as DD, decks as D, identity as I, matchups as M, merge as U
from matchlake.scope import Scope


def test_identity_links_ids_and_versions(spark):
    data = [("a", "v1"), ("a", "v2"), ("b", "v2"), (None, "v1"), ("c", None), ("z", "v9"), (None, None), (None, "v9")]
    rows = matches(spark, [row(i, my_deck_id=d, my_deck_version=v) for i, (d, v) in enumerate(data)])
    got = {r.match_id: r.identity for r in I.with_identity(rows).collect()}
    assert got[0] == got[1] == got[2] == got[3] != got[4]
    assert got[5] == got[7] != got[0] and got[6] == "n:d"
    labels = I.components(I.deck_edges(rows))
    edges = I.deck_edges(rows).distinct()
    look = {(r.player_id, r.node): r.label for r in labels.collect()}
    assert all(look[(e.player_id, e.a)] == look[(e.player_id, e.b)] for e in edges.collect())


def test_components_with_hot_nodes(spark):
    """The broadcast path for heavy nodes gives the same labels as the plain path."""
    edges = spark.range(300).select(F.lit(1).alias("player_id"), F.concat(F.lit("i:"), "id").alias("a"),
                                    F.concat(F.lit("v:"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 20)).alias("b"))


def test_seed_prefers_latest_reliable(spark):
    rows = I.with_identity(matches(spark, [row(0), row(5, my_deck_id="n", my_deck_version=None),
                                           row(9, my_deck_id=None, my_deck_version=None)]))
    assert I.seeds_by_name(rows).first().identity == "i:n"


def test_card_share_against_baseline(spark):
    rows = [row(i, my_deck_id="x") for i in range(5)] + [row(10 + i, my_deck_id="y", my_deck_version="w") for i in range(10)]
    m = matches(spark, rows)
    cards = [(i, 2, "7" if i < 4 else "8") for i in range(5)] + [(10 + i, 2, "9") for i in range(10)]
    c = spark.createDataFrame(cards, "match_id long, seat int, grp_id string")
    deck = I.with_identity(m).filter("my_deck_id = 'x'")
    top = DD.card_environment(deck, m, c, DD.KEYS).filter("rank = 1").first()
    assert (top.share_known, top.baseline_share, top.delta_pp) == (80.0, 26.7, 53.3)


def test_scopes_and_drill_down_arguments(spark):
    rows = matches(spark, [row(i, start_time=BASE + i * 1000) for i in range(30)]).withColumn("identity", F.lit("x"))
    assert DD.apply_scope(rows, "last20", None).count() == 20
    with pytest.raises(ValueError):
        DD.apply_scope(rows, "lately", None)
    with pytest.raises(ValueError):
        DD.records_against(rows, rows, grp_id="1", evidence=rows)


def test_deck_labels_split_draft_names(spark):
    rows = [row(i, my_deck_id=f"d{i % 2}", my_deck_tag="Draft Deck", event_key="QuickDraft_A_1") for i in range(6)]
    got = {r.my_deck_id: r.limited_label for r in D.deck_labels(matches(spark, rows)).collect()}
    assert got == {"d0": "draft · 2024-01-01 00:00", "d1": "draft · 2024-01-01 00:01"}
    shown = D.recent_decks(matches(spark, rows), Scope()).collect()
    assert len({r.label for r in shown}) == 2


def test_merge_is_idempotent(spark):
    old = matches(spark, [row(1, my_result=None, my_deck_tag=""), row(2)]).drop("commanders", "mulligan").withColumn(
        "total_turns", F.lit(3)).withColumn("end_reason", F.lit(None).cast("string"))
    new = matches(spark, [row(1, my_deck_tag="new", opponent_name="Z"), row(3)]).drop("commanders", "mulligan").withColumn(
        "total_turns", F.lit(2)).withColumn("end_reason", F.lit("Game"))
    once = U.merge_matches(old, new)
    assert as_set(U.merge_matches(once, new).select(sorted(once.columns))) == as_set(once.select(sorted(once.columns)))
    r = {x.match_id: x for x in once.collect()}
    assert (r[1].my_result, r[1].my_deck_tag, r[1].total_turns) == ("win", "new", 3) and len(r) == 3


def test_orphan_results_never_overwrite(spark):
    m = matches(spark, [row(1, my_result=None), row(2, my_result="loss"), row(3, my_result=None, my_seat=None)]).withColumn(
        "end_reason", F.lit(None).cast("string"))
    g = spark.createDataFrame([(1, 1, None, "play")], "match_id long, game_no int, result string, play_draw string")
    res = spark.createDataFrame([(i, 1, "MatchScope_Match", 1, "ResultReason_Game") for i in (1, 2, 3)]
                                + [(1, 2, "MatchScope_Game", 1, None), (1, 3, "MatchScope_Game", 2, None)],
                                "match_id long, entry_no int, scope string, winning_team int, reason string")
    fixed, games = U.apply_orphan_results(m, g, res)
    assert {r.match_id: r.my_result for r in fixed.collect()} == {1: "win", 2: "loss", 3: None}
    assert {r.game_no: r.result for r in games.collect()} == {1: "win", 2: "loss"}


def test_fingerprint_ignores_where_the_commander_is_counted(spark):
    sec = [(1, "main", 10, 3), (1, "main", 11, 1), (1, "commanders", 11, 1), (2, "main", 10, 3), (2, "commanders", 11, 1),
           (3, "main", 99, 1), (4, "main", 10, 0), (5, "side", 10, 1)]
    s = spark.createDataFrame(sec, "match_id long, section string, card_id long, quantity int")
    mp = spark.createDataFrame([(10, 1), (11, 2)], "card_id long, title_id long")
    got = {r.match_id: r.fingerprint for r in U.deck_fingerprints(s, mp).collect()}
    assert got[1] == got[2] is not None and got[3] is got[4] is got[5] is None


def test_sensitive_lines(spark):
    text = "ok\nid 0f8fad5b-d9cb-469f-a165-70867728950e\nC:\\Users\\<name>\\x C:\\Users\\bob\r\nABCDEFGHIJKLMNOPQRSTUV hush"
    got = U.sensitive_lines(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", ["hush"]).collect()
    assert sorted((r.line_no, r.label) for r in got) == [(2, "uuid"), (4, "blocked word"), (4, "user id")]


def test_opponent_cards_need_both_seats(spark):
    m = matches(spark, [row(1), row(2, my_seat=None)])
    c = spark.createDataFrame([(1, 2, "7"), (1, 2, "7"), (1, 1, "8"), (1, None, "9"), (2, 2, "7")],
                              "match_id long, seat int, grp_id string")
    assert as_set(M.opponent_cards(m, c).select("match_id", "grp_id")) == [("1", "7")]


def test_csv_sink_has_a_mark_and_keeps_order(spark, tmp_path):
    from matchlake.sources.export import write_csv
    df = spark.createDataFrame([(i, f"n{i}") for i in (3, 1, 2)], "t long, name string")
    write_csv(df, str(tmp_path / "out"), ["t"])
    lines = [f.read_text(encoding="utf-8") for f in sorted((tmp_path / "out").glob("part-*.csv"))]
    assert all(text.startswith("﻿t,name") for text in lines)
    assert [x for text in lines for x in text.split()[1:]] == ["1,n1", "2,n2", "3,n3"]


def test_long_chains_in_few_rounds(spark):
    """A path of 3,000 nodes in shuffled order, a star, a ring and a loop; labels by brute force, rounds logarithmic."""
    import random
    rng = random.Random(5)
    names = [f"n{i:05d}" for i in range(3000)]
    rng.shuffle(names)
    links = list(zip(names, names[1:])) + [("hub", f"x{i}") for i in range(500)] + [(f"r{i}", f"r{(i + 1) % 64}") for i in range(64)] + [("self", "self")]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    rounds = []
    df = spark.createDataFrame([(1, a, b) for a, b in links] + [(2, "a", "b")], "player_id int, a string, b string")
    got = {(r.player_id, r.node): r.label for r in I.components(df, rounds).collect()}
    assert got == {**{(1, x): find(x) for x in list(parent)}, (2, "a"): "a", (2, "b"): "a"}
    assert len(rounds) <= 16 and max(rounds) <= len(links) + 1


def test_pages_found_by_the_index(spark):
    import random
    rng = random.Random(2)
    rows = [row(i, player_id=i % 3, start_time=None if i % 11 == 0 else BASE + rng.randrange(6) * 86_400_000 + rng.randrange(5)) for i in range(200)]
    df = matches(spark, rows)
    index = M.page_index(df).cache()
    every = {(r.player_id, r.position): r.match_id for r in M.page_rows(df, index, 1000, 0).collect()}
    for p in range(3):
        own = sorted((r for r in rows if r["player_id"] == p), key=lambda r: (r["start_time"] is not None, r["start_time"] or 0, r["match_id"]), reverse=True)
        assert [every[p, i + 1] for i in range(len(own))] == [r["match_id"] for r in own]
    for limit, offset in ((1, 0), (7, 20), (10, 60), (5, 66), (3, 500)):
        got = {(r.player_id, r.position): r.match_id for r in M.page_rows(df, index, limit, offset).collect()}
        assert got == {k: v for k, v in every.items() if offset < k[1] <= offset + limit}


def test_rounds_are_written_packed(spark):
    import glob

    kept = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    edges = spark.createDataFrame([(1, f"i:{i // 2}", f"v:{(i + 1) // 2}") for i in range(40)], "player_id int, a string, b string")
    before = set(glob.glob(f"{kept}/*/rdd-*"))
    assert {r.label for r in I.components(edges).collect()} == {"i:0"}
    assert set(glob.glob(f"{kept}/*/rdd-*")) <= before
