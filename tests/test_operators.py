import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vocab
from scriptorium.operators import canon, discover, relational, search, stats, transcripts, usage
from scriptorium.sources import readers, writers

SKETCH = "id string, seq int, title string, text string, textCommon string, actors array<string>, actorsRaw string, rolesNames string, location string, languages array<string>, durationSec int, viewCount long, uploadDate string, lines array<string>"


def sketch(id_, **kw):
    base = {"seq": None, "title": "", "text": "", "textCommon": "", "actors": [], "actorsRaw": "", "rolesNames": "", "location": "Այլ", "languages": [], "durationSec": 120, "viewCount": 0, "uploadDate": "", "lines": []} | kw
    return (id_, *base.values())


def sketches(spark, *rows):
    return spark.createDataFrame(list(rows), SKETCH)


def test_people(spark):
    rows = spark.createDataFrame([("Հայկո Մկո",), ("Հայկո, երկար դեր, Հակյո",), (None,), ("ՄԿո x x",)], "a string")
    got = [tuple(r.w) for r in rows.select(canon.people("a").alias("w")).collect()]
    assert got == [(["Հայկո", "Մկո"], []), (["Հայկո"], ["երկար դեր"]), ([], []), (["Մկո"], ["x", "x"])]


def test_place_and_languages(spark):
    row = spark.createDataFrame([(" Տուն ", "hy+ru, hy"), ("noise", None), (None, "")], "l string, g string").select(canon.place("l").alias("l"), canon.languages("g").alias("g")).collect()
    assert [tuple(r) for r in row] == [("Տուն", ["hy", "ru"]), ("Այլ", []), ("Այլ", [])]


def test_catalogue_row(spark):
    cols = "links string, titles string, text string, text_common string, main_actors string, roles_names string, location string, languages string, lighting string, video_id string, duration_sec string, view_count string, upload_date string"
    row = spark.createDataFrame([("u", "Sketch 5", "a; b", "c", "Հայկո զոքանչ", "r", "Տուն", "hy", "day", "abcdefghijk", "120.0", "10.0", "20130410.0")], cols)
    r = canon.catalogue(row).first()
    assert (r.id, r.seq, r.lines, r.actors, r.rolesNames, r.durationSec, r.viewCount, r.uploadDate, r.segments) == ("abcdefghijk", 5, ["a", "b"], ["Հայկո"], "r, զոքանչ", 120, 10, "2013-04-10", [])
    assert canon.coverage(canon.catalogue(row)).first() == (1, 1, 1)


def test_co_occurrence_is_symmetric_without_a_diagonal(spark):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (3, "c")], "id int, actor string")
    for top in (7, None):
        got = {(r.a, r.b): r.n for r in stats.co_occurrence(b, "actor", "id", top).collect()}
        assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1}


def test_bigrams_and_words(spark):
    rows = spark.createDataFrame([("բարի լույս ա բարի լույս",), (None,), ("մեկ",)], "t string")
    assert stats.bigram_counts(rows, F.col("t"), vocab.ARCHIVE_WORD).collect()[0] == ("բարի լույս", 2)
    assert {r.word: r.n for r in stats.word_counts(rows, F.col("t"), vocab.ARCHIVE_WORD).collect()} == {"բարի": 2, "լույս": 2}


def test_composition(spark):
    rows = sketches(spark, sketch("1", actors=["Մկո", "Հայկո"]), sketch("2", actors=["Հայկո"]), sketch("3", actors=["a", "b", "c"]), sketch("4"))
    assert {r.kind: r.n for r in stats.composition(rows, "actors", ("Հայկո", "Մկո")).collect()} == {"duo": 1, "solo": 1, "ensemble": 1, "uncurated": 1}


def test_buckets_and_histogram(spark):
    rows = spark.createDataFrame([(None, 10), (119, 20), (120, None), (300, 5)], "s int, v long")
    got = [(r.bucket, r.n, r.avg_views) for r in stats.buckets(rows, F.col("s") / 60, [2, 3, 4, 5], ["<2", "2-3", "3-4", "4-5", "5+"], "v").orderBy("ord").collect()]
    assert got == [("<2", 2, 15), ("2-3", 1, 0), ("5+", 1, 5)]
    assert [r.n for r in stats.histogram(rows, "v", [10, 15], ["a", "b", "c"]).orderBy("ord").collect()] == [2, 1, 1]


def test_by_sequence_has_a_ninth_bin(spark):
    rows = spark.range(1, 18).select(F.col("id").alias("seq"), F.lit(10).alias("v"))
    got = stats.by_sequence(rows, "seq", "v").orderBy("chunk").collect()
    assert len(got) == 9 and got[0].label == "1-2" and got[-1].label == "17-17"
    assert stats.by_sequence(rows.limit(0), "seq", "v").count() == 0


def test_extremes_and_means_count_nulls_as_zero(spark):
    rows = spark.createDataFrame([("a", None, 4), ("b", 5, None), ("c", 9, 4)], "k string, d int, v int")
    assert stats.extremes(rows, "d", "k").first() == ("a", None, "c", 9)
    assert stats.means_by(rows.withColumn("g", F.lit("x")), "g", "v").first().avg_views == 3


def test_build_stats_sections(spark):
    rows = sketches(spark, *[sketch(str(i), seq=i, actors=["Հայկո", "Մկո"], viewCount=i * 1000, uploadDate=f"2013-01-{i:02d}", text="բարի լույս Անի") for i in range(1, 10)])
    got = stats.build_stats(rows, ("Հայկո", "Մկո"))
    assert len(got) == 15
    assert got["totals"].first().actors == 2 and got["byActorAvgViews"].count() == 2 and sum(r.n for r in got["viewsHistogram"].collect()) == 9
    assert got["nameSuggestions"].first() == ("Անի", 9)


def test_search_scores_and_order(spark):
    rows = sketches(spark, sketch("1", text="hello world", viewCount=5), sketch("2", title="Hello", viewCount=1), sketch("3", textCommon="hello", text="hello", viewCount=0), sketch("4", text="տոռմուզ"))
    ix = search.index(rows)
    assert [(r.id, r.score) for r in search.search(ix, " HELLO ").collect()] == [("3", 8.0), ("2", 4.0), ("1", 3.0)]
    assert [(r.id, r.score) for r in search.search(ix, "tormuz").collect()] == [("4", 1.0)]
    assert [r.id for r in search.search(ix, "тормуз").collect()] == ["4"]
    assert [r.id for r in search.search(ix, "torzuz").collect()] == ["4"]
    assert search.search(ix, "").count() == 4
    assert {r.id for r in search.search(ix, "", sort="random", seed=1).collect()} == {"1", "2", "3", "4"}
    assert search.page(search.search(ix, ""), 1, 2).count() == 2


def test_search_finds_decomposed_text(spark):
    ix = search.index(sketches(spark, sketch("1", text="café")))
    assert search.search(ix, "café").count() == 1


def test_fuzzy_never_outranks_exact(spark):
    ix = search.index(sketches(spark, sketch("1", text="tormuz"), sketch("2", text="tormus", viewCount=99)))
    got = search.search(ix, "tormuz").collect()
    assert [r.id for r in got] == ["1", "2"] and got[1].score < 0.5


def test_gate_keeps_fuzzy_out_when_exact_is_plentiful(spark):
    ix = search.index(sketches(spark, *[sketch(f"{i:02d}", text="tormuz") for i in range(12)], sketch("99", text="tormus")))
    assert search.search(ix, "tormuz").count() == 12


def test_filters(spark):
    rows = sketches(spark, sketch("1", durationSec=120), sketch("2", durationSec=240), sketch("3", durationSec=None), sketch("4", durationSec=119, location="Տուն", actors=["a"], languages=["hy"]))
    ids = lambda **k: [r.id for r in rows.where(search.filters(**k)).orderBy("id").collect()]
    assert ids(duration="2-4") == ["1", "2"] and ids(duration="<2") == ["4"] and ids(duration="4+") == []
    assert ids(location=["Տուն"], actors=["a", "b"], language=["hy"]) == ["4"] and ids() == ["1", "2", "3", "4"]


def test_page_search_names_its_own_best_field(spark):
    rows = spark.createDataFrame([("1", "abc def", "zzz", "L", "hy", "2"), ("2", "zzz", "abc", "L", "ru", "x")], "id string, text string, text_common string, location string, languages string, main_actors_count string")
    got = search.page_search(rows, "abc", ("text", "text_common"), mode="fuzzy")
    assert [(r.id, r.best_field) for r in got.collect()] == [("1", "text"), ("2", "text_common")]
    assert search.page_search(rows, "abc", ("text",), language="hy", n_actors=(1, 3)).count() == 1


def test_bot_search_keeps_one_row_a_link(spark):
    rows = spark.createDataFrame([("l1", "funny show", "a funny text", "x"), ("l2", "other", "funny", "y")], "links string, titles string, text string, main_actors string")
    got = search.bot_search(rows, "funny").collect()
    assert sorted(r.links for r in got) == ["l1", "l2"] and next(r for r in got if r.links == "l1").kind == "title"


def related_fixture(spark):
    rows = spark.createDataFrame([("t", "Տուն", 1), ("rare", "x", 1), ("lead", "x", 100), ("none", "x", 50), ("here", "Տուն", 2)], "id string, location string, v long")
    bridge = spark.createDataFrame([("t", "lead"), ("t", "guest"), ("rare", "guest"), ("lead", "lead"), ("here", "lead")], "id string, actor string")
    return rows, bridge


def test_related_puts_rare_first_and_fills(spark):
    rows, bridge = related_fixture(spark)
    got = discover.related(rows, bridge, "t", "id", "actor", "location", "v", limit=4).collect()
    assert [r.id for r in got] == ["rare", "here", "lead", "none"] and got[0].score == 0.5 and got[1].score == pytest.approx(0.383333)


def test_find_by_name(spark):
    rows = sketches(spark, sketch("1", actors=["Անի"], viewCount=1), sketch("2", text="եկավ Անին", lines=["բարև", "եկավ Անին"], viewCount=9), sketch("3", text="բանի"))
    find = lambda n: discover.find_by_name(rows, n, "viewCount", "id", F.array_join("actors", " "), F.col("rolesNames"), F.concat_ws(" ", "text", "textCommon"), "lines", "text", "textCommon")
    assert [(r.id, r.kind, r.snippet) for r in find("անի").collect()] == [("2", "mention", "եկավ Անին"), ("1", "actor", None)]
    assert find("  ").count() == 0


def test_profile_and_names(spark):
    rows = spark.createDataFrame([("1", 2, "p"), ("2", 3, ""), ("3", 9, "q")], "id string, v long, phrase string")
    bridge = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "b"), ("3", "b")], "id string, actor string")
    assert discover.actor_profile(rows, bridge, "a", "id", "actor", "v").first() == ("a", 2, 5, 3)
    assert discover.co_stars(bridge, "a", "id", "actor").collect() == [("b", 1)]
    assert [r.actor for r in discover.actor_names(bridge, "actor").collect()] == ["a", "b"]
    assert [r.phrase for r in discover.catchphrases(rows, "phrase", "id").collect()] == ["p", "q"]


def test_phrase_tiles(spark):
    phrases = spark.createDataFrame([("good morning all",), ("a b",), ("never said this",)], "p string")
    docs = spark.createDataFrame([(1, "x good morning all", 5), (2, "good morning ally", 9), (3, "a b", 1), (4, "a b", 1)], "id int, t string, v int")
    got = {r.phrase: (r.key, r.views) for r in discover.phrase_tiles(phrases, "p", docs, "t", "id", "v").collect()}
    assert got == {"good morning all": (2, 9), "a b": (3, 1)}


def test_upsert_first_todo_and_sequence(spark):
    base = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 2, "keep")], "k string, ts int, n int, v string")
    new = spark.createDataFrame([("a", 2, 3, "new"), ("a", 2, 4, "newer")], "k string, ts int, n int, v string")
    assert sorted((r.k, r.v) for r in relational.upsert(base, new, "k", "ts", "n").collect()) == [("a", "newer"), ("b", "keep")]
    assert relational.first_of(new, "k", "n").first().v == "new"
    assert [r.k for r in relational.todo(base, new, "k", "k", 5).collect()] == ["b"]
    seq = relational.available(spark.createDataFrame([(5, None), (7, "private"), (9, "public")], "o int, availability string"), "availability", "o")
    assert [(r.o, r.file_seq) for r in seq.orderBy("o").collect()] == [(5, 1), (9, 2)]


def test_succeeded_counts_blank_as_no_error(spark):
    assert relational.succeeded(spark.createDataFrame([("",), (None,), ("x",)], "e string"), "e").count() == 2


def test_checked_key_fails_on_a_missing_key(spark):
    rows = spark.createDataFrame([("a",), (None,)], "u string")
    assert relational.missing_keys(rows, "u") == 1
    with pytest.raises(Exception, match="has no key"):
        relational.checked_key(rows, F.col("u"), "k").collect()


def test_reconcile_lookup_compare_and_migrate(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {r.where_found: r.n for r in relational.reconcile(a, b, "k").collect()} == {"left": 1, "right": 1, "both": 1}
    assert sorted((r.k, r.v) for r in relational.lookup(a, b, "k", "v").collect()) == [(1, ""), (2, "x")]
    assert sorted((r.k, r.s) for r in relational.compare(a, {"s": b}, "k", "v").collect() if r.s) == [(2, "x")]
    assert relational.migrate(a, ["k", "z"]).columns == ["k", "z"]


def test_flatten_captions(spark, tmp_path):
    (tmp_path / "001_Title_e_oaM_OaTTU.hy-orig.json3").write_text('{"events":[{"tStartMs":1500,"segs":[{"utf8":" a"},{"utf8":"b "}]},{"tStartMs":2000,"dDurationMs":500},{"tStartMs":3000,"dDurationMs":1234,"segs":[{"utf8":"\\n"}]},{"tStartMs":4000,"dDurationMs":500,"segs":[{"utf8":"c"}]}]}')
    (tmp_path / "other.txt").write_text("x")
    r = transcripts.flatten(readers.captions(spark, str(tmp_path)), "file").first()
    assert (r.video_id, r.seq, r.source_lang, r.n_events, r.duration_sec, r.full_text) == ("e_oaM_OaTTU", 1, "hy", 2, 4.5, "ab\nc")
    assert [tuple(e) for e in r.events] == [(1.5, 1.5, "ab"), (4.0, 4.5, "c")]
    assert [x.lang for x in readers.caption_languages(readers.captions(spark, str(tmp_path))).collect()] == ["hy"]


def test_costs(spark):
    runs = spark.createDataFrame([("lite", 100.0, 10.0, 2_000_000, 1_000_000)], "model string, audio_sec double, gen_sec double, tokens_in long, tokens_out long")
    t = transcripts.run_totals(runs, transcripts.price_table(spark))
    assert t.first().cost_usd == pytest.approx(2.5)
    assert transcripts.extrapolate(t, 1).first().full_cost_usd == pytest.approx(2.5 * 36)


def test_parse_runs_keeps_broken_answers(spark):
    rows = spark.createDataFrame([('{"full_text":"a","segments":[]}',), ("oops",)], "raw string")
    got = transcripts.parse_runs(rows, "raw").collect()
    assert got[0].parsed.full_text == "a" and got[0].parse_error is None and got[1].parse_error and got[1].raw == "oops"


def test_quiz(spark):
    a = spark.createDataFrame([(1, 1, 0.6), (1, 1, 0.95), (1, 2, 0.5), (1, 3, 0.8)], "u int, level int, f double")
    got = [(r.level, r.best, r.stars, r.passed, r.unlocked) for r in transcripts.quiz_progress(a, "u", "level", "f").orderBy("level").collect()]
    assert got == [(1, 0.95, 3, True, True), (2, 0.5, 0, False, True), (3, 0.8, 2, True, False)]


def test_usage_parse(spark):
    many = "[" + ",".join(['{"type":"open","sketchId":"x"}'] * 60) + "]"
    rows = spark.createDataFrame([('{"sessionId":"s","type":"search","query":"q","filters":{"a":1},"resultCount":3}', "u" * 300), (many, "u"), ("{}", None), ("nope", "u")], "body string, ua string")
    got = usage.parse(rows).collect()
    assert len(got) == 52 and len(got[0].ua) == 200 and got[0].filters == '{"a":1}' and (got[-1].session_id, got[-1].type) == ("", "unknown")
    assert usage.broken(rows).count() == 1


def test_usage_reports(spark):
    e = spark.createDataFrame([("search", "a"), ("search", "a"), ("search", ""), ("open", "b")], "type string, query string")
    assert usage.top_by(e, "search", "type", "query").collect() == [("a", 2)]
    t = spark.sql("select * from values ('s', timestamp'2024-01-01 00:00:00'), ('s', timestamp'2024-01-01 00:00:00.5'), ('s', timestamp'2024-01-01 00:00:05') as t(session, ts)")
    assert usage.settled(t, "session", "ts").count() == 2


def test_item_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"v1","snippet":{"title":"t","publishedAt":"2013-04-10T01:02:03Z","defaultAudioLanguage":"hy","categoryId":"23","tags":["a"]},"contentDetails":{"duration":"PT1M","caption":"true"},"statistics":{"viewCount":"5","likeCount":""},"status":{"privacyStatus":"public"}}\n')
    r = readers.item_rows(readers.items(spark, str(tmp_path))).first()
    assert len(r) == 27 and (r.duration_sec, r.upload_date, r.view_count, r.like_count, r.yt_declared_language, r.categories, r.tags, r.caption_available) == (60, "20130410", 5, None, "hy", '["23"]', '["a"]', True)
    bad = readers.error_rows(spark.createDataFrame([("v2", "gone")], "k string, e string"), "k", "e").first()
    assert len(bad) == 27 and bad.fetch_error == "gone" and bad.title is None


def test_csv_round_and_writers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('links,titles,text,text_common,main_actors,roles_names,location,languages,lighting,main_actors_count\nu,"t ""q""","a\nb",,x,,,,,2\n')
    r = readers.curated(spark, str(tmp_path / "c.csv")).first()
    assert (r.titles, r.text, r.text_common) == ('t "q"', "a\nb", None)
    rows = spark.createDataFrame([("hy", 1, "ա"), ("ru", 2, "б")], "source_lang string, id int, t string")
    writers.transcripts(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("source_lang = 'hy'").count() == 1
    writers.json_document({"s": rows}, str(tmp_path / "s.json"))
    assert "ա" in (tmp_path / "s.json").read_text()
    assert writers.markdown(rows, "T").count("|") > 8
    with pytest.raises(ValueError):
        writers.json_document({"s": rows}, str(tmp_path / "s.json"), most=1)
    writers.upsert_table(None, rows, str(tmp_path / "u1"), "source_lang", "id", "t")
    writers.upsert_table(str(tmp_path / "u1"), rows.where("id = 1").withColumn("id", F.lit(5)), str(tmp_path / "u2"), "source_lang", "id", "t")
    assert {r.id for r in spark.read.parquet(str(tmp_path / "u2")).collect()} == {5, 2}


def test_missed_captions_and_picks(spark):
    files = spark.createDataFrame([("/x/001_A_b_abcdefghijk.hy-orig.json3",), ("/x/002_A_AAAAAAAAAAA.no_captions",), ("/x/001_A_b_abcdefghijk.no_captions",)], "file string")
    seen = spark.createDataFrame([("abcdefghijk", 1), ("AAAAAAAAAAA", 2), ("BBBBBBBBBBB", 3)], "video_id string, seq int")
    got = {r.video_id: r.captions for r in relational.captioned(seen, files, "video_id").collect()}
    assert got == {"abcdefghijk": "kept", "AAAAAAAAAAA": "none", "BBBBBBBBBBB": "todo"}
    assert {r.seq for r in relational.picks(seen, ["abcdefghijk", "3"], "video_id", "seq").collect()} == {1, 3}
    assert relational.picks(seen, [], "video_id", "seq").count() == 3


def test_words_without_a_part_of_the_query_are_never_near(spark):
    import random

    from scriptorium.functions import text as T

    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k int, combined string")
    for query in ("abc", "abcab", "cabbaacb"):
        slow = rows.where("length(combined) >= 2").withColumn("near", T.near_score("combined", query)).where(f"near <= {search.FUZZY_MOST}")
        assert sorted(search.fuzzy(rows, query, "k").select("k", "near").collect()) == sorted(slow.select("k", "near").collect())


def test_composition_where_it_matters(spark):
    import unicodedata

    from scriptorium.functions import text as T

    texts = ["plain", "é", "Å", "한", "բարև", "тормуз й", "й", ";", "Ω", None, "ẋ̣", "豈"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.nfc("t").alias("x")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_short_phrases_are_searched_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "x a b", 9), (3, "none", 1)], "k int, t string, v int")
    phrases = spark.createDataFrame([("a b",), ("zz",), ("no",)], "p string")
    got = {r.phrase: r.key for r in discover.phrase_tiles(phrases, "p", docs, "t", "k", "v").collect()}
    assert got == {"a b": 2, "no": 3}
    many = spark.createDataFrame([(f"{a}{b}",) for a in map(chr, range(97, 123)) for b in ["", *map(chr, range(97, 123))]], "p string")
    got = {r.phrase: r.key for r in discover.phrase_tiles(many, "p", docs, "t", "k", "v").collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "x": 2, "n": 3, "o": 3, "e": 3, "no": 3, "on": 3, "ne": 3}


def test_places_follow_the_order_however_rows_are_dealt(spark):
    from scriptorium.operators.ranges import placed

    numbers = [1] * 300 + list(range(2, 50)) + [10**12, None, None, -5]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(numbers)], "n long, t int").repartition(4)
    got = {r.t: r._place for r in placed(rows, "n", "t").collect()}
    order = sorted(range(len(numbers)), key=lambda i: (numbers[i] is not None, numbers[i] or 0, i))
    assert got == {t: i for i, t in enumerate(order)}
    assert sorted(r._place for r in placed(rows, "n").collect()) == list(range(len(numbers)))
    assert placed(rows.limit(0), "n").collect() == []


def test_cost_run_of_the_command_line(spark, tmp_path, capsys):
    import json

    from scriptorium.__main__ import main

    for name, model, tokens in (("a", "lite", 1_000_000), ("b", "pro", 2_000_000)):
        (tmp_path / f"x_summary__{name}.json").write_text(json.dumps({"model": model, "audio_sec": 3600.0, "gen_sec": 60.0, "tokens_in": tokens, "tokens_out": 0}))
    main(["costs", "--input", str(tmp_path), "--model", "pro"])
    out = capsys.readouterr().out
    assert "pro" in out and "lite" not in out and "4.0" in out


def test_each_different_text_is_scored_once(spark):
    rows = [(1, "Small Ring", "x", "en"), (2, "small ring", None, "en"), (3, None, "samll rnig", "en"), (4, "", "", "de"), (5, "rings", "smal ring", "en")]
    r = spark.createDataFrame(rows, "id int, a string, b string, languages string")
    assert search._texts(r, ("a", "b")).count() == 6
    tries = [(f, s) for f in "ab" for s in T.SCORERS]
    one = r.select("id", *(T.similarity(f, "small ring", s).alias(f"{f}_{s}") for f, s in tries)).collect()
    want = {x.id: max((x[f"{f}_{s}"], -i, f, s) for i, (f, s) in enumerate(tries)) for x in one}
    got = search.page_search(r, "Small ring", ("a", "b"), mode="fuzzy", least=60)
    assert got.columns == [*r.columns, "score", "best_field", "best_scorer"]
    assert {x.id: (x.score, x.best_field, x.best_scorer) for x in got.collect()} == {k: (w[0], *w[2:]) for k, w in want.items() if w[0] >= 60}
    all_ = search.similarities(r, "a", "small ring").collect()
    assert {(x.id, *(x[s] for s in T.SCORERS)) for x in all_} == {(x.id, *(x[f"a_{s}"] for s in T.SCORERS)) for x in one}
