import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("url, want", [("https://www.youtube.com/watch?v=ofvCL_U2Er0&list=x", "ofvCL_U2Er0"), ("https://youtu.be/ofvCL_U2Er0", "ofvCL_U2Er0"), ("not a url", None), (None, None)])
def test_video_id(spark, url, want):
    assert one(spark, T.video_id("u"), u=url) == want


@pytest.mark.parametrize(
    "url, want",
    [("https://youtu.be/abc", "abc"), ("https://www.youtube.com/watch?v=abc&t=1", "abc"), ("https://m.youtube.com/shorts/xyz", "xyz"), ("https://youtube.com/embed/q/1", "q"), ("https://example.com/watch?v=abc", None), ("nonsense", None), (None, None)],
)
def test_video_id_by_host(spark, url, want):
    assert one(spark, T.video_id_by_host("u"), u=url) == want


def test_video_id_by_host_without_shorts(spark):
    assert one(spark, T.video_id_by_host("u", shorts=False), u="https://youtube.com/shorts/xyz") is None


@pytest.mark.parametrize("title, want", [("Show SKETCH 12 x", 12), ("ՍՔԵԹՉ 7", 7), ("no number", None), (None, None)])
def test_episode_number(spark, title, want):
    assert one(spark, T.episode_number("t"), t=title) == want


@pytest.mark.parametrize("text, want", [("բարև; ոնց ես։ լավ", ["բարև", "ոնց ես", "լավ"]), ("1-2 հատ", ["1-2 հատ"]), ("  ;a\n", ["a"]), (None, [])])
def test_split_lines(spark, text, want):
    assert one(spark, T.split_lines("t"), t=text) == want


@pytest.mark.parametrize("raw, want", [("20130410.0", "2013-04-10"), ("20139999", "2013-99-99"), ("2013", ""), (None, "")])
def test_date_text(spark, raw, want):
    assert one(spark, T.date_text("d"), d=raw) == want


@pytest.mark.parametrize("raw, want", [("PT1H2M3S", 3723), ("PT5M", 300), ("PT", 0), ("P1DT1H", None), (None, None)])
def test_iso_seconds(spark, raw, want):
    assert one(spark, T.iso_seconds("d"), d=raw) == want


def test_iso_day(spark):
    assert one(spark, T.iso_day("d"), d="2013-04-10T23:59:59Z") == "20130410"
    assert one(spark, T.iso_day("d"), d="bad") is None


@pytest.mark.parametrize(
    "raw", ["2013-04-10", "2013-04-10Tgarbage", "20130410", "2013-04-10T23", "2013-04-10 23:59", "2013-04-10T23:59:59.123456+04:00", "20130410T235959Z", "2013-04-10T24:01", "2013-04-10T23:60", "2013-02-30", "2013-0410", "2013-04-10T", "2013-04-10T23:59:59+25:00", "", "2016-02-29x10:00", "2013-04-10T23:59:5"]
)
def test_iso_day_takes_the_whole_stamp(spark, raw):
    from datetime import datetime

    try:
        want = datetime.fromisoformat(raw.replace("Z", "+00:00")).strftime("%Y%m%d")
    except ValueError:
        want = None
    assert one(spark, T.iso_day("d"), d=raw) == want


@pytest.mark.parametrize("n, want", [(1358199, "1.4M"), (813444, "813K"), (999500, "1000K"), (12, "12"), (0, "0")])
def test_format_views(spark, n, want):
    assert one(spark, T.format_views("n"), n=n) == want


@pytest.mark.parametrize("n, want", [(242, "4:02"), (0, "0:00"), (59, "0:59")])
def test_format_duration(spark, n, want):
    assert one(spark, T.format_duration("n"), n=n) == want


@pytest.mark.parametrize("word, want", [("տոռմուզ", "tormuz"), ("Տոռմուզը", "tormuz"), ("և", "ev"), ("abc", "abc"), ("շուն", "shun"), ("ճաշ", "chash")])
def test_romanize(spark, word, want):
    assert one(spark, T.romanize("w"), w=word) == want


def test_cyrillize(spark):
    assert one(spark, T.cyrillize("w"), w="տոռմուզ") == "тормуз"


def test_normalize_composes_and_folds(spark):
    assert one(spark, T.normalize("t"), t="  ÉA  \n b ") == "éa b"


def test_name_hit_knows_endings_but_not_insides(spark):
    hit = lambda t: one(spark, T.name_hit("t", "անի"), t=t)
    assert hit("Անին եկավ") and hit("անի") and not hit("բանի") and not hit("անիմաստ")


def test_caption_file_keeps_ids_with_underscores(spark):
    r = one(spark, T.caption_file("f"), f="028_Title_x_e_oaM_OaTTU.ar-orig.json3")
    assert (r.seq, r.lang, r.video_id) == (28, "ar", "e_oaM_OaTTU")


def test_near_score(spark):
    assert one(spark, T.near_score("w", "torzuz"), w="tormuz") == pytest.approx(1 / 6)
    assert one(spark, T.near_score("w", "tormus"), w="xxtormuzyy") == pytest.approx(1 / 6)
    assert one(spark, T.near_score("w", "torzuz"), w="hello") > 0.35


def test_highlight(spark):
    assert one(spark, T.highlight("t", "ab", 2), t="xxABxxxxxxab") == "...xx**AB**xx...\n...xx**ab**..."
    assert one(spark, T.highlight("t", "zz"), t="abc") == ""


def test_near_window(spark):
    assert one(spark, T.near_window("t", "cat"), t="the bat sat") == "bat"


def test_preview_age_and_thousands(spark):
    assert one(spark, T.preview("t", 3), t="abcd") == "abc..."
    assert one(spark, T.preview("t", 3), t="abc") == "abc"
    assert one(spark, T.thousands("n"), n=1234567) == "1,234,567"
    assert one(spark, T.age(F.lit("2024-01-01").cast("date"), F.lit("2024-01-11").cast("date"))) == "10 days ago"


def test_scorers(spark):
    score = lambda scorer, query, text: one(spark, T.similarity("t", query, scorer), t=text)
    assert score("partial_ratio", "abc", "xxabcxx") == 100
    assert score("token_sort_ratio", "b a", "a b") == 100
    assert score("token_set_ratio", "a b", "a b c") == 100
    assert 0 <= score("ratio", "abc", "xyz") < 1


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_score(scorer, q, t):
    ratio = lambda a, b: 100.0 if not a and not b else 200 * plain_common(a, b) / (len(a) + len(b))
    if scorer == "ratio":
        return ratio(q, t)
    if scorer == "token_sort_ratio":
        return ratio(" ".join(sorted(q.split())), " ".join(sorted(t.split())))
    if scorer == "token_set_ratio":
        x, y = set(q.split()), set(t.split())
        both, a, b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        one, two = f"{both} {a}".strip(), f"{both} {b}".strip()
        return max(ratio(both, one), ratio(both, two), ratio(one, two)) if both else ratio(one, two)
    short, long = sorted((q, t), key=len)
    return (100.0 if not long else 0.0) if not short else max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


@pytest.mark.parametrize("scorer", T.SCORERS)
@pytest.mark.parametrize("query", ["small ring", "a", "b a c a", "ցուրտ կատու é😀", "a bc def ghij klmno pqrstu vwxyz ab cd ef gh ij kl mn op qr st"])
def test_scorers_equal_plain_versions(spark, scorer, query):
    import random

    rnd = random.Random(len(query))
    texts = ["", query, query[:3], query[::-1], query + " " + query, "Small RING".lower(), "x"] + [" ".join(rnd.choice([*query.split(), "ring", "ab", "é😀", "zz"]) for _ in range(rnd.randrange(7))) for _ in range(25)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.similarity("t", query, scorer)).collect()]
    assert got == pytest.approx([plain_score(scorer, query, t) for t in texts])


def test_long_queries(spark):
    q = "word " * 20
    assert one(spark, T.similarity("t", q, "ratio"), t="word " * 19) == pytest.approx(plain_score("ratio", q, "word " * 19))
    assert one(spark, T.similarity("t", "ab " * 30 + "cd", "token_set_ratio"), t="cd ef") == pytest.approx(plain_score("token_set_ratio", "ab cd", "cd ef"))
    with pytest.raises(ValueError, match="characters at most"):
        T.similarity("t", q, "partial_ratio")


def plain_highlight(text, query, context=50):
    import re

    out, last = [], 0
    for m in re.compile(re.escape(query), re.IGNORECASE).finditer(text):
        a, b = max(m.start() - context, last), min(m.end() + context, len(text))
        s = text[a:b].replace(m[0], f"**{m[0]}**")
        out.append(f"...{s}..." if a > 0 or b < len(text) else s)
        last = m.end()
    return "\n".join(out)


@pytest.mark.parametrize("query", ["ab", "a.b", "Կ", "(x)", "aa", "-^"])
def test_highlights_equal_a_plain_version(spark, query):
    import random

    rnd = random.Random(3)
    parts = [query, query.upper(), query.lower(), "x", "ab ", "\n", "$1", "կԿ", "a.b", "(x)"]
    texts = ["", query, query * 3] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(30)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.highlight("t", query, 7)).collect()]
    assert got == [plain_highlight(t, query, 7) for t in texts]
    assert one(spark, T.highlight("t", query), t=None) is None


def test_links(spark):
    assert one(spark, T.deep_link("v", "s"), v="abc", s=12.9).endswith("v=abc&t=12s")
    assert one(spark, T.watch_url("v"), v="") == "" and one(spark, T.thumbnail_url("v"), v=None) == ""


def test_source_language(spark):
    got = spark.sql("select map('en', 1, 'hy-orig', 2) m").select(T.source_language("m")).first()[0]
    assert got == "hy"


@pytest.mark.parametrize("n, want", [(1_250_000, "1.2M"), (1_150_000, "1.1M"), (1_750_000, "1.8M"), (1_350_000, "1.4M"), (10_050_000, "10.1M"), (12_250_000.0, "12.2M")])
def test_format_views_rounds_the_double_itself(spark, n, want):
    assert one(spark, T.format_views("n"), n=n) == want == f"{n / 1e6:.1f}M"
