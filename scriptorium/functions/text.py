"""Text functions as columns: normalization, tokens, transliteration, name hits, parsing and formatting."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions import vocab
from scriptorium.functions.distance import substring_distance
from scriptorium.functions.scorers import NAMES as SCORERS, similarity  # noqa: F401


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: Texts of characters that composition never changes: Latin letters with marks, Cyrillic and Armenian letters, common punctuation and
#: currency signs. One match of the whole text, without a way back, takes a tenth of the time of looking for any other character.
_COMPOSED = r"^[\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{58F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*+\z"

#: Runs of white space that are not one blank already.
_SPACES = r"(?U)[\s&&[^ ]]\s*| \s+"


def nfc(c: str | Column) -> Column:
    """Canonical composition. The only text function without a built-in form; only values with a character that it may change cross to a worker."""
    v = _col(c)
    return F.coalesce(_nfc(F.when(~v.rlike(_COMPOSED), v)), v)


def strip(c: str | Column) -> Column:
    """Leading and trailing white space of any kind removed, not only blanks."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean(c: str | Column) -> Column:
    """Stripped text, the empty text for null."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit(""))


def fold(c: str | Column) -> Column:
    """Lower case, runs of white space as one blank, stripped; for text that is in composed form already."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), _SPACES, " "))


def normalize(c: str | Column) -> Column:
    """fold() of the composed lower-case text."""
    return F.trim(F.regexp_replace(nfc(F.lower(_col(c))), _SPACES, " "))


def words(c: str | Column, pattern: str = vocab.ANY_WORD) -> Column:
    """Lower-case words by a pattern; empty for null."""
    return F.regexp_extract_all(F.coalesce(F.lower(_col(c)), F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def transliterate(c: str | Column, table: tuple[Mapping[str, str], Mapping[str, str]]) -> Column:
    """Lower-case text with digraphs, then letters replaced; other characters stay. Letters that give one or no character go in one pass."""
    digraphs, letters = table
    out = F.lower(_col(c))
    # Digraphs become signs of the private area first, so that no later step sees their results.
    for i, a in enumerate(digraphs):
        out = F.replace(out, F.lit(a), F.lit(chr(0xE000 + i)))
    one = {a: b for a, b in letters.items() if len(b) == 1}
    none = [a for a, b in letters.items() if not b]
    for a, b in letters.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "".join([*one, *none]), "".join(one.values()))
    for i, b in enumerate(digraphs.values()):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(b))
    return out


def romanize(c: str | Column) -> Column:
    return transliterate(c, vocab.LATIN)


def cyrillize(c: str | Column) -> Column:
    return transliterate(c, vocab.CYRILLIC)


def name_hit(text: str | Column, name: str | Column, suffixes: Sequence[str] = vocab.NAME_SUFFIXES, pattern: str = vocab.ANY_WORD) -> Column:
    """Whether a word of the text is the name, or the name with one of the suffixes. `name` is a normalized text or a column."""
    n = F.lit(name) if isinstance(name, str) else name
    ends = F.array(*map(F.lit, suffixes))
    return F.exists(words(text, pattern), lambda w: F.startswith(w, n) & F.array_contains(ends, F.substring(w, F.length(n) + 1, F.length(w))))


def split_lines(c: str | Column, separators: str = "[;։]") -> Column:
    """Stripped parts between separators, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), separators), strip), lambda x: x != "")


def video_id(url: str | Column) -> Column:
    """The first 11 id characters after `v=` or `youtu.be/`; null without a match."""
    return F.nullif(F.regexp_extract(_col(url), r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def video_id_by_host(url: str | Column, shorts: bool = True) -> Column:
    """The id by host and path: short host, watch query, or embed, v and (if asked for) shorts paths. No length is checked."""
    u = strip(url)
    part = lambda p: F.try_parse_url(u, F.lit(p))
    host, path = F.lower(part("HOST")), part("PATH")
    kinds = "embed|v|shorts" if shorts else "embed|v"
    long = F.when(path == "/watch", F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))).when(path.rlike(f"^/({kinds})/"), F.nullif(F.regexp_extract(path, f"^/(?:{kinds})/([^/]*)", 1), F.lit("")))
    return F.when(host.isin("youtu.be", "www.youtu.be"), F.nullif(F.regexp_replace(path, "^/+", ""), F.lit(""))).when(host.isin("youtube.com", "www.youtube.com", "m.youtube.com"), long)


def host(url: str | Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    return F.lower(F.try_parse_url(strip(url), F.lit("HOST")))


def episode_number(title: str | Column, word: str = "sketch|սքեթչ") -> Column:
    """The number after the word, in any case; null without a match."""
    return F.try_to_number(F.nullif(F.regexp_extract(_col(title), rf"(?iu)(?:{word})\s*(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("int")


def date_text(raw: str | Column) -> Column:
    """`YYYY-MM-DD` of eight characters before a dot, else the empty text; calendars are not consulted."""
    d = F.split_part(clean(raw), F.lit("."), F.lit(1))
    return F.when(F.length(d) == 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise("")


def iso_seconds(duration: str | Column) -> Column:
    """Seconds of `PT#H#M#S`; 0 for a bare `PT`; null for anything else, days included."""
    c, pattern = _col(duration), r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    n = lambda g: F.coalesce(F.nullif(F.regexp_extract(c, pattern, g), F.lit("")).cast("int"), F.lit(0))
    return F.when(c.rlike(pattern), n(1) * 3600 + n(2) * 60 + n(3))


def _clock(hour: str) -> str:
    """Hours, minutes and seconds with fractions, each but the first optional, with colons or without."""
    return rf"{hour}(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"


#: A day of either form; then, if at all, any sign, a time of the day and an offset.
_ISO_STAMP = rf"(?s)^(\d{{4}}-\d\d-\d\d|\d{{8}})(?:.{_clock('(?:[01][0-9]|2[0-3])')}(?:Z|[+-]{_clock('(?:[01][0-9]|2[0-3])')})?)?$"


def iso_day(stamp: str | Column) -> Column:
    """`YYYYMMDD` of an ISO time stamp as it is written; null if the whole is not one, or its day is not in the calendar."""
    day = F.regexp_replace(F.regexp_extract(_col(stamp), _ISO_STAMP, 1), "-", "")
    return F.date_format(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyyMMdd")), "yyyyMMdd")


def format_views(views: str | Column) -> Column:
    """`0`, `813K` or `1.4M`; the double itself is rounded, not its shortest decimal form, and halves go to the even digit."""
    v = F.coalesce(_col(views), F.lit(0))
    return F.when(v >= 1_000_000, F.concat(F.call_function("format_number", (v / 1e6).cast("double"), F.lit("0.0")), F.lit("M"))).when(v >= 1_000, F.concat(F.floor(v / 1e3 + 0.5).cast("string"), F.lit("K"))).otherwise(v.cast("string"))


def format_duration(seconds: str | Column) -> Column:
    """`m:ss`."""
    s = F.coalesce(_col(seconds).cast("long"), F.lit(0))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def deep_link(video: str | Column, start: str | Column) -> Column:
    """A watch link that starts at a whole second."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), _col(video), F.lit("&t="), F.floor(_col(start)).cast("string"), F.lit("s"))


def watch_url(video: str | Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), F.nullif(_col(video), F.lit(""))), F.lit(""))


def thumbnail_url(video: str | Column) -> Column:
    return F.coalesce(F.concat(F.lit("https://i.ytimg.com/vi/"), F.nullif(_col(video), F.lit("")), F.lit("/hqdefault.jpg")), F.lit(""))


def caption_file(name: str | Column) -> Column:
    """stem, lang, seq and video_id of a caption file's name; the id is the last 11 characters of the stem, so it may hold underscores."""
    n = F.regexp_extract(_col(name), r"([^/]*)$", 1)
    stem = F.regexp_replace(n, r"\.[^.]*\.(json3|json)$", "")
    lang = F.regexp_replace(F.regexp_extract(n, r"\.([^.]*)\.(?:json3|json)$", 1), "-orig$", "")
    return F.struct(stem.alias("stem"), lang.alias("lang"), F.nullif(F.regexp_extract(stem, r"^(\d+)_", 1), F.lit("")).cast("int").alias("seq"), F.nullif(F.regexp_extract(stem, r"_([A-Za-z0-9_-]{11})$", 1), F.lit("")).alias("video_id"))


def source_language(tracks: str | Column) -> Column:
    """The language of the one track whose key ends in `-orig`."""
    return F.regexp_replace(F.get(F.filter(F.map_keys(_col(tracks)), lambda k: F.endswith(k, F.lit("-orig"))), 0), "-orig$", "")


def preview(text: str | Column, size: int = 200) -> Column:
    """The first characters, with dots if there are more."""
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def thousands(n: str | Column) -> Column:
    return F.coalesce(F.format_number(_col(n).cast("long"), 0), F.lit("Unknown"))


def age(day: str | Column, today: str | Column) -> Column:
    """`n days ago`."""
    return F.coalesce(F.concat(F.datediff(_col(today), _col(day)).cast("string"), F.lit(" days ago")), F.lit("Unknown"))


def snippet(lines: str | Column, text: str | Column, catchphrase: str | Column, name: str, suffixes: Sequence[str] = vocab.NAME_SUFFIXES, pattern: str = vocab.ANY_WORD) -> Column:
    """The first line with the name (the whole text if there are no lines), else the catchphrase, else null."""
    own = F.when(F.size(_col(lines)) > 0, _col(lines)).otherwise(F.array(F.coalesce(_col(text), F.lit(""))))
    return F.coalesce(F.get(F.filter(own, lambda x: name_hit(x, name, suffixes, pattern)), 0), F.nullif(_col(catchphrase), F.lit("")))


def near_score(word: str | Column, query: str) -> Column:
    """The fewest edits between the query and any part of the word, by the query's length."""
    return substring_distance(word, query) / F.lit(float(len(query)))


def window_score(word: str | Column, query: str) -> Column:
    """The fewest edits between the query and the word or a window of it, one character shorter than the query to one longer, by the query's length."""
    w, n = _col(word), len(query)
    sizes = F.array(*map(F.lit, range(max(n - 1, 1), n + 2)))
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - k + 1, F.lit(1))), lambda i: F.substring(w, i, k))))
    return F.array_min(F.transform(F.array_append(parts, w), lambda x: F.levenshtein(x, F.lit(query)))) / F.lit(float(n))


def highlight(text: str | Column, query: str, context: int = 50) -> Column:
    """Every match in any case with context, the left bound being the last match's end; bold, with dots where cut, one a line."""
    t = _col(text)
    if not query:
        return t
    find = F.lit(r"(?iu)" + "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in query))
    # Texts between matches have no match, so matches and their places follow from both lists.
    found, between = F.regexp_extract_all(t, find, F.lit(0)), F.split(t, find, -1)
    size = F.length(t)

    def step(s: Column, x: Column) -> Column:
        start = s["end"] + F.length(x["b"])
        stop = start + F.length(x["m"])
        left, right = F.greatest(start - context, s["end"]), F.least(stop + context, size)
        piece = F.replace(F.substring(t, left + 1, right - left), x["m"], F.concat(F.lit("**"), x["m"], F.lit("**")))
        line = F.when((left > 0) | (right < size), F.concat(F.lit("..."), piece, F.lit("..."))).otherwise(piece)
        return F.struct(stop.alias("end"), F.array_append(s["lines"], line).alias("lines"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("lines"))
    return F.aggregate(pairs, none, step, lambda s: F.array_join(s["lines"], "\n"))


def near_window(text: str | Column, query: str) -> Column:
    """The window of the query's length that is nearest to it by edit distance, the first of equals."""
    t, n = _col(text), len(query)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.struct(F.levenshtein(F.lower(F.substring(t, i, F.lit(n))), F.lit(query.lower())).alias("d"), i.alias("at"), F.substring(t, i, F.lit(n)).alias("window")))
    return F.array_min(windows)["window"]
