import json

import pytest

from scriptorium.__main__ import main
from scriptorium.plans.archive import Archive
from scriptorium.sources.readers import METADATA


@pytest.fixture
def files(tmp_path):
    rows = [("https://youtu.be/aaaaaaaaaaa", "Sketch 1", "բարի լույս; ոնց ես", "լույս", "Հայկո Մկո"), ("https://youtu.be/bbbbbbbbbbb", "Sketch 2", "տոռմուզ", "", "Հայկո, վարպետ"), ("https://youtu.be/ccccccccccc", "Sketch 3", "Անին եկավ", "", "")]
    (tmp_path / "c.csv").write_text("links,titles,text,text_common,main_actors,roles_names,location,languages,lighting,main_actors_count\n" + "".join(f'{u},{t},"{x}",{c},"{a}",,Տուն,hy,day,1\n' for u, t, x, c, a in rows))
    blank = dict.fromkeys(METADATA, "")
    meta = [blank | {"video_id": v * 11, "duration_sec": "100.0", "view_count": str(n), "upload_date": "20130101.0"} for v, n in (("a", 5), ("b", 9))] + [blank | {"video_id": "c" * 11, "fetch_error": "gone"}]
    (tmp_path / "m.csv").write_text(",".join(METADATA) + "\n" + "".join(",".join(m.values()) + "\n" for m in meta))
    return tmp_path


def test_archive(spark, files, capsys):
    a = Archive.build(spark, str(files / "c.csv"), str(files / "m.csv")).save(str(files / "archive"))
    assert [r.id[0] for r in a.search("tormuz").collect()] == ["b"] and a.search("", page=1).count() == 3
    assert [r.id[0] for r in a.search("", location=["Տուն"]).collect()] == ["b", "a", "c"]
    assert a.by_id("a" * 11).first().seq == 1
    assert {(r.facet, r.value): r.n for r in a.facet_counts().collect()}["actor", "Հայկո"] == 2
    assert [(r.id[0], r.kind) for r in a.find_by_name("Անի").collect()] == [("c", "mention")]
    assert [r.id[0] for r in a.related("a" * 11).collect()] == ["b", "c"]
    assert [r.actor for r in a.actor_names().collect()] == ["Հայկո", "Մկո"] and a.co_stars("Հայկո").first() == ("Մկո", 1)
    profile = a.actor_profile("Հայկո")
    assert profile["totals"].first() == ("Հայկո", 2, 14, 7) and profile["catchphrases"].first().textCommon == "լույս" and profile["rows"].count() == 2
    phrases = spark.createDataFrame([("բարի լույս",)], "phrase string")
    assert a.phrase_tiles(phrases).first().key == "a" * 11
    a.export(str(files / "rows"), str(files / "stats.json"))
    doc = json.loads((files / "stats.json").read_text())
    assert len(doc) == 15 and doc["totals"][0]["views"] == 14 and doc["composition"]
    main(["search", "tormuz", "--input", str(files / "archive")])
    main(["todo", "--input", str(files / "c.csv"), "--metadata", str(files / "m.csv")])
    out = capsys.readouterr().out
    assert "bbbbbbbbbbb" in out and "ccccccccccc" in out


def test_build_fails_without_a_key(spark, files):
    (files / "bad.csv").write_text((files / "c.csv").read_text() + "nowhere,x,,,,,,,,\n")
    with pytest.raises(Exception, match="has no key"):
        Archive.build(spark, str(files / "bad.csv"), str(files / "m.csv")).rows.collect()
