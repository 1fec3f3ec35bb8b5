import gzip
import random

import pytest
import regex
from brute import documents, leaks, loaded
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.llm import decontaminate, license_scan, warc
from sparrowdex.llm._work import Workspace

# Wu-Manber


@given(st.lists(st.text("ab ", min_size=1, max_size=7), min_size=1, max_size=12, unique=True), st.text("ab ", max_size=80), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_every_occurrence_is_found(patterns, text, block):
    names = [p.encode() for p in patterns]
    machine = decontaminate.WuManber(names, block)
    got = sorted((end - machine.m, k) for end, k in machine.search(text.encode()))
    assert got == sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))


def test_leaks_match_brute_force(spark):
    docs, bench = loaded(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["n_patterns"] for r in decontaminate.matches(docs, bench).collect()}
    want = leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert want and got == want
    many = decontaminate.matches(docs, bench, max_bytes=36_000)  # several passes
    assert decontaminate.Patterns(bench, 13, 36_000).sets > decontaminate.CHAIN  # and rows written between them
    assert {(r["doc_id"], r["item_id"]): r["n_patterns"] for r in many.collect()} == want
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, max_bytes=36_000).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_leaks_odd_rows(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, " .! "), (4, passage), (4, passage), (None, "x " + passage.upper().replace(" ", ", ")), (5, "a " * 400_000 + "Short item!"), (6, passage[4:]), (7, " ".join(passage.split()[:12])), (8, "shortitem short items"), (9, passage[:90]), (9, passage[-90:]), (9, passage[-90:])]
    items = [(1, passage), (1, passage), (1, "an extra short one"), (None, "short item"), (2, None), (3, ""), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, clashing=True)
    got = sorted(map(tuple, decontaminate.matches(docs, bench).collect()), key=str)
    assert got == sorted([(4, 1, 8), (None, 1, 8), (5, None, 1), (6, 1, 7), (9, 1, 3)], key=str)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7, 8]
    none = bench.filter("false")
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.decontaminate(docs, none).count() == len(rows)
    assert decontaminate.matches(documents(spark, []), bench).count() == 0 == decontaminate.decontaminate(documents(spark, []), bench).count()


# Licence templates


def scan(text, **templates):
    return license_scan.Scanner(templates or None).scan(text)


def test_regions():
    t = 'keep <<beginOptional>>maybe <<beginOptional>>twice <<endOptional>><<endOptional>>this <<var;name="y";original="1";match="[0-9]{4}">> end'
    for text in ("keep this 2020 end", "Keep, MAYBE this 1999 end.", "keep maybe twice this 0000 end"):
        assert [m[0] for m in scan(text, t=t)] == ["t"], text
    for text in ("keep this end", "keep twice this 2020 end", "keep this 20200 end", "keep maybe maybe this 2020 end", "keep this 2020 1 end", "keeps this 2020 end", "this 2020 end"):
        assert scan(text, t=t) == [], text
    assert scan("x keep this 2020 end keep maybe this 1111 end", t=t) == [("t", 1, 4), ("t", 5, 5)]


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_shipped_templates(name):
    template = license_scan.TEMPLATES[name]
    full = license_scan._MARK.sub(lambda m: (license_scan.re.search(r'original="([^"]*)"', m[2]) or [0, ""])[1] if m[1] == "var" else "", template)
    bare = template
    while "<<beginOptional>>" in bare:  # innermost optional regions first
        bare = license_scan.re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", "", bare, flags=license_scan.re.S)
    bare = license_scan._MARK.sub(lambda m: license_scan.re.search(r'original="([^"]*)"', m[2])[1], bare)
    for text in (full, bare, "Before. " + full.upper().replace(" ", "\n") + " After."):
        assert [m[0] for m in scan(text)] == [name], text
    words = license_scan.tokens(bare)
    anchor = license_scan.Automaton(template).anchor
    at = next(k for k in range(len(words)) if words[k : k + len(anchor)] == anchor)
    for k in (at, at + len(anchor) - 1):  # mandatory wording has to match exactly
        changed = words[:k] + ["something"] + words[k + 1 :]
        assert name not in [m[0] for m in scan(" ".join(changed))]


def as_expression(template):
    """One regular expression over tokens, each with a space after it; (?p) takes the longest match."""
    out, pos = "", 0
    for mark in [*license_scan._MARK.finditer(template), None]:
        out += "".join(regex.escape(t) + " " for t in license_scan.tokens(template[pos : mark.start() if mark else len(template)]))
        if mark:
            pos = mark.end()
            if mark[1] == "var":
                own = regex.search(r';match="([^"]*)"', mark[2])[1]
                out += f"(?:(?:{own}) {'|' if regex.fullmatch(own, '') else ''})"
            else:
                out += "(?:" if mark[1] == "beginOptional" else ")?"
    return regex.compile(f"(?p)(?<![^ ]){out}", regex.S)


def slow_scan(text, templates):
    """Matches of the expressions, without the automata, their anchors or token offsets."""
    words = " ".join(license_scan.tokens(text)) + " "
    found = [(name, words[: m.start()].count(" "), m[0].count(" ")) for name, t in templates.items() for m in as_expression(t).finditer(words)]
    return sorted(m for m in found if m[2] and not any(o[2] > m[2] and o[1] <= m[1] and m[1] + m[2] <= o[1] + o[2] for o in found))


NOTICES = [
    "Permission is hereby granted", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "licensed under the GNU General Public License, version 2 or any later version", "This page is licensed under a CC BY-NC-SA 4.0 International License", "released under CC0 1.0", "Licensed under the MIT License, see the LICENSE file for details", "Licensed under the Apache License, Version 2.0 (the",
    "Distributed under the Boost Software License, Version 1.0. (See", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy",
]


def test_matches_are_those_of_plain_expressions():
    rng, scanner = random.Random(6), license_scan.Scanner()
    whole = [license_scan._MARK.sub(lambda m: (regex.search(r'original="([^"]*)"', m[2]) or [0, ""])[1], t) for t in license_scan.TEMPLATES.values()]
    seen = set()
    for _ in range(150):
        parts = [rng.choice(NOTICES + whole + ["some other words", "the", "this work is"]) for _ in range(4)]
        words = " ".join(parts).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices(["the", "license", "extra", "3"], k=rng.randrange(2))
        text = " ".join(words)
        got = sorted(scanner.scan(text))
        assert got == slow_scan(text, license_scan.TEMPLATES), text
        seen |= {m[0] for m in got}
    assert seen == set(license_scan.TEMPLATES)


def test_regions_are_bounded_by_their_expression_only():
    mit = license_scan.TEMPLATES["MIT"]
    full = license_scan._MARK.sub(lambda m: (regex.search(r'original="([^"]*)"', m[2]) or [0, ""])[1], mit)
    for n, found in ((1, True), (41, True), (100, True), (130, False)):  # ".{0,500}": 500 characters
        assert [m[0] for m in scan(full.replace("the author", " ".join(["abc"] * n)))] == (["MIT"] if found else []), n
    t = 'start <<var;name="x";original="1";match=".*">> stop <<var;name="y";original="1";match="(?:a )*b">> end'
    text = "start " + "w " * 30_000 + "stop " + "a " * 500 + "b end"
    assert scan(text, t=t) == [("t", 0, 30_504)]


def test_scan_matches_brute_force(spark):
    docs = loaded(spark, "/root/testdata/sf0.01")
    got = sorted(map(tuple, license_scan.scan_licenses(docs).collect()))
    rows = [(r["doc_id"], r["text"]) for r in docs.filter(F.lower("text").rlike("licen|redistribution|permission")).collect()]
    assert got and got == sorted((i, *m) for i, t in rows for m in slow_scan(t, license_scan.TEMPLATES))


def test_scan_odd_rows(spark):
    notice = "Released under the MIT License"
    rows = [(1, None), (2, ""), (3, "  ..  "), (4, notice), (4, notice), (None, notice), (5, "word " * 100_000 + notice + "."), (6, f"{notice}. {notice}"), (None, f"another {notice}"), (6, f"again {notice}")]
    got = sorted(map(tuple, license_scan.scan_licenses(documents(spark, rows, clashing=True)).collect()), key=str)
    assert got == sorted([(4, "MIT-notice", 0, 5), (None, "MIT-notice", 0, 5), (5, "MIT-notice", 100_000, 5), (6, "MIT-notice", 0, 5), (6, "MIT-notice", 5, 5), (None, "MIT-notice", 1, 5), (6, "MIT-notice", 1, 5)], key=str)
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
    for bad in ("a <<endOptional>>", "<<beginOptional>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton(bad)


# WARC

PAGES = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(4)
    noise = "".join(chr(rng.choice([0x1F, 0x8B, 8, 65, 0x20AC])) for _ in range(3000))
    return [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, None, ""), (3, "u", None), (None, "http://a/4", noise), (5, "http://a/5", "x" * 3_000_000), (6, "u\nv", "plain"), (6, "u v", "plain"), (6, "u v", "plain"), (7, " u%2B+\t", "blanks"), (8, "", "x"), *[(30 + k, "data:" + rng.randbytes(50_000).hex(), f"long {k}") for k in range(4)], *[(10 + k, f"http://b/{k}", rng.randbytes(rng.randrange(2000)).hex()) for k in range(60)]]


@pytest.mark.parametrize("split", [5000, 60_000, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame(page_rows(), PAGES).withColumn("offset", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, warc.round_trip(pages, split).collect()), key=str)
    assert got == sorted(page_rows(), key=str)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_damage_whole_files_and_chance_magic(spark, tmp_path):
    good = [warc.record({"WARC-Type": "resource", "X-Page-Id": str(k)}, bytes([31, 139, 8]) * k + random.Random(k).randbytes(3000)) for k in range(30)]
    torn = bytearray(good[7])
    torn[len(torn) // 2] ^= 0xFF
    stored = gzip.compress(warc.MAGIC * 50, 0)  # a member that isn't a record, full of magic bytes
    (tmp_path / "a.warc.gz").write_bytes(b"".join(good[:7]) + bytes(torn) + stored + b"junk" + warc.MAGIC + b"".join(good[8:]) + good[0][:-20])
    plain = b"".join(gzip.decompress(x) for x in good[:5])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    for split in (997, 10_000, 1 << 20):
        rows = warc.read_warc(spark, f"file://{tmp_path}", split).collect()
        name = lambda r: r["path"].rsplit("/", 1)[1]
        assert sorted(int(r["headers"]["x-page-id"]) for r in rows if name(r).startswith("a")) == [k for k in range(30) if k != 7]
        assert sorted(int(r["headers"]["x-page-id"]) for r in rows if name(r).startswith("b")) == list(range(5))
        assert all(r["content"] == bytes([31, 139, 8]) * int(r["headers"]["x-page-id"]) + random.Random(int(r["headers"]["x-page-id"])).randbytes(3000) for r in rows)


def test_warc_plain_files_and_odd_headers(spark, tmp_path):
    long = "x" * 100_000
    odd = [b"WARC/1.0\r\nWARC-Type: a\r\nX-Fold: one\r\n  two\r\n\tthree\r\nX-Twice: 1\r\nx-twice: 2\r\nContent-Length: 3\r\nContent-Length: 9\r\n\r\nabc", f"WARC/1.1\r\nWARC-Target-URI: {long}\r\nContent-Length: 24\r\n\r\n".encode() + b"quoted\r\n\r\nWARC/1.1\r\nx: y"]
    broken = b"WARC/1.1\r\nno colon\r\n\r\nlost\r\n"
    plain = broken + b"\r\n\r\n".join([*odd, *odd]) + b"\r\n\r\nWARC/1.1\r\nContent-Length: 50\r\n\r\ncut"
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x + b"\r\n\r\n") for x in [broken, *odd, broken, *odd]))
    (tmp_path / "c.warc").write_bytes(gzip.compress(odd[0]))
    (tmp_path / "d.warc").write_bytes(b"nothing of the kind")
    for split in (500, 40_000, 1 << 20):
        rows = warc.read_warc(spark, f"file://{tmp_path}", split).collect()
        for name, n in (("a.warc", 2), ("b.warc.gz", 2), ("c.warc", 1), ("d.warc", 0)):
            own = [r for r in rows if r["path"].endswith("/" + name)]
            assert [bytes(r["content"]) for r in own if r["warc_type"] == "a"] == [b"abc"] * n
            assert all(r["headers"]["x-fold"] == "one two three" and r["headers"]["x-twice"] == "1, 2" for r in own if r["warc_type"] == "a")
            assert [(r["target_uri"], len(r["content"])) for r in own if r["warc_type"] is None] == [(long, 24)] * (n if n == 2 else 0)


def test_workspace_needs_no_local_folder(spark):
    assert Workspace(spark, "x").path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
