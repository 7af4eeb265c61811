"""The operators of the subpackage against brute force, exact round trips and held-out accuracy, on small fixtures."""

import random
import string

import pyarrow as pa
import pytest
from conftest import DATA, compare

from gleanworks.llm import bins, leaks, pieces, registry, scans, survivors, textkind, turns

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


# --- scanned pages -----------------------------------------------------------------------------------------------------


def pages(spark, rows, lang="en"):
    return spark.createDataFrame([(i, f, n, c, lang, "extra") for i, (f, n, c) in enumerate(rows, 1)], "page_id bigint, output_file string, page_no int, content string, ocr_lang string, word string")


BODY = "the harbour was quiet and the lantern burned in the window while nobody came"


def book(spark, n=8):
    rows = []
    for k in range(1, n + 1):
        head = "Tale of the Harbour" if k != 5 else "Ta1e of tbe Harbour"
        own = ["anchor", "barrel", "compass", "dolphin", "engine", "feather", "galley", "hatchet"][k % 8]
        text = f"{head}\n\nand so the {own} and {BODY}.\nA {own} and the water in the {own}.\n\nThen the {own} went out over the wa-\nter and the {own} of {BODY}\n\n— {k + 3} —"
        rows.append(("book", k, ("Tale of the Harbour\r\n\r\nIt began in the water. The captain waited.\r\nthe read-only chart\r\n\r\n— 4 —") if k == 1 else text))
    return rows


def test_furniture_splits_and_titles(spark):
    rows = book(spark) + [("one", 1, "Heading\n\nText 42 here.\n17"), ("none", 1, None), ("none", 2, ""), ("none", 3, "\n \n")]
    got = {(r.page_id, r.line_no, r.kind) for r in scans.line_findings(pages(spark, rows)).collect()}
    for page in range(2, 9):
        assert (page, 1, "furniture") in got and (page, 9, "furniture") in got, page
        assert (page, 6, "split") in got  # wa- / ter
    assert (1, 1, "furniture") not in got and (1, 6, "furniture") in got
    assert not any(p == 9 and k == "furniture" and line != 4 for p, line, k in got)


def test_furniture_of_one_part_of_a_long_file(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfgklmnopqsuvwxyz", k=7))
    rows, parts, own = [], 60, 11
    for part in range(parts):
        head = f"{word()} {word()} {word()}".title()
        for k in range(own):
            body = "\n".join(f"{word()} {word()} {word()} {word()}." for _ in range(9))
            rows.append(("long", part * own + k + 1, f"{head}\n\n{body}\n\n{k + 1}"))
    got = {(r.page_id, r.line_no) for r in scans.line_findings(pages(spark, rows)).filter("kind = 'furniture'").collect()}
    want = {(p, line) for p in range(1, len(rows) + 1) for line in (1, 13)}
    assert got <= want and want - got <= {(1, 1)}


def _filler(rng, n):
    word = lambda: "".join(rng.choices("bcdfgklmnopqsuvwxyz", k=7))
    return "\n".join(f"{word()} {word()} {word()} {word()}." for _ in range(n))


def test_furniture_is_decided_by_repetition_and_sequence_alone(spark):
    rng = random.Random(9)
    deep = [("deep", k, "Society of Letters\n\nAnnual Volume\n\nThird Series\n\nPublished Quarterly\n\nNew Haven Press\n\nAll Rights\n\n" + _filler(rng, 9)) for k in range(2, 12)]
    chapters = [("book", 10 + k, f"Chapter of {'abcdefghij'[k // 8] * 5}\n\n{_filler(rng, 9)}") for k in range(80)]
    short = [("parts", 10 + k, f"Part of {'abcdefghij'[k // 3] * 5}\n\n{_filler(rng, 9)}") for k in range(30)]
    footer = [("foot", k, f"{_filler(rng, 9)}\n\nPrinted in Italy.") for k in range(2, 9)]
    alone = [("alone", k, ("Results of the Survey\n\npH was low" if k == 4 else "— 1912 —\n\n" if k == 6 else "") + _filler(rng, 9)) for k in range(2, 9)]
    rows = deep + chapters + short + footer + alone
    got = {(r.page_id, r.line_no) for r in scans.line_findings(pages(spark, rows)).filter("kind = 'furniture'").collect()}
    n = [0]
    for part in (deep, chapters, short, footer):
        n.append(n[-1] + len(part))
    want = {(p, line) for p in range(1, n[1] + 1) for line in (1, 3, 5, 7, 9, 11)} | {(p, 1) for p in range(n[1] + 1, n[3] + 1)} | {(p, 11) for p in range(n[3] + 1, n[4] + 1)}
    assert got == want


def test_pages_without_numbers_and_hot_files(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(scans, "CROWD", 50)
    rows = [("hot", None, f"Tale of the Harbour\n\n{_filler(rng, 5)}") for _ in range(400)]
    got = {(r.page_id, r.line_no) for r in scans.line_findings(pages(spark, rows)).filter("kind = 'furniture'").collect()}
    assert {line for _, line in got} == {1} and len(got) >= 390  # the first page of each part has the title


def test_words_with_digits_do_not_depend_on_the_size_of_the_corpus(spark):
    rng = random.Random(11)
    for times in (1, 40):
        edge = lambda: _filler(rng, 5)
        rows = [("d", k, f"{edge()}\nplayed an mp3 on A4 in 300dpi with 1080p for the 2nd time\nthe zyl0phone was here\n{edge()}") for k in range(2, 2 + times)]
        got = {r.line_no for r in scans.line_findings(pages(spark, rows)).filter("kind = 'misread'").collect()}
        assert got == {7}


def test_misread_words_by_language(spark):
    rows = [("en", k, f"{BODY}\n{BODY}\nlast line {k}.") for k in range(1, 31)] + [("en", 31, "x tbe harbour was qu1et and\nthe lantern burned.")]
    got = {(r.page_id, r.line_no) for r in scans.line_findings(pages(spark, rows)).filter("kind = 'misread'").collect()}
    assert got == {(31, 1)}
    mixed = pages(spark, rows).unionByName(pages(spark, [("de", k, "xx tbe tbe tbe hier tbe tbe") for k in range(40)], "de").selectExpr("page_id + 100 as page_id", "output_file", "page_no", "content", "ocr_lang", "word"))
    assert {(r.page_id, r.line_no) for r in scans.line_findings(mixed).filter("kind = 'misread'").collect()} == {(31, 1)}


def test_empty_table_and_repeated_pages(spark):
    assert scans.line_findings(pages(spark, book(spark)).limit(0)).count() == 0
    once = pages(spark, book(spark))
    key = lambda df: sorted(map(tuple, scans.line_findings(df).filter("kind != 'misread'").collect()))
    assert key(once) == key(once.unionByName(once))


def test_paragraphs_are_whole(spark):
    out = scans.repaired_paragraphs(pages(spark, book(spark))).orderBy("first_page", "no").collect()
    text = "\n".join(r.text for r in out)
    assert "over the water and the anchor of" in text and "— 7 —" not in text and text.count("Tale of the Harbour") == 1
    assert any(r.pages == 2 and "nobody came and so the" in r.text for r in out)


def test_endless_paragraphs_come_in_parts(spark):
    rng = random.Random(14)
    rows = [("endless", k, _filler(rng, 3).replace(".", "").lower()) for k in range(1, 151)]
    out = scans.repaired_paragraphs(pages(spark, rows)).orderBy("part").collect()
    assert [(r.first_page, r.part, r.pages) for r in out] == [(1, 0, 64), (1, 1, 64), (1, 2, 22)]
    assert " ".join(r.text for r in out).split() == [w for _, _, t in rows for w in t.split()]


def test_numbers_and_skeletons():
    assert [scans.number_of(x) for x in ("— 12 —", "- l2 -", "p. 120", "[4]", "xiv", "7 / 19", "Page lO", "the", "3 apples")] == [12, 12, 120, 4, 14, 7, 10, None, None]
    assert scans.skeleton("modern") == scans.skeleton("rnoclern") and scans.skeleton("Fall") == scans.skeleton("tal1") != scans.skeleton("full")
    assert scans.edge_line("Title of it  — 12 —")[1] == 12 and scans.edge_line("T i t l e  o f  i t")[0] == scans.edge_line("Title of it")[0]


# --- pieces ------------------------------------------------------------------------------------------------------------


def test_pieces_are_an_exact_round_trip():
    rng = random.Random(1)
    for _ in range(400):
        words = ["".join(rng.choices("abcé", k=rng.choice([1, 3, 8, 40]))) for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n\n", ", ", "\r\n", "\n# h\n"]) for w in words)
        limit, overlap = pieces.clean_limits(rng.choice([1, 2, 7, 50, 200]), rng.choice([0, 3, 30, None]))
        ends = pieces.cut_points(text, limit, overlap)
        at, out = 0, []
        for i, end in enumerate(ends):
            back = min(overlap, at) if i else 0
            assert end - at + back <= limit and (end > at or len(ends) == 1)
            out.append(text[at:end])
            at = end
        assert "".join(out) == text


def test_cuts_prefer_boundaries_and_odd_rows(spark):
    text = "# A\n\n" + "One sentence here. " * 10 + "\n\n# B\n\n" + "Another one there. " * 10
    ends = pieces.cut_points(text, 220, 0)
    assert text[ends[0] :].startswith("# B")
    rows = [(1, text, 220, 0), (1, text, 220, 0), (2, None, 10, 0), (3, " \n", 10, 0), (4, "abc", None, 5), (5, "x" * 100, 10, 99), (None, "abc", 1, 0), (6, "long " * 50_000, 1000, 50)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "md_id bigint, content string, max_chars int, overlap_chars int, piece string")
    out = pieces.split_texts(df).collect()
    assert {r.md_id for r in out} == {1, 4, 5, 6} and max(len(r.piece) for r in out if r.md_id == 6) <= 1000
    assert pieces.oversized_blocks(df.limit(0)).count() == 0 and {r.md_id for r in pieces.oversized_blocks(df).collect()} == {5, 6}


def test_oversized_blocks_come_from_the_cuts(spark, monkeypatch):
    from gleanworks.functions.markdown import markdown_blocks
    from gleanworks.session import table

    df = table(spark, DATA, "summarize_md")
    got = {(r.md_id, r.block_no) for r in pieces.oversized_blocks(df).collect()}
    rows = {r.md_id: r for r in df.filter("content is not null").collect()}
    assert got == {(k, no) for k, r in rows.items() if r.max_chars for no, (_, a, z) in enumerate(markdown_blocks(r.content), 1) if z - a > r.max_chars}
    assert got < {(r.md_id, r.block_no) for r in pieces.divided_blocks(df).collect()}
    monkeypatch.setattr(pieces, "cut_points", lambda text, *_: [len(text)])
    none = list(pieces._blocks(iter([pa.RecordBatch.from_pylist([{"md_id": 1, "content": "word " * 99, "max_chars": 50, "overlap_chars": 0}])])))
    assert sum(b.num_rows for b in none) == 0


def test_long_texts_are_cut_inside_no_word_but_too_long_ones():
    rng = random.Random(3)
    for _ in range(3):
        text = "".join("".join(rng.choices("abcde", k=rng.randint(2, 9))) + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n"]) for _ in range(35_000))
        strength = pieces.boundaries(text)
        ends = pieces.cut_points(text, 1200, 120, strength)
        assert all(strength[e] > 0 for e in ends[:-1]) and ends[0] <= 1200 and all(0 < b - a <= 1080 for a, b in zip(ends, ends[1:], strict=False))
    text = text[:50_000] + "x" * 5000 + " " + text[50_000:]
    strength = pieces.boundaries(text)
    ends = pieces.cut_points(text, 1200, 120, strength)
    inside = [e for e in ends[:-1] if strength[e] == 0]
    assert 4 <= len(inside) <= 5 and all("x" == text[e - 1] == text[e] for e in inside) and max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= 1080


# --- turns -------------------------------------------------------------------------------------------------------------

ROSTER = [(1, "SPEAKER_01", "Ada Quill"), (2, "SPEAKER_02", "Bo Marten"), (12, "SPEAKER_12", "Cleo Vance")]


@pytest.mark.parametrize(
    ("text", "who", "speech"),
    [
        ("Ada Quill: Hello there.", "SPEAKER_01", "Hello there."), ("[00:01:02] >> marten : yes", "SPEAKER_02", "yes"), ("(Cleo) 1:02 So um, we go.", "SPEAKER_12", "So we go."),
        ("<v Quill, Ada>uh... well, fine", "SPEAKER_01", "fine"), ("**SPEAKER 12**: [laughter], hmm.", "SPEAKER_12", ""), ("- B. Marten – (door closes) You know, it rains.", "SPEAKER_02", "it rains."),
        ("Celo: swapped letters", "SPEAKER_12", "swapped letters"),
        ("Ada, come here.", None, "Ada, come here."), ("Question: who is Bo?", None, "Question: who is Bo?"), ("Nobody Marten: no", None, "Nobody Marten: no"), ("", None, ""), (None, None, ""), ("♪ ♪", None, ""),
        ("mm-hmm, uh-huh", None, ""), ("I like trains", None, "I like trains"), ("spk_01 - 00:00:57,746 --> it starts", "SPEAKER_01", "it starts"), ("Speaker 99: unknown", None, "Speaker 99: unknown"),
        ("I *really* mean it", None, "I *really* mean it"), ("(I think so) yes", None, "(I think so) yes"), ("we met [Bo Marten] there", None, "we met [Bo Marten] there"), ("Ada: *yes*", "SPEAKER_01", "*yes*"),
        ("ummmmmmmmmm we go", None, "we go"), ("well uhhhhhhh, hmmmmmmmmm. soooooooo long", None, "well. soooooooo long"), (f"so [a note of {'very ' * 30} loud music] it ends", None, "so it ends"), (f"so *{'a ' * 40} cough coughs* on", None, "so on"),
    ],
)
def test_reading_a_segment(text, who, speech):
    assert turns.Reader(ROSTER).read(text, "en") == (who, speech)


def test_turns_equal_brute_force_over_many_blocks(spark):
    rng = random.Random(4)
    rows = []
    for media in "ab":
        t = 0.0
        for k in range(400):
            t += rng.choice([1, 2, 30, 900, 3599, 3600, 4000]) + rng.random()
            label = rng.choice(["", "", "", "Ada: ", "Bo Marten: "])
            rows.append((media, len(rows), t, t + rng.choice([1, 50, 5000]), label + rng.choice(["it rains today", "hmm", "we go"]), "en"))
    rows += rows[:50] + [("a", 9999, None, 3.0, "Ada: x", "en"), ("a", 9998, 5.0, 5.0, "Ada: x", "en"), (None, 1, 0.0, 1.0, "x", "en")]
    schema = "media_id string, seg_id bigint, start_s double, end_s double, text string, lang string"
    roster = spark.createDataFrame(ROSTER, "speaker_no int, diar_label string, full_name string")
    got = turns.turn_bounds(turns.speaker_turns(spark.createDataFrame(rows, schema), roster, block_ms=60_000))
    want, reader = set(), turns.Reader(ROSTER)
    for media in "ab":
        who, reach, current = "unknown", None, None
        for s, e, no, text in sorted({(round(r[2] * 1000), round(r[3] * 1000), r[1], r[4]) for r in rows if r[0] == media and r[2] is not None and r[3] > r[2]}):
            if reach is not None and s - reach >= 3_600_000:
                who, current = "unknown", None
            reach = e if reach is None else max(reach, e)
            label, speech = reader.read(text, "en")
            if not speech:
                continue
            who = label or who
            if current and current[1] == who:
                want.discard(tuple(current))
                current[3] = no
            else:
                current = [media, who, no, no]
            want.add(tuple(current))
    assert {(r.media_id, r.speaker, r.first_seg_id, r.last_seg_id) for r in got.collect()} == want
    assert turns.speaker_turns(spark.createDataFrame([], schema), roster).count() == 0


def test_long_turns_come_in_parts(spark):
    rows = [("a", k, k * 600.0, k * 600.0 + 500, f"Ada: part {k}" if k == 0 else f"part {k}", "en") for k in range(20)] + [("a", 30, 0.0, 500.0, "", "en"), ("a", 0, 0.0, 500.0, "Ada: a part", "en")]
    df = spark.createDataFrame(rows, "media_id string, seg_id bigint, start_s double, end_s double, text string, lang string")
    out = turns.turn_texts(turns.speaker_turns(df, spark.createDataFrame(ROSTER, "speaker_no int, diar_label string, full_name string"))).orderBy("part").collect()
    assert [r.part for r in out] == [0, 1, 2, 3] and [r.segments for r in out] == [6, 6, 6, 2] and " ".join(r.text for r in out) == " ".join(f"part {k}" for k in range(20))


# --- survivors ---------------------------------------------------------------------------------------------------------


def test_survivors_ties_nulls_and_a_hot_group(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("g", 1, "exact", None, ["a/b", "./a//b", None, " "], "Reviewed ", ["a/b"], "old", day(5)), ("g", 2, None, 5, ["a\\b", "c"], "pending", None, None, None), ("g", 3, "n/a", 7, None, "kept-all", None, "new", day(2)),
        ("g", 3, "n/a", 7, None, "kept-all", None, "new", day(1)), ("g", 4, "dhash", None, [], "SKIPPED", None, "new", day(2)), ("alone", 9, None, None, ["x"], "reviewed", None, "new", day(1)), (None, 10, None, None, ["x"], "reviewed", None, "new", day(1)),
        ("none", 11, None, None, None, "-", None, None, None), ("none", 12, None, None, [], None, None, None, None),
    ] + [("hot", 100 + i, None, None, [f"p{i % 3}"], "skipped", None, "old", day(1 + i % 28)) for i in range(3000)]
    records = spark.createDataFrame(rows, "group_id string, review_id bigint, method string, threshold int, paths array<string>, decision string, kept array<string>, origin string, saved_at timestamp_ntz")
    origins = spark.createDataFrame([("new", 1), ("old", 2)], "origin string, trust_rank int")
    clean = survivors.clean_records(records, origins)
    got = {(r.group_id, r.field): r.review_id for r in survivors.field_survivors(clean).collect()}
    assert got == {("g", "decision"): 3, ("g", "paths"): 2, ("hot", "decision"): 127, ("hot", "paths"): 127}
    whole = {r.group_id: r for r in survivors.surviving_records(clean).collect()}
    assert whole["g"].decision == "kept_all" and whole["g"].method == "dhash" and whole["g"].threshold == 7 and whole["g"].kept == ["a/b"]
    assert whole["none"].decision is None and whole["alone"].paths == ["x"]


def test_paths_in_built_in_expressions_as_in_python(spark):
    rng = random.Random(15)
    odd = ["/", ".", "./", "/.", "//", "a/.", "/a", "./../a", "-", "N/A", " ", "", "a\\b\\.\\c ", "a/./b//c/", None, ".hidden/x", "a.b/c.", "././/./x", "..", "a/..", "\ta"]
    paths = [[rng.choice(odd) if rng.random() < 0.3 else "".join(rng.choices("ab./\\ ", k=rng.randint(1, 9))) for _ in range(4)] for _ in range(500)] + [odd, [], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<string>")
    got = {r.i: r.f for r in df.select("i", survivors.distinct_files("p").alias("f")).collect()}
    for i, p in enumerate(paths):
        assert got[i] == (None if p is None else list(dict.fromkeys(x for x in map(survivors.one_spelling, p) if x))), p


def test_a_missing_date_is_older_than_the_epoch(spark):
    import datetime as dt

    rows = [("g", 1, ["a"], "reviewed", "x", None), ("g", 2, ["b"], "skipped", "x", dt.datetime(1970, 1, 1)), ("h", 3, ["a"], "reviewed", "x", dt.datetime(1969, 1, 1)), ("h", 4, ["b"], "skipped", "x", None), ("t", 6, ["a"], "skipped", "x", None), ("t", 5, ["a"], "skipped", "x", None)]
    records = spark.createDataFrame([(g, i, None, None, p, d, None, o, s) for g, i, p, d, o, s in rows], "group_id string, review_id bigint, method string, threshold int, paths array<string>, decision string, kept array<string>, origin string, saved_at timestamp_ntz")
    clean = survivors.clean_records(records, spark.createDataFrame([("x", 1)], "origin string, trust_rank int"))
    assert {(r.group_id, r.field): r.review_id for r in survivors.field_survivors(clean).collect()} == {("g", "decision"): 2, ("g", "paths"): 2, ("h", "decision"): 3, ("h", "paths"): 3, ("t", "decision"): 5, ("t", "paths"): 5}
    assert survivors.surviving_records(clean).count() == 3


# --- bins --------------------------------------------------------------------------------------------------------------


def test_contexts_hold_everything_once_and_never_too_much(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 7, 100, 100, 100, 333, 999, 1000, 1001, 5230, rng.randint(1, 1500)])) for i in range(3000)]
    out = bins.fill_contexts(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), 1000, chunks=5).collect()
    total, per = {}, {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.part_tokens
        if r.context_id is not None:
            per[r.context_id] = per.get(r.context_id, 0) + r.part_tokens
    assert total == dict(sizes) and max(per.values()) <= 1000 and all((r.context_id is None) == (r.part_tokens == 0) for r in out)
    assert sorted(per) == list(range(len(per)))
    assert len(per) <= 1.02 * -(-sum(per.values()) // 1000) + 1
    split = {i for i, n in sizes if n > 1000}
    assert {r.doc_id for r in out if r.part > 0} == split
    assert bins.fill_contexts(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 10).count() == 0


def test_token_counts_of_odd_texts(spark):
    rows = [(1, "hello world"), (1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|> é" * 2000)]
    got = {r.doc_id: r.tokens for r in bins.token_sizes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    enc = bins.encoding()
    assert got == {1: len(enc.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary(rows[-1][1]))}


# --- leaks -------------------------------------------------------------------------------------------------------------


def sentences(rng, n):
    stock = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(300)]
    return [" ".join(rng.choices(stock, k=9)).capitalize() + "." for _ in range(n)]


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(7)
    shared = sentences(rng, 6)
    items = [(i, " ".join(rng.choices(shared, k=2) + sentences(rng, 5)), "yes") for i in range(300)]
    index = leaks.ItemIndex(items, block=8)
    for _ in range(150):
        picks = rng.sample(range(300), 3)
        terms = sorted({t for p in picks for t in rng.sample(list(index.hits(index.keys[p])[1].tolist()), 12)})
        score: dict[int, float] = {}
        for t in terms:
            for no, impact in zip(*index.posting(t)):
                score[no] = score.get(no, 0) + impact
        for threshold in (0.02, 0.1, 0.3):
            assert set(index.retrieve(terms, threshold)) ^ {n for n, s in score.items() if s >= threshold} <= {n for n, s in score.items() if abs(s - threshold) < 1e-9}


def test_leaks_in_every_writing_and_no_others(spark):
    rng = random.Random(8)
    own = [sentences(rng, 8) for _ in range(20)]
    items = [(i, "Read the passage and answer the question below. " + " ".join(s), "blue") for i, s in enumerate(own)]
    fill = lambda n: " ".join(sentences(rng, n))
    docs = [
        (1, fill(5) + " ".join(own[0]).upper() + fill(5)), (2, fill(3) + "\n".join(w.replace("e", "é") for w in " ".join(own[1]).split()) + fill(3)),
        (3, " ".join(own[2][:3]) + " " + fill(1) + " " + " ".join(own[2][3:6])), (4, " ".join(own[3][:2]) + fill(20)), (5, "Read the passage and answer the question below. " + fill(10)),
        (6, " ".join(sorted(" ".join(own[4]).split()))), (7, None), (8, ""), (9, fill(400) + " " + " ".join(own[5])), (9, fill(400) + " " + " ".join(own[5])), (None, " ".join(own[6])),
        (10, " ".join(w if k % 12 else "changed" for k, w in enumerate(" ".join(own[7]).split()))), (11, "-\n".join(x[:40] for x in [own[8][0]]) + fill(1)),
    ]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items + [(None, "x", "y"), (99, None, None), (98, "", "")], "item_id bigint, text string, answer string")
    want = {(1, 0), (2, 1), (3, 2), (9, 5), (10, 7)}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it, items_at_once=4).collect()} == want
    assert leaks.leaked_items(df.limit(0), it).count() == 0


def test_leaks_of_long_short_and_scattered_items(spark):
    rng = random.Random(12)
    long = " ".join(sentences(rng, 300))
    item = " ".join(sentences(rng, 8))
    words = item.split()
    fill = lambda n: " ".join(sentences(rng, n))
    scraps = " ".join(" ".join(words[k : k + 9]) + " " + fill(3) for k in list(range(0, 60, 3)) * 3)
    items = [(1, long, ""), (2, "Quagmire zeppelin", "x"), (3, item, "x"), (4, "Obelisk", None)]
    docs = [(1, fill(5) + " " + long[: len(long) * 3 // 5] + " " + fill(5)), (2, fill(2) + " quagmire ZEPPELIN " + fill(2)), (3, scraps + " " + " ".join(words[:22]) + " " + fill(1) + " " + " ".join(words[22:44])), (4, "quagmire. A zeppelin, an obelisk"), (5, fill(9))]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, answer string")
    for at_once in (100, 2):
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it, items_at_once=at_once).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_planted_shares_of_items(spark):
    """What share of an item must stand in a document: from a half on all are found, below three eighths none."""
    rng = random.Random(13)
    own = [" ".join(sentences(rng, 9)).split() for _ in range(60)]
    items = [(i, " ".join(w), "") for i, w in enumerate(own)]
    docs, planted = [], {}
    for i, w in enumerate(own):
        part = [0.2, 0.3, 0.36, 0.5, 0.6, 0.8][i % 6]
        n = round(part * len(w))
        at = rng.randint(0, len(w) - n)
        docs.append((i, " ".join(sentences(rng, 6)) + " " + " ".join(w[at : at + n]) + " " + " ".join(sentences(rng, 6))))
        planted[i] = part
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, answer string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, part in planted.items() if part >= 0.5}


# --- kinds of texts ----------------------------------------------------------------------------------------------------

COMMON = {"en": ["the", "of", "and", "in", "was", "he", "it", "with", "near", "while"], "es": ["el", "la", "de", "y", "en", "con"]}


def test_held_out_accuracy(spark):
    case = textkind.learned_case(spark, COMMON)
    fresh = textkind.labelled_texts(spark, COMMON, 800, seed=99)
    words = [w for ws in COMMON.values() for w in ws]
    from pyspark.sql import functions as F

    got = textkind.text_statistics(fresh, words).withColumn("got", F.expr(case)).join(fresh, "doc_id").select("kind", "got").collect()
    right = sum(r.kind == r.got for r in got) / len(got)
    assert right > 0.85, right
    prose = [r for r in got if r.kind == "prose"]
    assert sum(r.got == "prose" for r in prose) / len(prose) > 0.95


def test_statistics_and_kinds_of_odd_texts(spark):
    prose = "The old man walked in the rain and it was cold. He sat near the fire with the dog while it slept. "
    rows = [(1, prose), (2, None), (3, ""), (4, " \n\t"), (5, "\n".join(f"- item number {i}" for i in range(40))), (6, "\n".join(f"a{i},{i},{i * 2}.5" for i in range(60))), (7, "@#$%^&*()_+{}|:<>?" * 30), (8, "x" * 300_000), (9, prose * 4000), (None, prose), (10, ("a|" * 50_000)), (1, prose)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, kind string")
    common = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    got = textkind.text_kinds(df, common).collect()
    kinds = {r.doc_id: r.kind for r in got}
    assert len(got) == 11 and kinds[1] == kinds[2] == kinds[3] == kinds[4] == "prose" and kinds[5] == "list" and kinds[6] == "table" and kinds[7] == "junk"
    one = next(r for r in got if r.doc_id == 1)
    assert one.words == 22 and one.line_end_share == 1 and 0.5 < one.common_share < 0.7 and next(r for r in got if r.doc_id == 2).words == 0
    assert textkind.text_kinds(df.limit(0), common).count() == 0


def test_rules_hold_on_texts_from_another_source(spark):
    """Blocks of Markdown tables, whose kind the Markdown grammar tells, and hand-written texts: none is made by the maker."""
    from gleanworks.operators.packing import markdown_block_rows
    from gleanworks.session import table

    blocks = markdown_block_rows(table(spark, DATA, "summarize_md").select("md_id", "content").distinct(), "md_id", "content").filter("kind in ('table', 'list', 'paragraph') and length(text) >= 60").dropDuplicates(["text"]).collect()
    own = {"table": "table", "list": "list", "paragraph": "prose"}
    rows = [(i, b.text, own[b.kind]) for i, b in enumerate(blocks)]
    hand = [
        ("prose", "We met the keeper of the old mill on a wet morning, and she told us that the wheel had not turned for years. It was cold inside. The stones lay in the dark, and nobody had moved them since the war."),
        ("prose", "## You\n\nCan you tell me why the build fails?\n\n## Assistant\n\nIt fails because the path in the file is wrong. Change it to the folder that holds the sources, and then run it again."),
        ("prose", "The recipe is simple, and it works with any of the following:\n- butter\n- oil\n\nMelt it in a pan with the onions and let it cook for ten minutes. Then add the stock and the rice, and wait until the rice is soft and the stock is gone."),
        ("list", "Shopping\n- two loaves of bread\n- a pound of butter\n- eggs\n- apples (green)\n- cheese for the pasta\n- soap"),
        ("list", "Contents\nIntroduction ........ 1\nThe first journey ........ 12\nA winter in the north ........ 33\nThe return ........ 71\nIndex ........ 90"),
        ("list", "1) open the cover\n2) take out the paper\n3) turn the green wheel\n4) close the cover\n5) press the button"),
        ("table", "name;age;town\nAnna;31;Graz\nPaul;28;Linz\nMarie;44;Wien\nJan;39;Bregenz\nEva;25;Villach"),
        ("table", "Year & Rain & Sun \\\\\n1990 & 120 & 88 \\\\\n1991 & 98 & 102 \\\\\n1992 & 131 & 79 \\\\\n1993 & 99 & 97 \\\\"),
        ("table", "<table><tr><td>north</td><td>12</td></tr>\n<tr><td>south</td><td>19</td></tr>\n<tr><td>east</td><td>7</td></tr></table>"),
        ("junk", "xq}{{~ %%8 ;;;### @@1 ||| ^^^ &&& *** ((( ]]] [[[ <<>> ??? !!! ~~~ === +++ ---- ____ \\\\ ///"),
        ("junk", "click here to win click here to win click here to win click here to win click here to win click here to win click here to win click here to win"),
        ("junk", "T h e  o l d  m a n  w a l k e d  i n  t h e  r a i n  a n d  i t  w a s  c o l d  a n d  h e  s a t  n e a r  t h e  f i r e"),
    ]
    rows += [(10_000 + i, t, k) for i, (k, t) in enumerate(hand)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    words = table(spark, DATA, "common_words")
    corpus = table(spark, DATA, "documents")
    by_lang = textkind.common_by_language(words)
    listed = [w for ws in by_lang.values() for w in ws]
    from pyspark.sql import functions as F

    case = textkind.learned_case(spark, by_lang, bank=textkind.sentence_bank(corpus, listed))
    got = textkind.text_statistics(docs, listed).withColumn("got", F.expr(case)).join(docs, "doc_id").select("doc_id", "kind", "got").collect()
    by_hand = [(r.kind, r.got) for r in got if r.doc_id >= 10_000]
    assert sum(a == b for a, b in by_hand) >= len(by_hand) - 1, by_hand
    for kind in ("table", "list", "prose"):
        some = [r for r in got if r.kind == kind and r.doc_id < 10_000]
        assert len(some) >= 20 and sum(r.got == kind for r in some) >= 0.9 * len(some), (kind, len(some), [r.got for r in some if r.got != kind])


def test_shapes_and_measures(spark):
    lines = ["- one entry", "a|b|c|d", "word x1y2 w!rd end.", "plain words with an end.", "....... 12", "<b>tag</b>"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in textkind.text_statistics(df, COMMON["en"]).collect()}
    assert [r for r in got if got[r].marked == 1] == [0] and got[1].cells_of_3_words == 1 and got[1].cells_from_4 == 1
    assert got[2].odd_from_30 == 1 and got[3].odd_from_10 == 0 and got[3].open_ends == 0 and got[4].leaders == 1 and got[5].tagged == 1
