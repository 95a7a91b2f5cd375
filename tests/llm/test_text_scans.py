"""Decontamination, language, licences, URL lists, personal data and shards on small and odd inputs."""

import datetime as dt
import math
import random
import re
import zlib

import duckdb

from orebook.llm import decontaminate, language, licences, pii, shards, url_lists
from orebook.llm.queries import QUERIES, TWINS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_windows(text, items):
    w, hit, found = words(text), set(), set()
    for key, t in items:
        x = words(t)
        n = min(10, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == x[s:s + n]:
                    hit.update(range(at, at + n))
                    if key is not None:
                        found.add(str(key))
    return len(w), sorted(hit), sorted(found)


def test_windows_equal_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["a", "b", "c", "dé", "e9", "F"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([12, 15, 30]))) for i in range(8)] + [(20, "b, C dé"), (21, "zz"), (22, "..."), (None, "e9 e9 e9 e9"), (23, None)]
    items += [(24, items[0][1])]
    docs = [(i, text(draw.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(5)}; {t}! {text(4)} {t}") for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (202, "ZZ-b C DÉ " * 2000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_windows(t, items) for i, t in docs}
    for block_bytes in (10**6, 60):  # one pass and many
        got = decontaminate.find_windows(df, bench, block_bytes=block_bytes).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.hit_words, r.item_ids) == want[r.doc_id]
    assert decontaminate.report(decontaminate.find_windows(df.limit(0), bench)).count() == 0
    clean = decontaminate.report(decontaminate.find_windows(df, bench.limit(0)))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(docs)


def test_languages(spark):
    draw = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "eit"], "cc": ["que", "ção", "éra", "oux"]}
    text = lambda lang, n: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    learn = [(i, text(lang, 60), lang) for lang in syllables for i in range(30)] + [(1, None, "aa"), (2, "12 !!", "bb"), (3, text("aa", 9), None)]
    learn += [(4, learn[0][1], "aa")] * 200  # copies do not crowd out the rest
    rows = [(i, text(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in syllables for n in (3, 40, 4000))]
    odd = [(90, None, None), (91, "", None), (92, "123 ... 4", None), (93, "Ж" * 50, None)]
    fields = "doc_id long, text string, lang string"
    df, labelled = spark.createDataFrame(rows + odd, fields), spark.createDataFrame(learn, fields)
    got = {r.doc_id: r for r in language.identify(df, labelled).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3
    assert got[93].lang_pred in syllables  # letters, though of none
    nothing = language.identify(df, labelled.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows) + 4


def test_phrases_are_longest_matches():
    draw = random.Random(3)
    letters = "abcdeé漢字한ж"
    for _ in range(60):
        samples = {k: ["".join(draw.choice(letters[:-1] + " ") for _ in range(draw.randint(1, 40))) for _ in range(3)] for k in "xy"}
        model, codes = language.Model(samples), [ord(c) for c in ("".join(draw.choice(letters + " 1") for _ in range(40)))]
        text = "".join(map(chr, language.letters("".join(map(chr, codes)))))
        for number, lang in enumerate(model.langs):
            known = "".join("".join(map(chr, language.letters(t))) + " " for t in samples[lang] if len(language.letters(t)))
            held, ends = "", 0
            for c in text:
                if held + c in known:
                    held += c
                else:
                    held, ends = c if c in known else "", ends + 1
            assert model.phrases(model.code[language.letters(text)][:, None])[number, 0] == ends


def test_scripts_of_many_letters(spark):
    draw = random.Random(12)
    starts = {"zh": (0x4E00, 900), "ja": (0x3041, 80), "ko": (0xAC00, 1100), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x621, 26), "hi": (0x905, 50), "en": (97, 26)}
    stems = {k: ["".join(chr(a + draw.randrange(n)) for _ in range(3)) for _ in range(80)] for k, (a, n) in starts.items()}
    text = lambda k, n: " ".join(draw.choice(stems[k]) for _ in range(n))
    fields = "doc_id long, text string, lang string"
    labelled = spark.createDataFrame([(i, text(k, 60), k) for k in starts for i in range(12)] + [(1, text("zh", 9) * 9000, "en")], fields)
    rows = [(i, text(k, 30), k) for i, k in enumerate(k for k in starts for _ in range(30))] + [(900, "\u0301\u0302 12", "und"), (901, "é\u0301", None)]
    got = language.identify(spark.createDataFrame(rows, fields), labelled).collect()
    assert sum(r.lang == r.lang_pred for r in got if r.lang) >= 0.98 * len(got)
    assert [r.lang_pred for r in got if r.doc_id == 900] == ["und"]


def test_licences(spark):
    mit = dict((k, t) for k, kind, t in licences.KNOWN if kind == "text")["MIT"]
    rows = [
        (1, "Copyright (c) 2001 Some Body\n\n" + mit), (2, mit.upper().replace(" ", "\n", 40)), (3, "Prose.\nReleased under the M.I.T. Licence!\nMore."),
        (4, "prose\n  released under THE mit license  \nmore\n# SPDX-License-Identifier: Apache-2.0"), (5, None), (6, ""), (7, "the MIT License"),
        (8, "x " * 50_000), (9, "intro\n\n" + mit.split("\n\n")[0] + "\n\nmore"), (4, "Licenced under CC BY 4.0"),
    ]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, whole string")
    got = {(r.doc_id, r.text): (r.licences, r.n_matches, r.whole_text) for r in licences.scan(df).collect()}
    assert len(got) == len(rows)
    assert got[1, rows[0][1]] == ("MIT", 0, True) and got[2, rows[1][1]][0::2] == ("MIT", True)
    assert got[3, rows[2][1]] == ("", 0, False)  # m.i.t. is three words
    assert got[4, rows[3][1]] == ("Apache-2.0,MIT", 2, False)
    assert all(got[k] == ("", 0, False) for k in ((5, None), (6, ""), (7, "the MIT License"), (8, rows[7][1]), (9, rows[8][1])))
    assert got[4, rows[9][1]] == ("CC-BY-4.0", 1, True)
    assert licences.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("Own-1.0", "You may read, but not write."), (None, "more"), ("x", "!")], "licence string, text string")
    found = {r.doc_id: r.licences for r in licences.scan(df, texts=own).collect()}
    assert found[7] == "" and [r.licences for r in licences.scan(df, texts=own).where("text = 'prose'").collect()] == []
    mine = spark.createDataFrame([(1, "prose\nYOU may read but not write\n"), (2, "more"), (3, "SPDX-License-Identifier: GPL-2.0-or-later")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licences.scan(mine, texts=own).collect()} == {1: "Own-1.0", 2: "", 3: "GPL-2.0-or-later"}


def test_licence_scan_and_twin_on_usual_layouts(spark, tmp_path):
    texts = {name: text for name, kind, text in licences.KNOWN if kind == "text"}
    rows = [f"{head}{texts[name]}" for name in sorted(texts) for head in ("", "Copyright (c) 2001 A\n\n", "MIT\n", "Copyright 2020 A, B\nAll rights reserved.\n\n")]
    rows += ["Copyright 2020 X. Licensed under the MIT License.", "Copyright © 2020 X.\nLicenced under CC BY 4.0\n", "copyright law", None, "", "all rights reserved",
             "Copyright 2020 " + "a😀" * 500_000 + "\nReleased under the MIT License.", "a\n\nSPDX-License-Identifier: BSD-2-Clause\n\nb", "licence\rlicensed under CC BY 4.0\r\n"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    both = duckdb.connect()
    both.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in both.sql(TWINS["op1_licence_digests"]).fetchall()}
    got = {r.doc_id: (r.licences, r.n_matches, r.whole_text) for r in QUERIES["op1_licence_digests"](spark, str(tmp_path)).collect()}
    assert got == want and got[len(rows) - 3] == ("MIT", 2, True) and got[20][0] == "MIT"


def test_licence_bodies_keep_lines_that_begin_with_copyright(spark):
    texts = {name: text for name, kind, text in licences.KNOWN if kind == "text"}
    mit = texts["MIT"].replace("\nWARRANTIES", " WARRANTIES").replace("AUTHORS OR\nCOPYRIGHT HOLDERS", "\nAUTHORS OR COPYRIGHT HOLDERS")
    isc = texts["ISC"].replace("the above copyright", "the above\ncopyright")
    assert mit != texts["MIT"] and isc != texts["ISC"]
    heads = ["", "Copyright (c) 2020 Some Body\n\n", "© 2020 Some Body\nAll rights reserved.\n\n", "Copyright 2020 Some Body. "]
    rows = [(h + form(t), name) for h in heads for t, name in ((mit, "MIT"), (isc, "ISC"), (texts["0BSD"], "0BSD"))
            for form in (str, lambda t: " ".join(t.split()), lambda t: "\n".join(t.split(" ")))]
    cut = mit.replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES", "")
    rows += [(cut, ""), ("copyright law\n" + isc, "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].licences for i in range(len(rows))] == [name for _, name in rows]
    assert all(got[i].whole_text == bool(name) for i, (_, name) in enumerate(rows))


def test_url_lists(spark):
    day = lambda n: dt.date(2024, 1, n)
    entries = [("l", "block", "bad.com", day(5), "add"), ("l", "block", "bad.com", day(10), "remove"), ("l", "block", "bad.com", day(10), "add"),
               ("l", "block", "bad.com", day(20), "remove"), ("l", "block", "bad.com", day(25), "remove"), ("m", "block", "x.bad.com", day(1), "add"),
               ("ok", "allow", "good.x.bad.com", day(1), "add"), ("p", "block", "site.org/a/b", day(3), "add"), ("l", "block", None, day(1), "add"),
               ("l", "block", "gone.net", day(2), "remove"), (None, "block", "null.net", day(1), "add"), ("q", "block", "null.net", None, "add")]
    cases = [("http://bad.com/", 4, ""), ("http://bad.com", 5, "l"), ("https://u:p@www.BAD.com.:80/p?q", 10, "l"), ("http://bad.com", 19, "l"),
             ("http://bad.com", 20, ""), ("http://notbad.com", 6, ""), ("http://y.x.bad.com", 6, "l,m"), ("http://good.x.bad.com", 2, "m,ok"),
             ("http://site.org/a/b/?x=1#y", 3, "p"), ("http://site.org/a/b", 2, ""), ("http://site.org/a", 9, ""), ("http://gone.net", 9, ""),
             ("http://null.net", 9, ""), (None, 3, ""), ("", 3, ""), ("no url", 3, ""), ("http://bad.com", None, "")]
    rows = [(i, u, None if d is None else day(d), "x") for i, (u, d, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:2], "page_id int, url string, fetched date, host string")
    history = spark.createDataFrame(entries, "list_name string, effect string, key string, day date, action string")
    got = url_lists.evaluate(df, history).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = cases[r.page_id][2]
        assert r.lists == want, r
        assert r.blocked == (want != "" and "ok" not in want)
        assert (r.listed_since is None) == (want == "")
    assert url_lists.evaluate(df.limit(0), history).count() == 0
    assert url_lists.evaluate(df, history.limit(0)).where("lists <> '' or blocked").count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fits(k, m.group())] for k, p in PLAIN.items()}


def test_spans_equal_the_plain_patterns(spark):
    draw = random.Random(8)
    parts = ["a@b.c", "a@b.c_d@e.f", "@", ".", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111",
             "+1 (555) 123-4567", "+12", "++49 30 1234567 ", "é🙂", " ", "-", "4", "x", "%+-@x.y", "\n", "4111111111111111", "0", "a@b"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", "a" * 100_000, "1" * 50_000, "1 " * 20_000, "a@b.c " * 3000, "." * 50_000 + "@", "1." * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.base_spans(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert {k: [(s.start, s.end) for s in r[k]] for k in PLAIN} == want, texts[r.doc_id][:200]


def test_disclosing_words(spark):
    draw = random.Random(9)
    prose = lambda: " ".join(draw.choice(["ruda", "selin", "mota", "kerin", "dolu"]) for _ in range(30))
    rows = [(i, prose()) for i in range(200)]
    rows += [(300 + i, f"{prose()} Zorbinek kerin jane@mail.org, mota {prose()}") for i in range(4)]
    rows += [(400, "hapaxon solo@mail.org"), (401, "hapaxon solo@mail.org"), (402, None), (403, ""), (404, "x +1 (555) 123-4567 and jane@mail.org")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, email string")
    found = pii.report(pii.find(df, carry=("doc_id", "email"))).collect()
    assert len(found) == len(rows)
    spans = {r.doc_id: r.spans for r in found}
    texts = dict(rows)
    named = {texts[i][int(s.split(":")[1]):int(s.split(":")[2])] for i in spans for s in spans[i].split(",") if s.startswith(("term", "word"))}
    assert named == {"Zorbinek"}  # common words reveal nothing; hapaxon has only one text behind it
    assert all(spans[300 + i].count("term:") == 1 for i in range(4))
    wide = df.selectExpr("*", "'i' as ip", "'c' as card", "'p' as phone", "'t' as term", "'w' as word", "1 as __text", "2 as __row")
    kept = pii.sanitise(wide).collect()
    assert {tuple(r)[2:] for r in kept} == {("k", "i", "c", "p", "t", "w", 1, 2)} and pii.sanitise(wide).columns == wide.columns
    clean = {r.doc_id: r.text for r in kept}
    assert clean[402] is None and clean[403] == "" and clean[404] == "x <PHONE> and <EMAIL>" and clean[0] == texts[0]
    assert "<REMOVED> kerin <EMAIL>, mota" in clean[300]
    assert pii.report(pii.find(df.limit(0), carry=("doc_id",))).count() == 0


def test_disclosing_words_anywhere_in_the_document(spark):
    draw = random.Random(11)
    prose = lambda n: " ".join(draw.choice(["ruda", "selin", "mota", "kerin", "dolu"]) for _ in range(n))
    rows = [(i, prose(30)) for i in range(200)]
    rows += [(300 + i, f"Zorbinek {prose(100)} jane@mail.org {prose(60)}\n\nzorbinek, {prose(3)} mail") for i in range(3)]
    rows += [(310, f"Zorbinek {prose(9)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    spans = {r.doc_id: r for r in pii.find(df, carry=("doc_id",)).collect()}
    for i in range(300, 303):
        text = dict(rows)[i]
        want = [m.span() for m in re.finditer("(?i)zorbinek", text)] + [(len(text) - 4, len(text))]
        assert sorted((s.start, s.end) for s in [*spans[i].term, *spans[i].word]) == want and len(want) == 3
        assert "orbinek" not in clean[i] and "<EMAIL>" in clean[i]
    assert clean[310] == rows[-1][1]  # no entity in it


def test_disclosure_equals_brute_force(spark):
    draw = random.Random(14)
    names = ["Zorbinek", "Quallo", "Mirte", "Hosk"]
    prose = lambda n: " ".join(draw.choice(["ruda", "selin", "mota", "kerin", "dolu", "teva", "nobi"]) for _ in range(n))
    texts = [prose(draw.randint(0, 12)) for _ in range(120)] + [None, ""]
    for i in range(60):
        who = draw.choice(names)
        texts.append(f"{who if draw.random() < 0.8 else ''} {prose(draw.randint(1, 6))} {who[:2].lower()}@mail.org {draw.choice(names) if draw.random() < 0.2 else ''}")
    texts += texts[-10:]
    spans = [[(k, t[a:b]) for k, at in plain_spans(t).items() for a, b in at] for t in map(lambda t: t or "", texts)]
    words_in = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for t in texts]
    free = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], lambda m: " " * len(m[0]), t or ""))} for t in texts]
    want, total = set(), len(texts)
    for entity in {s for some in spans for s in some}:
        have = [i for i in range(total) if entity in spans[i]]
        if len({texts[i] for i in have}) < pii.SUPPORT:
            continue
        for term in {w for i in have for w in free[i]}:
            both, n = [i for i in have if term in free[i]], sum(term in w for w in words_in)
            if len({texts[i] for i in both}) >= pii.SUPPORT:
                ratio = math.log2(len(both) * total / (len(have) * n)) / math.log2(total / len(have))
                want |= {(i, term, ratio >= pii.REMOVE) for i in both if ratio >= pii.GENERALISE}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set()
    for r in pii.find(df, carry=("doc_id",)).collect():
        got |= {(r.doc_id, texts[r.doc_id][s.start:s.end].lower(), kind == "term") for kind in ("term", "word") for s in r[kind]}
    strongest = {(i, t): max(x for j, u, x in want if (j, u) == (i, t)) for i, t, _ in want}
    assert got == {(i, t, x) for (i, t), x in strongest.items()} and len(got) > 20


def test_shards(spark):
    draw = random.Random(10)
    rows = [(i, "hot text " * 5) for i in range(700)] + [(1000 + i, "t" * draw.randint(0, 400)) for i in range(1300)] + [(5, "same")] * 50
    rows += [(None, None), (7000, None), (7001, ""), (7002, "é" * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int").drop("size")
    for block_rows in (10**6, 20):
        got = shards.histogram_shards(df, 24, block_rows=block_rows).collect()
        assert len(got) == len(rows)
        want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
        assert sorted((r["size"], r.text_crc32) for r in got) == want
        total, most = sum(s for s, _ in want), max(s for s, _ in want)
        for s in range(24):
            mine = [r for r in got if r.shard == s]
            assert sorted(r.slot for r in mine) == list(range(len(mine)))
            assert abs(sum(r["size"] for r in mine) - total / 24) <= most
    few = shards.histogram_shards(df.limit(3), 24).collect()
    assert len(few) == 3 and {s: sorted(r.slot for r in few if r.shard == s) for s in {r.shard for r in few}} == {
        s: list(range(sum(r.shard == s for r in few))) for s in {r.shard for r in few}}
    names = ["doc_id", "text", "size", "key", "row_number", "block", "__text", "shard"]
    odd = shards.histogram_shards(spark.createDataFrame([(i, "t", *"abcdef") for i in range(9)], names), 2, carry=tuple(names[2:]))
    assert odd.columns == ["doc_id", "key", "row_number", "block", "__text", "size", "text_crc32", "shard", "slot"]
    assert {(r.key, r.row_number, r.block, r["__text"], r["size"]) for r in odd.collect()} == {("b", "c", "d", "e", 9)}
    assert shards.histogram_shards(df.limit(0), 24).count() == 0
