"""Look-alikes, scanned pages, leaks and wrong encodings."""

import random
import re

import numpy as np
import pytest

from weftdocs.llm import leak, lookalike, mojibake, scanned


@pytest.mark.parametrize("a,b", [("ＡＢ１", "AB1"), ("ﾃﾞｰﾀ", "データ"), ("é", "é"), ("a​b", "ab"), ("сор", "cop"), ("カラム", "力ラム"), ("ﬁle", "file"), ("a　b", "a b"), ("x‐y", "x-y"), ("〜", "～"), ("⾦", "金"), ("精", "精")])
def test_same_class(a, b):
    assert lookalike.classes(a) == lookalike.classes(b)


@pytest.mark.parametrize("a,b", [("docx", "Docx"), ("カ", "か"), ("カ", "ガ"), ("-", "~"), ("x²", "x2"), ("①", "1"), ("0", "O"), ("ab", "a b"), ("l", "I")])
def test_told_apart(a, b):
    assert lookalike.classes(a) != lookalike.classes(b)


def test_tokens_rebuild_and_agree():
    for t in ("ﾃﾞｰ​ﾀ確認 a­b-1", "", "力ラム説明", "été\r\n"):
        assert "".join(lookalike.tokens(t)) == t
    a, b = lookalike.tokens("学習ﾃﾞｰﾀの　確認"), lookalike.tokens("学習デー夕の 確認")
    assert [lookalike.classes(x) for x in a] == [lookalike.classes(x) for x in b]


def test_automaton_walks_raw_tokens():
    trie = lookalike.Trie()
    for w, n in [("ガラス", 3), ("カラス", 9), ("café", 2), ("口座", 5), ("AB", 1), ("キロ", 1)]:
        trie.add(w, n)
    free = {"ｶﾞﾗｽ": "ガラス", "力ラス": "カラス", "cafe\u0301": "café", "c\u0430f\u200be\u0301": "café", "ロ座": "口座", "ＡВ": "AB", "\u3314": "キロ"}
    assert {t: trie.walk(t) for t in free} == free
    assert trie.walk("cafe") is None and trie.walk("ガ") is None and trie.walk("") is None
    # edits that a reader sees cost something and lead somewhere only under a higher bound
    assert trie.walk("cafe", 1.0) == "café" and trie.walk("カラ", 1.0) == "カラス" and trie.walk("カラスx", 1.0) == "カラス" and trie.walk("ムラス", 1.0) == "カラス"


def test_tokens_beyond_the_basic_plane():
    t = "ｶﾞa\U00020000\u0301が"
    assert lookalike.tokens(t) == ["ｶﾞ", "a", "\U00020000\u0301", "が"]
    assert lookalike.tokens("\u200bab") == ["\u200b", "ab"]


def test_classes_count_links(spark):
    d = spark.createDataFrame([(1, "データ"), (2, "ﾃﾞｰﾀ"), (3, "デー夕"), (4, "データ"), (5, "x"), (6, None)], "id long, t string")
    got = {r.id: (r.class_id, r.variants, r.links) for r in lookalike.classes_of(d, "id", "t").collect()}
    assert got == {1: (1, 3, 2), 4: (1, 3, 2), 2: (1, 3, 3), 3: (1, 3, 3)}
    assert lookalike.classes_of(d.limit(0), "id", "t").count() == 0


def test_look_alikes(spark):
    d = spark.createDataFrame([(1, "データの確認", "k"), (2, "ﾃﾞｰ​ﾀの確認", "k"), (3, "デー夕の確認", "k"), (4, "データの確認", "k"), (5, "テータの確認", "k"), (6, None, None), (7, "", None), (8, "長" * 30000, None)], "id long, t string, canonical string")
    got = sorted((r.key_a, r.key_b) for r in lookalike.look_alikes(d, "id", "t").collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    forms = {r.id: r.canonical for r in lookalike.unify(d, "id", "t").collect()}
    assert forms[1] == forms[2] == forms[3] == "データの確認" and forms[6] is None and forms[7] == ""
    assert lookalike.look_alikes(d.limit(0), "id", "t").count() == 0


PAGE = "\n".join(
    ["Hibara Report 57", "The sensor feed is refreshed four times a week and is mat-", "ched to the column guide through the agreed key. The test", "environment keeps ten generations of the feed. The client",
     "— 1 —", "[ページ2]", "Hibara Report 57", "ledger is refreshed two times a week and is matched to the", "report and all other tables of the shared drive. A hand-", "over is planned for the coming week. The test environment", "keeps ten copies.", "", "Qty", "- 4. recall", "12", "", "— 2 —"]
)


SOUND = [
    "The sensor feed is refreshed four times a week and is matched to the column guide through the agreed key. The test environment keeps ten generations of the feed and of the report.",
    "The client ledger is refreshed two times a week and is matched to the report and all other tables of the shared drive. A hand-over is planned for the coming week.\nid | item | days\n1 | feed | 3\n2 | ledger | 5",
    "Costs are capped at the agreed amount and any excess needs a separate note. Requests are processed within ten working days after the client approves them.\n\n- 4. recall\n12",
    "short note",
    "To-do: feed - OK\nNo.5 is open",
]


def layout_of(texts):
    """The layout models, trained on the driver as a task trains them."""
    wholes, lines = [], []
    for t in texts:
        rng = random.Random(t)
        wholes += [(scanned.page(t).whole, -1)] * scanned.LAYOUTS
        lines += [(f, -1) for f in scanned.page(t).facts.values()]
        for _ in range(scanned.LAYOUTS):
            made = scanned.laid_out(t, rng)
            if made:
                p = scanned.page(made[0])
                wholes.append((p.whole, 1))
                lines += [(f, 1 if i in made[1] else -1) for i, f in p.facts.items()]
    return {k: scanned.Perceptron().fit(v, random.Random(7)).averaged() for k, v in (("page", wholes), ("line", lines))}


def test_laid_out_pages_say_what_was_put_in():
    for k in range(40):
        made = scanned.laid_out(SOUND[0], random.Random(k))
        lines = made[0].split("\n")
        body = re.sub(r"[^a-z]", "", "".join(x for i, x in enumerate(lines) if i not in made[1] and not scanned.MARK.fullmatch(x)).lower())
        assert all(0 <= i < len(lines) and lines[i].strip() for i in made[1]) and body.startswith(re.sub(r"[^a-z]", "", SOUND[0].lower())[:100])
    assert scanned.laid_out("short note", random.Random(1)) is None and scanned.laid_out("", random.Random(1)) is None


def test_page_furniture():
    weights = layout_of([f"{a} {b}" for a in SOUND for b in SOUND] + SOUND * 5)
    p = scanned.page(PAGE)
    assert scanned.score(p.whole, weights["page"]) > 0 and p.mark[5]
    assert {1, 5, 7, 17} >= {i + 1 for i, r in enumerate(p.settled(weights["line"]).running) if r} >= {1, 7}
    for t in ("", "one line", "a | b\nc | d\n" * 9):
        assert scanned.score(scanned.page(t).whole, weights["page"]) <= 0
    assert scanned.page("").lines == [""] and not scanned.page("").facts


def test_repeats_are_found_without_comparing_all():
    names = ["header of the report", "minutes of the meeting", "list of all columns"]
    shapes = [(i, names[i % 3]) for i in range(0, 3000, 10)] + [(5, "headcr of the report"), (7, "ab"), (9, "ab")]
    groups = [g for g in scanned.repeats(shapes) if len(g) > 1]
    assert [7, 9] in groups and any(5 in g and len(g) > 90 for g in groups)


@pytest.mark.parametrize("line,value", [("— 3 —", 3), ("Page 2 of 9", 2), ("[4]", 4), ("iv", 4), ("3/8", 3), ("ページ 5", 5), ("6 頁", 6), ("p. 7", 7)])
def test_number_forms(line, value):
    assert scanned.number_form(line)[1] == value


def test_number_forms_refuse_text():
    assert scanned.number_form("3/8 sensor feed") is None and scanned.number_form("12 cells") is None


def test_repair(spark):
    words = "the sensor feed keeps ten generations of every report and the client ledger holds the figures".split()
    clean = [(i, "txt", " ".join(words[(i + k) % len(words)] for k in range(14)) + ".\n a hand-over note for the client") for i in range(120)]
    noisy = [(1000 + i, "pdf", PAGE.replace("generations", "gcnerations").replace("ledger is", "lcdger is").replace("report and", "rcport and").replace("keeps ten copies", "kceps ten copies")) for i in range(3)]
    d = spark.createDataFrame([*clean, *noisy, (2000, "pdf", None), (2001, "pdf", "")], "id long, kind string, text string")
    rows = {r.id: r for r in scanned.repair(d, "id", "text", d.filter("kind = 'pdf'")).collect()}
    assert set(rows) == {1000, 1001, 1002}
    noise = {(n.line_no, n.noise) for n in rows[1000].noise}
    assert {(1, "running"), (5, "running"), (7, "running"), (17, "running"), (4, "misread"), (8, "misread")} <= noise
    assert (9, "hyphen") not in noise and "generations" in rows[1000].repaired and "Report 57" not in rows[1000].repaired
    assert scanned.repair(d, "id", "text", d.limit(0)).count() == 0


def test_normal_form():
    assert leak.normal(["Ａb-1 c", "ﾃﾞ~_"]).tobytes().decode("utf-16-le") == "ab1c\x01デ\x01"


def test_alignment_against_words():
    item = "abcdefghij" * 6
    pairs = [(item, "x" * 30 + item + "y" * 30, 30, 30), (item, "x" * 30 + item[:30] + "zzzzzzzzzz" + item[40:] + "q", 30, 30), (item, item[30:], -30, -30), (item, "x" * 80, 0, 0)]
    span = leak.aligned(pairs)
    assert [int(b - a) for a, b, _ in span] == [60, 30, 30, 0]


def test_leaks(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("木林森田畑川山石火水風土金銀銅鉄糸布衣食住行走歩止"))
    make = lambda n: "".join(rng.choice(letters, n))
    items = [make(120) for _ in range(5)]
    broken = "。\n".join(items[1][i : i + 17] for i in range(0, 120, 17))
    altered = "".join(c if i % 12 else "々" for i, c in enumerate(items[2]))
    docs = [(1, make(400) + items[0][:70] + make(300)), (2, "> " + broken), (3, altered), (4, make(300) + items[3][:40] + make(50)), (5, None), (6, ""), (7, make(60000) + items[4])]
    d = spark.createDataFrame(docs, "doc long, text string").selectExpr("doc AS doc_id", "text", "text AS form")
    i = spark.createDataFrame([(n, t) for n, t in enumerate(items)] + [(99, None), (98, ""), (97, "短い")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leak.find(d, "doc_id", i, "item_id").collect())
    assert got == [(1, 0), (2, 1), (3, 2), (7, 4)]
    assert leak.find(d, "doc_id", i.limit(0), "item_id").count() == 0 and leak.find(d.limit(0), "doc_id", i, "item_id").count() == 0


def test_short_items_and_blocks_of_items(spark, monkeypatch):
    items = [(1, "第九号"), (2, "Ab-12 x"), (3, "契約書の写し"), (4, "x"), (5, "木林森田畑川山石火水風土" * 4)]
    docs = [(1, "本件は第 九号である。"), (2, "ref AB12X, copy"), (3, "契約の写し"), (4, "契約書の、写しを添える"), (5, "木林森田畑川山石火水風土" * 3), (6, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1): True, (2, 2): True, (2, 4): True, (4, 3): True, (5, 5): True}
    assert {(r.doc_id, r.item_id): r.exact for r in leak.find(d, "doc_id", i, "item_id").collect()} == want
    monkeypatch.setattr(leak, "ITEM_CHARS", 10)
    assert {(r.doc_id, r.item_id): r.exact for r in leak.find(d, "doc_id", i, "item_id").collect()} == want


def test_phrases_and_proximity(spark):
    item = "the sensor feed keeps ten generations of every report and the client ledger holds all of the figures"
    d = spark.createDataFrame([(1, "x " + item[:70]), (2, item.replace("ten", "tan"))], "doc_id long, text string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.exact, r.share) for r in leak.find(d, "doc_id", i, "item_id").collect()}
    assert got[1][0] and not got[2][0] and got[1][1] < got[2][1] == 1.0


@pytest.mark.parametrize("stored,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp932"), ("euc_jp", "latin-1"), ("cp932", "cp1252")])
def test_inverse_round_trip(stored, read):
    text = "学習データの集計"
    garbled = "".join(
        b.decode(read) if len(b) > 1 or b < b"\x80" else b.decode("latin-1") for b in [text.encode(stored)]
    ) if read in ("latin-1", "mac_roman") else "".join(
        (bytes([b]).decode(read) if _ok(b, read) else chr(b)) for b in text.encode(stored)
    ) if read == "cp1252" else text.encode(stored).decode(read, "replace")
    inv = mojibake.inverse(stored, read)
    back = "".join(r[2] for r in inv.runs(garbled))
    assert back and set(back) <= set(text) and len(back) >= 0.6 * len(text)


def _ok(b, read):
    try:
        bytes([b]).decode(read)
        return True
    except UnicodeDecodeError:
        return False


def test_find_garbled(spark):
    clean = [(i, f"Der Prüfbericht {i} wird künftig geprüft und für die Übergabe genutzt, café {i}.") for i in range(20)]
    wrong = [(100 + i, t.encode().decode("cp1252", "replace")) for i, t in clean[:4]]
    d = spark.createDataFrame([*clean, *wrong, (200, "F�r die Übergabe"), (201, "so wor??den ist"), (202, "Wirklich??? Ja"), (203, None), (204, ""), (205, "São Âmber, Zone Å–4")], "doc_id long, text string").selectExpr("*", "1 AS unit")
    got = {r.doc_id: (r.places > 0, r.lost > 0) for r in mojibake.find(d, "doc_id").collect()}
    assert set(got) == {100, 101, 102, 103, 200, 201} and got[200][1] and got[201][1]
    assert mojibake.find(d.limit(0), "doc_id").count() == 0


def hot_copies():
    """One sound copy of an item and a hot group of copies altered at the same place of each quarter."""
    rng = np.random.default_rng(3)
    item = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxy"), 240))
    altered = "".join("z" if i % 60 == 30 else c for i, c in enumerate(item))
    return item, [(0, item), *((n, f"{n} " + altered) for n in range(1, 30)), (90, item[:100]), (91, altered[60:200])]


def test_leaks_of_a_hot_altered_copy(spark):
    item, docs = hot_copies()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in leak.find(d, "doc_id", i, "item_id").collect()) == [*range(30), 91]


def test_bound_refuses_no_passage():
    rng = np.random.default_rng(4)
    item = rng.integers(97, 123, 200).astype("u2")
    kept = 0
    for _ in range(200):
        doc = item.copy()
        doc[rng.random(200) < rng.uniform(0.1, 0.3)] = 90
        doc = np.delete(doc, rng.integers(0, 200, rng.integers(0, 6)))
        right = np.full((1, 200 + 2 * leak.SLACK), leak.END, "u2")
        right[0, leak.SLACK : leak.SLACK + len(doc)] = doc
        (a, b, _), hope = leak.aligned([(item, right[0], leak.SLACK, leak.SLACK)])[0], leak.hopeful(item[None], right, np.array([200]), 0.5)[0]
        kept += b - a >= 100
        assert hope or b - a < 100
    assert 20 < kept < 200


def test_every_twin_is_met(spark):
    clean = [f"caf{ch}" for ch in "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"]  # one stripped text
    wrong = [u.encode().decode("cp1252") for u in clean]
    vocab = spark.createDataFrame([("u", u, n) for n, u in enumerate([*clean, *wrong], 1)], "kind string, key string, df long")
    got = {(r.garbled, r.clean) for r in mojibake.twins(vocab, mojibake.contexts(vocab)).filter("stored = 'utf-8' AND read = 'cp1252'").collect()}
    assert got == set(zip(wrong, clean, strict=True))
    # an encoding gives ¢ and ￠ the same bytes
    vocab = spark.createDataFrame([("u", "abc¢", 1), ("u", "abc¢".encode("cp932").decode("mac_roman"), 1)], "kind string, key string, df long")
    assert ("cp932", "mac_roman", "abc¢") in {(r.stored, r.read, r.clean) for r in mojibake.twins(vocab, mojibake.contexts(vocab)).collect()}


def test_find_garbled_in_hot_copies(spark):
    words = ["Prüfung", "künftig", "Übergabe", "geprüft", "Prüfbericht"]
    clean = [(i, f"{words[i % 5]} und {words[(i + 1) % 5]} {i}") for i in range(10)] + [(20, "une idée à l'été, même côté thé"), (21, "forêt naïve née blé")]
    wrong = [(100 + i, t.encode().decode("cp1252", "replace")) for i, t in clean[:4]]
    hot = [(200 + i, f"Note {i}: rÃ©union dÃ©jÃ  prÃªte") for i in range(40)]  # no twin, and more documents than any sound character has
    d = spark.createDataFrame([*clean, *wrong, *hot, (300, "São Âmber, Zone Å–4")], "doc_id long, text string")
    assert {r.doc_id for r in mojibake.find(d, "doc_id").collect()} == {*range(100, 104), *range(200, 240)}


def test_find_garbled_by_single_bytes(spark):
    words = ["geprüft", "künftig", "natürlich", "zurück", "früher"]
    clean = [(i, f"{words[i % 5]} {words[(i + 2) % 5]} {i}, auf 20 m³ und Èze, Tür für Züge über Brücken") for i in range(10)]
    wrong = [(100 + i, w.encode("cp1252").decode("mac_roman")) for i, w in enumerate(words)]
    d = spark.createDataFrame([*clean, *wrong, (200, "Gemüse".encode("cp1252").decode("mac_roman"))], "doc_id long, text string")  # 200 has no twin
    assert {r.doc_id for r in mojibake.find(d, "doc_id").collect()} == {*range(100, 105), 200}


def test_twins_as_rare_as_each_other(spark):
    words = ["Prüfung", "künftig", "Übergabe"]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).encode().decode("cp1252", "replace"))], "doc_id long, text string")
    assert {r.doc_id for r in mojibake.find(d, "doc_id").collect()} == {2}


def test_misread_characters_do_not_depend_on_the_partitions(spark):
    clean = [(i, "txt", "毎日の学習計画を全員で確認する。") for i in range(400)]
    line = "この資料の学習計画はまだ誰にも公開されていないものです"
    pages = [(1000 + i, "pdf", "\n".join([line[k:] + line[:k] for k in range(0, 12, 3)] + ["毎日の学習計画を全員で確認する。" if i % 8 else "毎日の学習汁画を全員で確認する。"])) for i in range(40)]
    d = spark.createDataFrame([*clean, *pages], "id long, kind string, text string")
    counts = scanned.counted(d, "text")
    laid = d.filter("kind = 'pdf'").selectExpr("0L AS block", "id AS _key", "text AS _text", "array(0) AS running")
    few, many = (scanned.confusions(laid.repartition(n), counts) for n in (1, 40))
    assert "計" in few.get("汁", []) and few == many


def test_misread_characters_are_found_however_often_they_stand(spark):
    clean = [(i, "txt", "毎日の学習計画を全員で確認する。") for i in range(400)]
    other = [(2000 + i, "txt", f"{chr(0x4E00 + i)}習汁画{chr(0x5E00 + i)}") for i in range(350)]  # the same misreading elsewhere, as a large corpus has it
    pages = [(1000 + i, "pdf", "毎日の学習計画を全員で確認する。" if i % 8 else "毎日の学習汁画を全員で確認する。") for i in range(40)]
    d = spark.createDataFrame([*clean, *other, *pages], "id long, kind string, text string")
    laid = d.filter("kind = 'pdf'").selectExpr("0L AS block", "id AS _key", "text AS _text", "cast(array() AS array<int>) AS running")
    assert "計" in scanned.confusions(laid, scanned.counted(d, "text")).get("汁", [])


def test_counts_are_exact(spark):
    texts = ["Data feed, data\r\n計画を計画", "計画\nfeed 12", "", None, "計画を計画"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = scanned.counted(d.repartition(3), "text").collect()
    words = {r.word: r.n for r in rows if r.word}
    assert words == {"data": 2, "feed": 2, "00": 1}
    held = {(r.context, r.centre): r.n for r in rows if not r.word}
    assert held[scanned.window("\n計画を計")] == 2 and held[scanned.window("\n\n計画\n")] == 1 and held[scanned.window("\n計画")] == 3 and held[scanned.window("計画\n")] == 3
    assert scanned.counted(d.limit(0), "text").count() == 0


def test_repair_does_not_depend_on_batches(spark):
    words = "the sensor feed keeps ten generations of every report and the client ledger holds the figures".split()
    clean = [(i, "txt", " ".join(words[(i + k) % len(words)] for k in range(14)) + ".\n a hand-over note for the client") for i in range(120)]
    noisy = [(1000 + i, "pdf", PAGE.replace("generations", "gcnerations").replace("report and", "rcport and").replace("keeps ten copies", "kceps ten copies")) for i in range(9)]
    d = spark.createDataFrame([*clean, *noisy], "id long, kind string, text string")
    got = []
    for batch, parts in ((2, 7), (10000, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        some = d.repartition(parts)
        got.append(sorted((r.id, r.repaired, str(r.noise)) for r in scanned.repair(some, "id", "text", some.filter("kind = 'pdf'")).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == 9
