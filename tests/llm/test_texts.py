import random
import unicodedata

import pytest

from tributary.llm import leakage, pii
from tributary.llm.offsets import nfkc

ITEM = "When the meter reads zero at noon, which of the nine blue dials of plant seven must be turned back before dusk?"


def test_nfkc_keeps_places():
    rnd = random.Random(7)
    alphabet = "ab ﬁ²Ａé" + "é" + "각" + "­​" + "İß각½"
    for _ in range(300):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))
        whole, at = nfkc(t)
        assert whole == unicodedata.normalize("NFKC", t) and len(at) == len(whole) and list(at) == sorted(at)


@pytest.mark.parametrize("text, found", [
    (ITEM, True),
    ("x " + ITEM.upper() + " y", True),
    ("see: " + " ".join(ITEM.split()[3:15]) + " end", True),
    (" ".join(ITEM.split()[3:14]), False),
    (ITEM.replace("blue", "red"), False),
    ("ｗｈｅｎ" + ITEM[4:].replace("meter", "me­ter").replace(" ", "\n​ "), True),
    (ITEM.replace(" ", "-"), True),
    ("", False), (None, False), ("a " * 50_000, False), ("z " * 50_000 + ITEM, True),
])
def test_leak(text, found):
    a = leakage.Finder([(1, ITEM), (2, None), (3, "too short"), (4, "")])
    assert leakage.found_in(a, text) == ({1} if found else set())
    for i, s, e in leakage.passages_in(a, text):
        assert i == 1 and " ".join(leakage.words(text[s:e])) in " ".join(leakage.words(ITEM))


def test_leaks_frame(spark, monkeypatch):
    monkeypatch.setattr(leakage, "CHARS", 1)
    docs = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (None, ITEM, 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(5, ITEM), (6, ITEM + " again"), (7, None), (None, ITEM)], "item_id int, text string")
    assert sorted(map(tuple, leakage.leaks(docs, items, "doc_id", "item_id").collect()), key=str) == [(1, 5), (1, 5), (1, 6), (1, 6), (None, 5), (None, 6)]
    assert leakage.leaks(docs, items.limit(0), "doc_id", "item_id").collect() == []
    assert leakage.leaks(docs.limit(1), items.withColumnRenamed("item_id", "doc_id"), "doc_id", "doc_id").columns == ["doc_id", "item_doc_id"]
    s = leakage.leaks(docs.limit(1), items.limit(1), "doc_id", "item_id", spans=True).collect()
    assert [(r.start_char, r.end_char) for r in s] == [(0, len(ITEM) - 1)]


@pytest.mark.parametrize("text, want", [
    ("mail ada.fenwick+x@post.example.net.", [("email", "ada.fenwick+x@post.example.net")]),
    ("to beth dot thornwick at dunmere dot test; ok", [("email", "beth dot thornwick at dunmere dot test")]),
    ("(tthorndale [at] mail [dot] example [dot] org).", [("email", "tthorndale [at] mail [dot] example [dot] org")]),
    ("ａｄａ＠ｅｘａｍｐｌｅ．ｃｏｍ!", [("email", "ａｄａ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
    ("Meet at noon. loader@0.12.8 @dienst-ochre", []),
    ("try 364.555.0149 x716 instead", [("phone", "364.555.0149 x716")]),
    ("call +44 (0)113 496 0223 now", [("phone", "+44 (0)113 496 0223")]),
    ("al (+34) 500.974.758.", [("phone", "(+34) 500.974.758")]),
    ("unter (069) 900 09153 oder", [("phone", "(069) 900 09153")]),
    ("one of the two or three", []),
    ("dial two one four five five five zero one nine six today", [("phone", "two one four five five five zero one nine six")]),
    ("My SSN is 000-17-1414, ok", [("id_number", "000-17-1414")]),
    ("NIR 2 03 16 97 144 863 98 vérifié", [("id_number", "2 03 16 97 144 863 98")]),
    ("DNI 00.098.021-N comprobado", [("id_number", "00.098.021-N")]),
    ("Serial 252-23-4613 Parcel 3372/843375-616 Order 8799-09 Build 55213.34.6854 Invoice 2025-48595-79 id=4495550196", []),
    ("go to 93 Bellfounder Rd #3\nTilbrock, 00138. Now", [("address", "93 Bellfounder Rd #3\nTilbrock, 00138")]),
    ("an Am Alten Siel 187 b\r\n00751 Altkirchfeld.", [("address", "Am Alten Siel 187 b\r\n00751 Altkirchfeld")]),
    ("a calle Molino Viejo n.º 185, 2.º B - San Telmo del Río\n", [("address", "calle Molino Viejo n.º 185, 2.º B - San Telmo del Río")]),
    ("au 52 impasse de l'Étang Vert à Rochevigne Avec", [("address", "52 impasse de l'Étang Vert à Rochevigne")]),
    ("the Copper Landing boards", []),
    ("Dr. Ada R. van Talette and Mrs BRENHAM, ODETTE", [("name", "Ada R. van Talette"), ("name", "BRENHAM, ODETTE")]),
    ("Gemeldet von Haskherr, Tilo; Frau von Haskherr, Tilo", [("name", "Haskherr, Tilo"), ("name", "von Haskherr, Tilo")]),
    ("signed for by begoña nevwick, for T. Oskherr", [("name", "begoña nevwick"), ("name", "T. Oskherr")]),
    ("Frau Else Müller kommt", [("name", "Else Müller")]),
    ("", []), (None, []),
])
def test_pii(text, want):
    found = pii.find(text, pii.Names())
    assert [(k, text[a:b]) for a, b, k in found] == want
    if text and want:
        cut = pii.redact(text, found)
        assert all(v not in cut for _, v in want) and len(cut) == len(text) + sum(len(k) + 2 - len(v) for k, v in want)


@pytest.mark.parametrize("text, want", [
    ("Then Maria Schmidt called; maria schmidt again", [("name", "Maria Schmidt"), ("name", "maria schmidt")]),
    ("Reported by Tazmek Vorlinde today", [("name", "Tazmek Vorlinde")]),
    ("caller: tazmek vorlinde, 12 min", [("name", "tazmek vorlinde")]),
    ("Kind regards,\nTazmek Vorlinde\n", [("name", "Tazmek Vorlinde")]),
    ("handed over by J. Vorlinde and J. K. Vorlinde", [("name", "J. Vorlinde"), ("name", "J. K. Vorlinde")]),
    ("Tazmek van der Vorlinde came, as did Dr. TAZMEK VORLINDE", [("name", "Tazmek van der Vorlinde"), ("name", "TAZMEK VORLINDE")]),
    ("id;holder\n1;Vorlinde, Tazmek\n", [("name", "Vorlinde, Tazmek")]),
    ("z. B. Montag; plan B. Restart the Maria Index job", []),
    ("see 93 Bell Rd, Springfield 12345 now", [("address", "93 Bell Rd, Springfield 12345")]),
    ("lives at 14 Elm Lane, paris 75001.", [("address", "14 Elm Lane, paris 75001")]),
    ("lives at 12 Oak Street since", [("address", "12 Oak Street")]),
    ("in der Hauptstraße 12, au 12 rue de la Paix", [("address", "Hauptstraße 12"), ("address", "12 rue de la Paix")]),
    ("after 5 tries on the way", []),
    ("note: +44 20 7946 0114, got 020 7946 0958", [("phone", "+44 20 7946 0114"), ("phone", "020 7946 0958")]),
    ("rows 3645550149 page: 3645550149 Parcel +44 20 7946 0114 Order 020 7946 0958", []),
    ("Passport CFGHJK123 was shown", [("id_number", "CFGHJK123")]),
])
def test_pii_outside_the_lists(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find(text, pii.Names())] == want


def test_pii_frames(spark):
    t = "Ada Fenwick, 364.555.0149"
    df = spark.createDataFrame([(1, t * 2000), (2, None), (3, ""), (None, t), (4, t), (4, t)], "doc_id bigint, text string")
    rows = pii.found_values(df, "doc_id").collect()
    assert sum(r.doc_id == 4 for r in rows) == 4 and {r.pii_kind for r in rows} == {"name", "phone"}
    got = {r.doc_id: r.text for r in pii.redacted(df, "doc_id").collect()}
    assert got[4] == "[NAME], [PHONE]" and got[2] is None and got[3] == ""
    assert pii.found_values(df.limit(0), "doc_id").collect() == []


def test_leaks_against_brute_force():
    rnd = random.Random(8)
    for _ in range(120):
        letters = rnd.choice(["ab", "abc", "abcdefgh"])
        items = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))) for i in range(5)]
        doc = []
        for _ in range(6):
            t = rnd.choice(items)[1].split()
            a = rnd.randint(0, max(0, len(t) - 1))
            doc += t[a : a + rnd.randint(8, 20)] + [rnd.choice(letters) for _ in range(rnd.randint(0, 3))]
        grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, t in items for w in [t.split()]}
        ends = {i: [k + 11 for k in range(len(doc) - 11) if tuple(doc[k : k + 12]) in g] for i, g in grams.items()}
        f = leakage.Finder(items)
        assert leakage.found_in(f, " ".join(doc)) == {i for i, e in ends.items() if e}
        want = []
        for i, es in ends.items():
            spans = []
            for e in es:
                if spans and e <= spans[-1][1] + 1:
                    spans[-1][1] = e
                else:
                    spans.append([e - 11, e])
            want += [(i, 2 * a, 2 * b + 1) for a, b in spans]
        assert leakage.passages_in(f, " ".join(doc)) == sorted(want)
