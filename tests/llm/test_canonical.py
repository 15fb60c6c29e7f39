import random
import time

import pytest

from qirtas.llm.canonical import ALIASES, Grams, Matcher, edits, entered_values, matched, token_similarity

ENTRIES = [
    (1, "bank", "Delta Horizon Bank", "Delta Horizon Bank", "بنك أفق الدلتا", "DHB"),
    (2, "bank", "Delta Harvest Bank", "Delta Harvest Bank", "بنك حصاد الدلتا", "DHV"),
    (3, "bank", "Banque Serapia", "Banque Serapia", "مصرف سيرابيا", "BSR"),
    (4, "currency", "EGP", "Egyptian Pound", "جنيه مصري", "E£"),
    (5, "currency", "GBP", "Pound Sterling", "جنيه إسترليني", "£"),
    (6, "currency", "USD", "US Dollar", None, "$"),
    (7, "provider", "Nahr Wallet", "Nahr Wallet", "محفظة نهر", "NHW"),
    (8, "provider", "Crimson Wallet", "Crimson Wallet", "محفظة القرمزي", None),
]
SCHEMA = "canon_id int, field string, canonical string, name_en string, name_ar string, short_form string"


@pytest.mark.parametrize(
    "field,value,want",
    [
        ("bank", "delta horizon bank", 1), ("bank", " DHB ", 1), ("bank", "d.h.b.", 1), ("bank", "Delta Horizno Bank", 1), ("bank", "De1t@ Hor1z0n B@nk", 1),
        ("bank", "Bank Horizon Delta", 1), ("bank", "DeltaHarvestBank", 2), ("bank", "via Delta Harvest Bank (main br.)", 2), ("bank", "بنك حصاد الدلتا", 2),
        ("bank", "مصرف سيرابا", 3), ("bank", "Serapia", 3), ("bank", "Bnq Serapia", 3), ("bank", "Delta", 0), ("bank", "Bank", 0), ("bank", "Bank of Hanibein", 0),
        ("bank", "Wadi Post Office", 0), ("bank", "-", 0), ("bank", "4411", 0), ("bank", "x" * 100_000, 0), ("bank", "", 0), ("bank", "paid " * 30_000 + "to Delta Horizon Bank" + " again" * 30_000, 1), ("bank", "zzz " * 20_000 + "Serapai Bnque", 3),
        ("currency", "egp", 4), ("currency", "EPG", 4), ("currency", "L.E.", 4), ("currency", "E£", 4), ("currency", "£", 5), ("currency", "pounds sterling", 5),
        ("currency", "US$", 6), ("currency", "US Dolalr", 6), ("currency", "points", 0), ("currency", "BTC", 0),
        ("provider", "Nahr", 7), ("provider", "Wallet Nahr", 7), ("provider", "Wallet", 0), ("provider", "Gaqamosh Wallet", 0), ("provider", "Crimson Wlt", 8),
    ],
)
def test_match(field, value, want):
    matcher = Matcher([(e[0], *e[2:]) for e in ENTRIES if e[1] == field], {"bank", "wallet"}, ALIASES.get(field))
    assert matcher.match(value) == want


def test_longest_mention_wins():
    m = Matcher([(1, "Delta", None, None, None), (2, "Delta Horizon", None, None, None), (3, "Same", None, None, None), (4, "Same", None, None, None)])
    assert m.match("the delta horizon branch") == 2 and m.match("delta branch") == 1
    assert m.match("same") == 0  # two entries are called so


def test_index_finds_all_that_a_scan_finds():
    rnd = random.Random(1)
    parts = ["delta", "horizon", "harvest", "national", "nile", "export", "islamic", "savings", "lotus", "gate", "bank", "trust"]
    entries = [(k, " ".join(rnd.sample(parts, 2) + ["bank"]), None, None, None) for k in range(60)]
    m = Matcher(entries, {"bank"})
    scan = Matcher(entries, {"bank"})
    scan.by_token = {t: list(range(len(scan.names))) for t in scan.weight}
    scan.tokens.near = lambda text, share: scan.tokens.strings
    for _ in range(400):
        own = rnd.choice(m.names)[1]
        words_ = []
        for w in own:
            k = rnd.randrange(len(w))
            words_.append(rnd.choice([w, w[:4], w[:k] + rnd.choice("aeo") + w[k + 1 :], w[:k] + w[k + 1 :], w[: k - 1] + w[k : k + 1] + w[k - 1 : k] + w[k + 1 :] if k else w]))
        assert m.similar(words_) == scan.similar(words_), words_


def test_grams_miss_nothing():
    rnd = random.Random(2)
    known = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 14))) for _ in range(300)]
    g = Grams(known)
    for s in rnd.sample(known, 60):
        text = "".join(rnd.choice([c, c, c, c, c, rnd.choice("abcd"), ""]) for c in s)
        if len(text) >= 3:
            assert {k for k in known if edits(text, k) <= 0.34 * max(len(text), len(k))} <= set(g.near(text, 0.34))


def test_a_list_of_100_000_entries():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 5)))
    entries = [(k, f"{word()} {word()} bank", None, None, None) for k in range(100_000)]
    m = Matcher(entries, {"bank"})
    values = [f"{word()}x {word()}q trust" for _ in range(20)]
    began = time.time()
    for v in values:
        m.match(v)
    took = (time.time() - began) / len(values)
    print(f"{1000 * took:.1f} ms a value without a match")
    assert took < 0.25 and m.match(entries[77][1][:-1]) in {e[0] for e in entries if e[1] == entries[77][1]} | {0}


def test_words_beside_strangers_tell_nothing(spark):
    entries = spark.createDataFrame([(1, "bank", "Lotus Farm Credit", "Lotus Farm Credit", None, None), (2, "bank", "Serapia", "Serapia", None, None)], SCHEMA)
    values = spark.createDataFrame([("bank", v) for v in ("Koutibidi Credit", "Finoulani Credit", "Ventosa Credit", "Lotus Farm Crdt", "Serapia Bank", "Lotus Credit")], "field string, value string")
    assert {r["value"]: r["canon_id"] for r in matched(values, entries).collect()} == {"Koutibidi Credit": 0, "Finoulani Credit": 0, "Ventosa Credit": 0, "Lotus Farm Crdt": 1, "Serapia Bank": 2, "Lotus Credit": 1}


def test_distances():
    assert edits("abcd", "abdc") == 1 and edits("", "ab") == 2 and edits("kitten", "sitting") == 3
    assert token_similarity("natl", "national") > 0.7 and token_similarity("post", "pharoslight") == 0


def test_tables(spark):
    entries = spark.createDataFrame([(*e, "x") for e in ENTRIES] + [(None, "bank", "Nobody", None, None, None, None), (9, None, None, None, None, None, None)], SCHEMA + ", FIELD string")
    long = "delta " * 50_000
    parties = spark.createDataFrame([("r1", "sender", "dhb", "a"), ("r1", "receiver", "Delta Horizon Bank", "b"), ("r2", "sender", None, None), ("r3", None, "  ", None), (None, "sender", "??", None), ("r4", "sender", long, None), ("r1", "sender", "dhb", "a")], "receipt_id string, side string, bank string, canon_id string")
    receipts = spark.createDataFrame([("r1", "EGP", "nahr"), ("r2", "usd", None), (None, None, None)], "receipt_id string, currency string, provider string")
    got = [tuple(r) for r in matched(entered_values(parties, receipts, entries), entries).select("receipt_id", "side", "field", "canon_id").collect()]
    assert sorted(got, key=str) == sorted([("r1", "sender", "bank", 1)] * 2 + [(None, "sender", "bank", 0), ("r4", "sender", "bank", 0), ("r1", "-", "provider", 7), ("r2", "-", "currency", 6)], key=str)
    none = matched(entered_values(parties.limit(0), receipts.limit(0), entries.limit(0)), entries.limit(0))
    assert none.count() == 0
