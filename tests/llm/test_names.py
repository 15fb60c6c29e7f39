import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from qirtas.llm import names as N

CANON = {"nabil": "نبيل", "نبيل": "نبيل", "nabl": "نبيل", "mahmoud": "محمود", "محمود": "محمود", "dina": "دينا", "dody": "دينا", "bakery": "مخبز", "مخبز": "مخبز", "eelctronics": "electronics", "comapny": ""}
TRADES = {"مخبز", "electronics"}
INITIALS = {"نبيل": "n", "محمود": "m", "دينا": "d"}


def read(name):
    ws = [w for w in N.words(name)]
    kept = [w for w in ws if w not in N._LEGAL]
    return N.read([(w, CANON.get(w), CANON.get(w) in TRADES, INITIALS.get(CANON.get(w))) for w in kept], len(kept) < len(ws))


@pytest.mark.parametrize(
    "name,want",
    [
        ("Nabil Mahmoud Dafasawi", ("P", "dafasaui", [], [("نبيل", "n"), ("محمود", "m")])), ("DAFASAWY, NABIL M.", ("P", "dafasaui", [], [("نبيل", "n"), ("m.", "m")])), ("نبيل محمود دافاساوي", ("P", "dafasaui", [], [("نبيل", "n"), ("محمود", "m")])),
        ("Dr. Nabl-Mahmoud El Dafasawi", ("P", "dafasaui", [], [("نبيل", "n"), ("محمود", "m")])), ("ElDafasawi Dody", ("P", "dafasaui", [], [("دينا", "d")])), ("El Dafasawi Bakery Comapny", ("O", "dafasaui", ["مخبز"], [])),
        ("شركة مخبز الدافاساوي", ("O", "dafasaui", ["مخبز"], [])), ("Dafasawi Eelctronics", ("O", "dafasaui", ["electronics"], [])), ("Dafasawi Group", ("O", "dafasaui", [], [])), ("Group", None), ("", None), ("N. M.", None),
    ],
)
def test_read(name, want):
    assert read(name) == want


def test_sounds_are_the_same_in_both_scripts():
    for latin, arabic in (("Timgalawi", "تيمجالاوي"), ("Dousgafein", "دوسجافين"), ("Qilgimawy", "قيلجيماوي"), ("Khiskhafein", "خيسخافين")):
        assert N.sounds(latin.lower()) == N.sounds(arabic)


def test_further_names(spark):
    ini = {"محمود": "m", "فاروق": "f", "حسن": "h"}
    one = lambda names: [(n, ini.get(n, n[0])) for n in names]
    cases = [([], [], 1.0), ([], ["محمود"], 0.7), (["محمود"], ["m."], 0.75), (["فاروق"], ["m."], 0.0), (["محمود"], ["فاروق"], 0.0), (["m."], ["m."], 0.85), (["محمود"], ["محمود", "حسن"], 0.9), (["حسن"], ["محمود", "حسن"], 0.65), (["محمود", "حسن"], ["محمود", "فاروق"], 0.0)]
    kind = "array<struct<name:string,ini:string>>"
    df = spark.createDataFrame([(k, one(a), one(b)) for k, (a, b, _) in enumerate(cases)], f"k int, a {kind}, b {kind}")
    for a, b in (("a", "b"), ("b", "a")):
        assert [round(r[0], 6) for r in df.orderBy("k").select(N._further(F.col(a), F.col(b))).collect()] == [w for _, _, w in cases]


def test_average_linkage_equals_merging_one_by_one(spark):
    rnd = random.Random(5)
    rows = {k: rnd.choice([1, 1, 2, 5]) for k in range(60)}
    sims = {}
    for block in range(6):
        own = range(block * 10, block * 10 + 10)
        for a, b in combinations(own, 2):
            if rnd.random() < 0.6:
                sims[a, b] = round(rnd.uniform(0.2, 1.0), 6)
    groups = {k: [k] for k in rows}
    mean = lambda g, h: sum(sims.get((min(a, b), max(a, b)), 0) * rows[a] * rows[b] for a in groups[g] for b in groups[h]) / (sum(rows[a] for a in groups[g]) * sum(rows[b] for b in groups[h]))
    while True:
        score, g, h = max((mean(g, h), g, h) for g, h in combinations(groups, 2))
        if score < N.LINK:
            break
        groups[g] += groups.pop(h)
    items = spark.createDataFrame(list(rows.items()), "item bigint, rows bigint")
    found: dict[int, list[int]] = {}
    for r in N.average_linkage(items, spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a bigint, b bigint, s double")).collect():
        found.setdefault(r["cluster"], []).append(r["item"])
    linked = {k for own in groups.values() if len(own) > 1 for k in own}
    assert {frozenset(v) for v in found.values() if len(v) > 1} == {frozenset(v) for v in groups.values() if len(v) > 1} and linked
    assert N.average_linkage(items, spark.createDataFrame([], "a bigint, b bigint, s double")).count() == 0


def test_cosine_join_is_exact(spark):
    rnd = random.Random(3)
    keys = ["dusgafin", "dusgfin", "dusgafni", "timgalaui", "tingalaui", "karSusaui", "karSuSaui", "ab", "zzzz", "x" * 300]
    keys += sorted({"".join(rnd.choice(["ba", "gi", "su", "ra"]) for _ in range(3)) + rnd.choice(["aui", "in"]) for _ in range(60)})
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, n bigint")
    vec = {}
    for r in N.gram_vectors(df).collect():
        vec.setdefault(r["key"], {})[r["gram"]] = r["weight"]
    edits = {(r["a"], r["b"]): r["edits"] for r in N.cosine_pairs(df).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(keys, 2) if sum(w * vec.get(b, {}).get(g, 0) for g, w in vec.get(a, {}).items()) >= N.KEY_COSINE and N.near_equal(a, b, N.KEY_EDITS)}
    assert edits["dusgafin", "dusgfin"] == edits["dusgafin", "dusgafni"] == 1 and set(edits) == want and ("dusgafin", "dusgfin") in want and len(want) > 50


PEOPLE = {
    1: ["Nabil Mahmoud Dafasawi", "Nabeel Mahmud Dafasawy", "DAFASAWI, NABIL M.", "Nabil Mahmoud Dafaswai"],
    2: ["Nabil Farouk Dafasawi", "nabil farouq dafasawi"],
    3: ["Dina Gamal Dimouhawi", "Deena Jamal Dimuhawi", "Dody Gamal Dimouhawi"],
    4: ["El Bishouqein Bakery", "Al Bishuqein Bakery Co"],
    5: ["El Bishouqein Trading", "BISHOUQEIN TRADING LLC", "Bishouqein Tradding LLC"],
    6: ["Karim Gamal Dimouhawi"],
    7: ["Noumlawi Bakery Co"], 8: ["Gasfahein Trading Co", "شركة الجاسفاحين للتجارة"], 9: ["Rarrishein Bakery LLC"], 10: ["Sadazein Trading Ltd"],
}
ALT = {"Nabil Mahmoud Dafasawi": "نبيل محمود دافاساوي", "Nabeel Mahmud Dafasawy": "نبيل محمود دافاساوي", "nabil farouq dafasawi": "نبيل فاروق دافاساوي", "Nabil Farouk Dafasawi": "نبيل فاروق دافاساوي", "Dina Gamal Dimouhawi": "دينا جمال ديموحاوي", "Deena Jamal Dimuhawi": "دينا جمال ديموحاوي", "Dody Gamal Dimouhawi": "دينا جمال ديموحاوي", "Karim Gamal Dimouhawi": "كريم جمال ديموحاوي", "Gasfahein Trading Co": "الجاسفاحين للتجارة", "Sadazein Trading Ltd": "السادازين للتجارة", "El Bishouqein Trading": "البيشوقين للتجارة"}


def test_table(spark):
    data, entity = [], {}
    for e, variants in PEOPLE.items():
        for v in variants:
            # spellings are counted in distinct names: a title makes another one of it
            for shown in (v, v, f"Mr. {v}"):
                entity[len(data)] = e
                data.append((len(data), shown, ALT.get(v), "x"))
    n = len(data)
    data += [(n, None, None, None), (n + 1, "  ", "x", None), (n + 2, "A**** D****", None, None), (None, "Nabil Mahmoud Dafasawi", None, None), (n + 3, "y" * 100_000, "z" * 100_000, None), (n + 4, "؟", None, None), (n + 5, "Nabil Mahmoud Dafasawi " + "x" * 400, None, None)]
    df = spark.createDataFrame(data, "party_id bigint, name string, name_alt string, NAME string")
    got = {tuple(r) for r in N.pairs(N.linked(df)).collect()}
    want = {(a, b) for a, b in combinations(range(n), 2) if entity[a] == entity[b] and data[a][1] != data[b][1]}
    assert {p for p in got if max(p) < n} == want
    assert N.pairs(N.linked(df.limit(0))).count() == 0


@pytest.mark.parametrize("copies", [1, 4])
def test_recurring_misspellings_of_a_frequent_family(spark, copies):
    arabic = {"Nabil": "نبيل", "Dina": "دينا", "Karim": "كريم", "Mahmoud": "محمود", "Gamal": "جمال", "Farouk": "فاروق"}
    people = [(g, f) for g in ("Nabil", "Dina", "Karim") for f in ("Mahmoud", "Gamal", "Farouk")]
    forms = ["{} {} Dafasawi", "Dafasawi, {} {}", "{} {} DAFASAWI", "Dafasawi {} {}"]
    data, person = [], []
    for _ in range(copies):
        for who, (g, f) in enumerate(people):
            rows = [(x.format(g, f), f"{arabic[g]} {arabic[f]} دافاساوي") for x in forms] + ([(f"{g} {f} Dafatsawi", None)] if who < 6 else [])
            for row in rows:
                data.append((len(data), *row))
                person.append(who)
    links = N.linked(spark.createDataFrame(data, "party_id bigint, name string, name_alt string"))
    entity = {r["party_id"]: r["entity"] for r in links.collect()}
    assert all((entity[a] == entity[b]) == (person[a] == person[b]) for a, b in combinations(range(len(data)), 2))


def test_repeated_rows_change_nothing(spark):
    """Every row five times: the links between the rows of one copy stay the same."""
    parties = spark.read.parquet("/root/testdata/sf0.001/parties.parquet")
    times = parties.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("party_id", F.col("party_id") * 5 + F.col("copy"))
    one = {tuple(r) for r in N.pairs(N.linked(parties)).collect()}
    links = N.linked(times).where("party_id % 5 = 0").withColumn("party_id", F.expr("party_id div 5"))
    assert {tuple(r) for r in N.pairs(links).collect()} == one and len(one) > 100


def test_pairs_of_a_large_entity(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIR_BLOCK", 7)
    links = spark.range(40).select(F.col("id").alias("party_id"), (F.col("id") % 6).cast("string").alias("name"), F.when(F.col("id") < 30, 0).otherwise(1).cast("bigint").alias("entity"))
    want = {(a, b) for a, b in combinations(range(40), 2) if (a < 30) == (b < 30) and a % 6 != b % 6}
    got = [tuple(r) for r in N.pairs(links).collect()]
    assert set(got) == want and len(got) == len(want)
