import pytest

from qirtas.llm import pii as P


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("receipt to nabil_2@my-shop.example pls", ["email"]), ("cc a+pay@uni.edu.example; sh836 @mail.example", ["email", "email"]), ("nagwa.ramy (at) uni.edu.example", ["email"]), ("z23+pay[at]mail[dot]example", ["email"]),
        ("hanan46@nahr", []), ("@pyrapay handle only", []), ("email receipt please", []), ("call me on 011-0007-5526 when", ["phone"]), ("+20 10 0006 7939", ["phone"]), ("(+20) 12000 77544", ["phone"]), ("٠١١٠٠٠٨٠٩٦٧", ["phone"]), ("office 0221234567", ["phone"]), ("office 02-2123-4567", ["phone"]), ("or 415-555-2671 abroad", ["phone"]), ("X (AT) HOST.COM", ["email"]), ("behind ميدان القنديل", ["address"]), ("ref 4155552671", []), ("2026-08-25", []),
        ("00201100065204", ["phone"]), ("hotline 19999 for help", []), ("meter 123456789012", []), ("order #94797274 thanks", []), ("ID no. 29106209408981 copy", ["id_number"]), ("passport 2-910620-9408981 fee", ["id_number"]),
        ("my ID is 3 020912 93 7214 8, needed", ["id_number"]), ("passport M18495989", ["id_number"]), ("29913409408981", []), ("IP-850755605961", []), ("room 12 floor 3", []), ("deposit for flat hunting", []), ("street food ticket", []),
        ("deliver to 130 Marjan St., Ezbet Noor, phone 01100043347", ["address", "phone"]), ("rent for Flat 10, 99 El Rayhan St., 9th floor", ["address"]), ("العنوان 70 شارع الزهراء، عزبة نور", ["address"]), ("شقة 21 عمارة 174 ش. القنديل باب الريح", ["address"]),
        ("Bldg 127, Sawaqi Square, Bab el Rih 11772", ["address"]), ("", []), ("2026-08-25 03:44:04", []), ("8,192.50 EGP", []),
    ],
)
def test_forms(text, kinds):
    assert [k for _, _, k in P.spans(text)] == kinds


def test_forms_are_linear():
    for t in ("flat 1, " * 20_000, "1 " * 50_000, "a@b" * 30_000, "شارع " * 20_000):
        P.name_words(t, P.spans(t))


SCHEMA = "receipt_id string, text_lines array<string>, tokens array<struct<text:string,line:int,role:string>>, ROLE string"


def analyses(spark):
    data = []
    for k in range(6):
        data.append((f"r{k}", ["LotusPay", "From Amira Gamal", f"To Dina Salah {'x' * (k == 5) * 10}"], [("LotusPay", 0, "provider"), ("From", 1, "label"), ("Amira Gamal", 1, "sender.name"), ("To", 2, "label"), ("Dina Salah", 2, "receiver.name"), ("Delta Bank", 3, "sender.bank"), ("monthly rent", 3, "status")], "x"))
    data += [
        ("n1", ["shop", "Dear Amira, thanks", "Ezbet Dina 5", None, "", "Dina Bakery Co", "A**** D****", "ask Salah on 01000011122"], None, None),
        ("n2", None, [("", None, None), (None, 1, None), ("Gamal 01000011122", 1, "")], None), ("n3", [], [], None), (None, None, None, None), ("n4", ["a", "word " * 50_000 + "Amira"], None, None),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize(
    "text,told,want",
    [
        ("ک۱۲ then ﬁne a@b.example, ０1000011122 e\u0301\u200b Amira\u200b!", {"amira"}, "ک۱۲ then ﬁne [EMAIL], [PHONE] e\u0301\u200b [NAME]!"), ("٠١٠٠٠٠١١١٢٢ ک", set(), "[PHONE] ک"), ("ﬁ ﬁ Amira", {"amira"}, "ﬁ ﬁ [NAME]"), ("nothing ک۱۲", {"amira"}, "nothing ک۱۲"),
        ("call 51 Zahrat Road, Nozhara, phone 01200058450", set(), "call [ADDRESS], phone [PHONE]"), ("Amira Gamal and Dina", {"amira", "gamal", "dina"}, "[NAME] and [NAME]"), ("", set(), ""),
    ],
)
def test_text_between_placeholders_is_unchanged(text, told, want):
    assert P.replaced(text, told, {"nozhara"}) == want


def test_offsets_lead_back_to_the_text():
    for text in ("abc", "e\u0301a", "ﬁne ک", "\u200bab\u200bc", "Ａ１ x", "ق\u064fل"):
        shown = P.plain(text)
        at = P.offsets(text, shown)
        assert len(at) == len(shown) + 1 and at == sorted(at) and at[-1] == len(text)


def test_places_are_learnt_behind_addresses(spark):
    rows = [(f"r{k}", None, [(f"deliver to {k + 3} Zahrat Road, Warda phone 0100001112{k}", 1, "")]) for k in range(5)] + [("q", None, [("51 Zahrat Road, Warda", 0, ""), ("phone me", 1, "")])]
    df = spark.createDataFrame(rows, "receipt_id string, text_lines array<string>, tokens array<struct<text:string,line:int,role:string>>")
    clean = {(r["receipt_id"], r["pos"]): r["sanitised"] for r in P.sanitised(df).collect()}
    assert clean["r0", 0] == "deliver to [ADDRESS] phone [PHONE]" and clean["q", 0] == "[ADDRESS]" and clean["q", 1] == "phone me"


def test_table(spark):
    df = analyses(spark)
    got = {tuple(r) for r in P.found_types(df).collect() if r["receipt_id"] is None or r["receipt_id"].startswith("n")}
    assert got == {("n1", "text_lines", 1, "person_name"), ("n1", "text_lines", 7, "person_name"), ("n1", "text_lines", 7, "phone"), ("n2", "tokens", 2, "phone"), ("n2", "tokens", 2, "person_name"), ("n4", "text_lines", 1, "person_name")}
    clean = {(r["receipt_id"], r["field"], r["pos"]): r["sanitised"] for r in P.sanitised(df).collect()}
    assert clean["n1", "text_lines", 1] == "Dear [NAME], thanks"
    assert clean["n1", "text_lines", 7] == "ask [NAME] on [PHONE]"
    assert clean["n1", "text_lines", 5] == "Dina Bakery Co"
    assert clean["r0", "tokens", 2] == "[NAME]"
    assert clean["n1", "text_lines", 4] == ""
    assert P.found_types(df.limit(0)).count() == 0
    left = {r["field"]: r for r in P.disclosure(df).collect()}
    assert left["tokens"]["disclosing"] == 13 and left["tokens"]["bits_before"] > left["tokens"]["bits_after"] >= 0
