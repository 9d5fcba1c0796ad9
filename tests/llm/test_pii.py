import pytest

from evidlake.llm.pii import Names, find_pii, mask_columns, masked, pii_mentions


@pytest.mark.parametrize(
    "text,want",
    [
        ("Contact: mailto:Ann.B+kb@example.org.", [("email", "Ann.B+kb@example.org")]),
        ("user=ann_b(at)post.example took=1", [("email", "ann_b(at)post.example")]),
        ("mail ann [at] post [dot] example now", [("email", "ann [at] post [dot] example")]),
        ("Ask Ann.B at dept dot example dot com As ever", [("email", "Ann.B at dept dot example dot com")]),
        ("Clone git@forge.invalid:x.git, pin left-join@3.4.1, --user @me, @retry.on_error", []),
        ("call +33 1 99 00 62 29, (617) 555-0171 or 030/23125-602", [("phone", "+33 1 99 00 62 29"), ("phone", "(617) 555-0171"), ("phone", "030/23125-602")]),
        ("tel:+14155550187 and 0033 1 99000094; 020 7946 0632.", [("phone", "+14155550187"), ("phone", "0033 1 99000094"), ("phone", "020 7946 0632")]),
        ("Offset 020 7946 bytes, checksum 5550-1299-8841, 2025-04-02, 10.2.0.0/16, v12.5.2025", []),
        ("SSN 944-08-2215 and social security no. 952 70 6138", [("id_number", "944-08-2215"), ("id_number", "952 70 6138")]),
        ("passport C34285684, NI number QQ 40 31 70 A. The tax id 00 642 517 924", [("id_number", "C34285684"), ("id_number", "QQ 40 31 70 A"), ("id_number", "00 642 517 924")]),
        ("driving licence HASTW463884ZZ9; DNI 69793655T", [("id_number", "HASTW463884ZZ9"), ("id_number", "69793655T")]),
        ("Trace id 484732-77-5454, part no. 26357-29-4601", []),
        ("to Flat 6, 140 Windmere Blvd, Dunholm. Next", [("address", "Flat 6, 140 Windmere Blvd, Dunholm")]),
        ("at 107 rue Quarry, 24359 Pinhaven; Tannerweg 18, 67626 Ostermoor; P.O. Box 322, Norvale.", [("address", "107 rue Quarry, 24359 Pinhaven"), ("address", "Tannerweg 18, 67626 Ostermoor"), ("address", "P.O. Box 322, Norvale")]),
        ("The Street table maps Lane 25 to Road type 48; Main Loop 7 and Fast Lane 5", []),
        ("Mr Anna J. Brinander met Dr. Quenumbra, Elena and P. HULETTE", [("person", "Anna J. Brinander"), ("person", "Quenumbra, Elena"), ("person", "P. HULETTE")]),
        ("Blue Harbor, the Release Captain; Brinander alone; Anna alone; brinander.anna@example.org", [("email", "brinander.anna@example.org")]),
        ("Ask John Smith or Margaret A. Thompson-Reid; Dr. Priya Natarajan, Prof. Xiu Li and Mrs O. Adeyemi agreed.", [("person", "John Smith"), ("person", "Margaret A. Thompson-Reid"), ("person", "Priya Natarajan"), ("person", "Xiu Li"), ("person", "O. Adeyemi")]),
        ("Dear Wei Zhang,\nthe build is red. Regards,\nAgnieszka Nowak", [("person", "Wei Zhang"), ("person", "Agnieszka Nowak")]),
        ("Dear Team Leads, Daniel The Great; Dr. Smith; Mr Robot; john smith; Release Captain Blue Harbor", []),
        ("IBAN DE89 3704 0044 0532 0130 00, not IBAN DE89 3704 0044 0532 0130 01", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("tel:(617) 555-0171 mailto:a@b.example", [("phone", "(617) 555-0171"), ("email", "a@b.example")]),
        ("passport" + " " * 300 + "C34285684", [("id_number", "C34285684")]),
        ("x" * 65 + "@b.example, " + "y" * 64 + "@" + "sub." * 40 + "example", [("email", "y" * 64 + "@" + "sub." * 40 + "example")]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    assert [(k, text[a:b]) for a, b, k in find_pii(text)] == want


def test_long_and_odd_texts():
    assert find_pii("@" * 50_000) == []
    assert find_pii("İ" * 10 + " SSN 944-08-2215") == [(15, 26, "id_number")]
    text = "mail a@b.example " * 5000
    assert len(find_pii(text)) == 5000
    assert masked(text) == "mail [EMAIL] " * 5000
    assert masked("x\r\n​SSN 944-08-2215!") == "x\r\n​SSN [ID_NUMBER]!"


def test_other_names():
    names = Names(given=("Zed",), surnames=("O'Quux",))
    assert [(k, "Zed O'Quux met z. o'quux; Anna Brinander"[a:b]) for a, b, k in find_pii("Zed O'Quux met z. o'quux; Anna Brinander", names)] == [("person", "Zed O'Quux")]
    assert masked("ask O'QUUX, Zed", names) == "ask [PERSON]"


def test_tables(spark):
    df = spark.createDataFrame([("a", "mail x@y.example", None, 1), ("a", "mail x@y.example", None, 1), (None, None, "by Anna Brinander", None)], "id string, content string, summary string, mention int")
    got = pii_mentions(df, "id", ["content", "summary"]).distinct().collect()
    assert sorted((str(r.id), r.field_name, r.pii_type, r.start_pos, r.end_pos) for r in got) == [("None", "summary", "person", 4, 17), ("a", "content", "email", 6, 16)]
    out = mask_columns(df, ["content", "summary"])
    assert out.columns == df.columns
    assert {(r.content, r.summary, r.mention) for r in out.collect()} == {("mail [EMAIL]", None, 1), (None, "by [PERSON]", None)}
    assert pii_mentions(df.limit(0), "id", ["content"]).count() == 0
