from planwise.llm import pii


def test_surrogates_never_run_out(spark):
    values = [("email", f"{c}@a1.example.com") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    values += [("secret", f"_______{d}") for d in range(10)] + [("email", "ա@բ.com"), ("email", "_@գ.com")]
    firsts = spark.createDataFrame([(k, v, pii.surrogate(b"", k, v)) for k, v in values], "kind string, value string, new string")
    settled = {(r["kind"], r["value"]): r["new"] for r in pii.settle(firsts, b"").collect()}
    final = {(k, v): settled.get((k, v), pii.surrogate(b"", k, v)) for k, v in values}
    assert len(set(final.values())) == len(values) and not set(final.values()) & {v for _, v in values}


def test_names_have_more_room_with_each_attempt():
    names = [f"α{i}" for i in range(30_000)]
    assert len({pii.surrogate(b"", "given-n", v, 12) for v in names}) > 29_900 > 13_824


def test_full_ranges_go_on_elsewhere():
    assert pii.surrogate(b"", "ip", "192.168.1.7", 20).startswith("2001:db8:")
    assert len({pii.surrogate(b"", "ssn", f"{v:09}", 8) for v in range(2000)}) == 2000
    long_card = pii.surrogate(b"", "card", "4539578763621486", 8)
    assert len(long_card) == 18 and pii.luhn(long_card) == 0


def test_values_without_letters_or_digits_are_no_entities(spark):
    text = "Password: ________ token = -------- Secret:\n=========="
    assert pii.detect(text) == []
    row = pii.anonymize(spark.createDataFrame([(text,)], "text string")).first()
    assert row["text"] == text and row["_entities"] == []


def test_a_longer_phone_keeps_all_its_digits():
    new = pii.surrogate(b"", "phone", "4565552186", 8)
    assert len(new) == 12 and "".join(c for c in pii.in_form("phone", "(456) 555-2186", new) if c.isdigit()) == new
