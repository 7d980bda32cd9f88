import hashlib
import re

from edgetide.llm import feistel as f

TEXTS = [
    "call +1 (017) 555-7713 or +1-017-555-7713 now", "4111 1111 1111 1111, 4111111111111111; not 4111111111111112",
    "DE89 3704 0044 0532 0130 00 and DE89370400440532013000, not DE88370400440532013000", "ip 192.168.1.77, no ip 999.1.1.1",
    "1984-02-29 29.02.1984 31.02.1984 05/11/2001 1850-01-01", "123-45-6789 000-12-1234",
    'key "681c09b8e90e7e8c9575180f595f646cf2969054" und.34@mail7.example.com, A.b-C+d@x.org', "", None, "plain text only",
    "ééß20@mail9.example.com", "tail +1 (702) 555-0742",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, found string, _cut int")


def run(spark, texts, **kw):
    return [r.text for r in f.pseudonymise(docs(spark, texts), "secret", **kw).orderBy("doc_id").collect()]


def network(kind, digits, radixes, key):
    """The network in plain Python."""
    state, half = list(digits), len(digits) // 2
    for step in range(f.ROUNDS):
        first = step % 2 == 0
        other = state[half:] if first else state[:half]
        seed = "|".join([key, kind, str(step), ",".join(map(str, radixes)), ",".join(map(str, other))])
        drawn = "".join(hashlib.sha512(f"{seed}|{b}".encode()).hexdigest() for b in range(4))
        for i in range(len(state)):
            if (i < half) == first:
                at = i if first else i - half
                state[i] = (state[i] + int(drawn[8 * at:8 * at + 8], 16) % radixes[i]) % radixes[i]
    return state


def test_round_trip_formats_and_links(spark):
    got = run(spark, TEXTS)
    assert run(spark, got, undo=True) == TEXTS
    for text, new in zip(TEXTS, got):
        assert text is None and new is None or re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", text))) == re.sub(
            r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", new))) or "ip" in text
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+[\d ()\-]+\d", got[0])]
    assert digits[0] == digits[1] and "555-7713" not in got[0]
    assert got[1].endswith("not 4111111111111112") and re.sub(r" ", "", got[1][:19]) == got[1][21:37]
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(got[1][21:37])) % 10 == 0
    iban = got[2].split(" and ")[1][:22]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "999.1.1.1" in got[3] and "192.168.1.77" not in got[3]
    assert "31.02.1984" in got[4] and "1850-01-01" in got[4] and "1984-02-29" not in got[4]
    assert "000-12-1234" in got[5] and got[7] == "" and got[9] == TEXTS[9]
    year, month, day = got[4][:10].split("-")
    assert got[4][11:21] == f"{day}.{month}.{year}"


def test_equals_the_network_in_python(spark):
    got = run(spark, ["ip 10.20.30.40", "card 4111111111111111"])
    assert got[0] == "ip " + ".".join(map(str, network("ipv4", [10, 20, 30, 40], [256] * 4, "secret")))
    body = network("card", [int(c) for c in "411111111111111"], [10] * 15, "secret")
    assert got[1].startswith("card " + "".join(map(str, body)))


def test_found_values_extra_columns_and_empty_table(spark):
    rows = f.pseudonymise(docs(spark, TEXTS), "secret").orderBy("doc_id").collect()
    assert [sorted({x.kind for x in r.found}) for r in rows] == [
        ["phone"], ["card"], ["iban"], ["ipv4"], ["date"], ["ssn"], ["email", "secret"], [], [], [], ["email"], ["phone"]]
    assert all(r._cut == 2 for r in rows)
    assert f.pseudonymise(docs(spark, TEXTS).limit(0), "secret").count() == 0


def test_another_key_gives_other_pseudonyms_and_repeats_agree(spark):
    twice = docs(spark, [TEXTS[0], TEXTS[0]])
    one = [r.text for r in f.pseudonymise(twice, "a").collect()]
    other = [r.text for r in f.pseudonymise(twice, "b").collect()]
    assert one[0] == one[1] != other[0] == other[1]


def test_long_text_with_many_values(spark):
    text = " ".join(f"word{i} {i % 256}.2.3.4 x{i}@mail.example.com" for i in range(3000))
    got = run(spark, [text])
    assert run(spark, got, undo=True) == [text] and len(got[0].split()) == len(text.split())


def test_addresses_with_letters_beyond_ascii_are_linked(spark):
    got = run(spark, ["müller@ex.de and jané@ex.com", "müller@ex.de", "иван@пример.рф", "no @ here, nor a@b or x@y.z"])
    assert got[0].split()[0] == got[1] != "müller@ex.de" and got[1][1] == "ü" and got[1].endswith("@ex.de")
    assert "jan" not in got[0] and got[2] == "иван@пример.рф" and got[3] == "no @ here, nor a@b or x@y.z"
    assert run(spark, got, undo=True)[:2] == ["müller@ex.de and jané@ex.com", "müller@ex.de"]


def test_long_repetitions_of_every_group_do_not_crash(spark):
    texts = ["a@" + "b." * 1_000_000 + "com", "x@" + "b-" * 500_000 + ".org", "+1" + " 555" * 300_000, "DE89" + " 3704" * 300_000,
             "1 " * 1_000_000, "1.2." * 300_000, "a1" * 500_000, "1-" * 1_000_000, "é" * 1_000_000 + "@ex.de"]
    got = run(spark, texts)
    assert [len(x) for x in got] == [len(x) for x in texts]
    assert got[0] == texts[0] and got[1].endswith(".org") and got[1] != texts[1]
