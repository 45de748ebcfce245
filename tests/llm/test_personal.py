"""Personal data: fixed forms against the plain expressions, learned patterns against a plain reading of the rules."""

import hashlib
import random
import re

from talktable.llm import personal, queries

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, d in enumerate(reversed(digits)):
        d = int(d) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    spans = []
    for rank, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def base_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["_key"], []).append([tuple(s) for s in r["base"]])
    return got


def test_base_forms_on_random_text(make):
    rng = random.Random(2)
    bits = ["a@b.c", "x.y%z@host-1.co.uk", "@", ".", "..", " ", " ", "-", "+", "+1 (555) 010-2030", "+49.30.123456", "999.1.1.1.1", "10.0.0.1", "010.020.255.255",
            "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "1", "23", "é", "😀", "word", "_", "(", ")", "\n",
            "a@b.c_d@e.f", "a@b@c.d", "1.2", "5", "+1", "+", "37828224631000512345"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(1500)]
    got = base_of(personal.find_personal_data(make(rows)))
    assert got == {i: [plain_base(t)] for i, t in rows}
    assert sum(len(s[0]) for s in got.values()) > 2000


def test_places_of_many_matches(make):
    text = "".join(f"é{i} at 10.0.{i % 256}.{i % 99} or u{i}@h{i}.io " for i in range(3000))
    assert base_of(personal.find_personal_data(make([(1, text)]))) == {1: [plain_base(text)]}


def test_long_texts_take_linear_time(make):
    rows = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "a." * 150_000), (4, "1 " * 150_000), (5, "a@" + "b." * 150_000), (6, "+1" + " ." * 150_000),
            (7, "ab:" * 100_000), (8, "(at)" * 80_000), (9, "1." * 150_000)]
    got = base_of(personal.find_personal_data(make(rows)))
    assert {i: s[0] for i, s in got.items() if s != [[]]} == {5: [("email", 0, 2 + 299_999)], 9: plain_base(rows[-1][1])}


SEEDS = [f"contact {n} at the office or mail to {n}@firm{n}.com please" for n in ("ann", "bob", "cid", "dee", "eli", "flo")]


def test_words_before_known_identifiers_find_unknown_ones(make):
    rows = list(enumerate(SEEDS)) + [
        (10, "you can mail to eve(at)corp dot com or mail to fay@localhost today"),
        (11, "fay@localhost again, and gus@localhost after other words"),
        (12, "call us +1 (555) 010-2030"), (13, "call us +1 (555) 010-2031"), (14, "call us +1 (555) 010-2032"), (15, "call us (555) 010-2033 now"),
        (16, "build 20240101123 went out, 555 010 2034 too"),
    ]
    found = {r["_key"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in personal.find_personal_data(make(rows)).collect()}
    text = dict(rows)
    said = {i: [(k, text[i][s:e]) for k, s, e in spans] for i, spans in found.items()}
    assert said[10] == [("email", "eve(at)corp"), ("email", "fay@localhost")]
    assert said[11] == [("email", "fay@localhost")]
    assert said[15] == [("phone", "(555) 010-2033")]
    assert said[16] == []
    assert all(found[i] == plain_base(text[i]) for i in (0, 1, 2, 3, 4, 5, 12, 13, 14))


def test_words_that_mostly_precede_other_words_teach_nothing(make):
    rows = list(enumerate(SEEDS)) + [(10, "mail to hal@localhost"), (11, "we mail to our readers, mail to friends, mail to all, mail to some, mail to none")]
    spans = {r["_key"]: r["spans"] for r in personal.find_personal_data(make(rows)).collect()}
    assert spans[10] == [] and spans[11] == []


def test_names_found_in_one_round_teach_patterns_for_the_next(make):
    rows = list(enumerate(SEEDS)) + [(10 + i, f"mail to p{i}@lan and ping q p{i}@lan") for i in range(3)] + [(20, "ping q z@lan")]
    text, found = dict(rows), {}
    for rounds in (1, 4):
        got = personal.find_personal_data(make(rows), rounds=rounds).where("_key = 20").first()["spans"]
        found[rounds] = [text[20][s["start"]:s["end"]] for s in got]
    assert found == {1: [], 4: ["z@lan"]}


def test_odd_rows_and_clashing_columns(make):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a@b.c"), (4, "a@b.c"), (4, "x 10.1.1.1"), (4, "a@b.c")]
    docs = make(rows, extra=["_key", "base", "spans", "_text", "kind", "_row"])
    got = base_of(personal.find_personal_data(docs))
    assert got[1] == got[2] == got[3] == [[]] and got[None] == [[("email", 0, 5)]]
    assert sorted(got[4]) == [[("email", 0, 5)], [("email", 0, 5)], [("ip", 2, 10)]]
    assert personal.find_personal_data(make([])).count() == 0


def test_query(spark, tmp_path, make):
    rows = list(enumerate(SEEDS)) + [(10, "mail to fay@localhost and 10.0.0.1"), (11, None), (12, "+49 30 1234567 4111 1111 1111 1111")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_personal(spark, str(tmp_path)).collect()}
    for i, text in rows:
        base = plain_base(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in FORMS] == [sum(b[0] == k for b in base) for k in FORMS]
        assert got[i]["spans"] == (listed if i != 10 else "email:8:21," + listed)
