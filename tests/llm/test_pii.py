import random
import re
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from clinisieve.llm import pii, queries
from clinisieve.sources.scratch import written
from tests.llm.cases import awkward, frame


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def card(rnd, n=16, first="4"):
    body = first + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def iban_rest(value):
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def iban(rnd, country="DE", n=18):
    body = "".join(rnd.choice("0123456789") for _ in range(n))
    return f"{country}{98 - iban_rest(country + '00' + body):02d}{body}"


def is_date(y, m, d):
    try:
        return 1904 <= date(y, m, d).year <= 2099
    except ValueError:
        return False


def valid(kind, v):
    """A plain check of the format and validity that each kind must keep."""
    digits = re.sub(r"\D", "", v)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and v[0] in "23456"
    if kind == "iban":
        return iban_rest(v) == 1
    if kind == "ip":
        return all(str(int(p)) == p and int(p) < 256 for p in v.split("."))
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        return 0 < a < 900 and a != 666 and g > 0 and s > 0
    if kind == "date":
        a, b, c = re.split("[-/.]", v)
        return is_date(int(a), int(b), int(c)) if len(a) == 4 else is_date(int(c), int(a), int(b)) or is_date(int(c), int(b), int(a))
    return True


SHAPE = lambda v: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v)))


def values(seed=1, n=40):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        day = date(1904, 1, 1) + timedelta(days=rnd.randrange(71589))
        out += [("card", card(rnd)), ("card", card(rnd, 15, "3")), ("iban", iban(rnd)), ("ip", ".".join(str(rnd.randrange(256)) for _ in range(4))),
                ("date", day.isoformat()), ("date", day.strftime("%d.%m.%Y")), ("date", day.strftime("%m/%d/%Y")), ("date", day.strftime("%d/%m/%Y")), ("date", day.strftime("%m-%d-%Y")),
                ("ssn", f"{rnd.choice([1, 5, 665, 667, 899, rnd.randrange(1, 600)]):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}"),
                ("phone", f"+1 ({rnd.randrange(1000):03d}) 555-{rnd.randrange(10000):04d}"), ("phone", f"+49{rnd.randrange(10**9, 10**10)}"), ("phone", "555-010-%04d" % rnd.randrange(10000)),
                ("email", f"ab{rnd.randrange(1000)}.X{rnd.choice('abc')}@mail{rnd.randrange(9)}.example.com"), ("token", "%040x" % rnd.getrandbits(160)), ("token", "%032X" % rnd.getrandbits(128))]
        c = card(rnd)
        out.append(("card", "-".join(c[i:i + 4] for i in range(0, 16, 4))))
    return out


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def run(spark, texts, **options):
    rows = pii.with_pseudonyms(docs_of(spark, texts), kinds="kinds", **options).collect()
    return {r.doc_id: (r.text, r.kinds) for r in rows}


def test_formats_are_kept_and_values_linked(spark):
    found = values()
    texts = [f"before {v} after, {v}." for _, v in found]
    got = run(spark, texts)
    images = {}
    for i, (kind, v) in enumerate(found):
        text, kinds = got[i]
        assert kinds == [kind, kind], (v, got[i])
        one, two = re.fullmatch(r"before (.*) after, (.*)\.", text).groups()
        assert one == two and valid(kind, one)
        assert kind == "ip" or kind == "token" or SHAPE(one) == SHAPE(v)
        images.setdefault((kind, v), set()).add(one)
    assert all(len(x) == 1 for x in images.values())
    by_kind = Counter((k, next(iter(x))) for (k, v), x in images.items())
    assert max(by_kind.values()) == 1  # different values, different pseudonyms
    same = sum(v in x for (_, v), x in images.items())
    assert same <= 1
    other = run(spark, texts, key="another")
    assert sum(other[i][0] == got[i][0] for i in got) <= 2


def test_turning_back(spark):
    texts = [f"{a} x {b}\n{a}" for (_, a), (_, b) in zip(values(2, 10), reversed(values(2, 10)))] + [r[1] for r in awkward()]
    once = run(spark, texts)
    back = run(spark, [once[i][0] for i in range(len(texts))], inverse=True)
    assert [back[i][0] for i in range(len(texts))] == texts


NOT_VALID = ["4111111111111112", "9807915762804490", "1234", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", "2021-02-29", "31.04.2020", "13/13/2000", "1899-01-01",
             "000-12-3456", "666-12-3456", "912-12-3456", "DE00123456789012345678", "00000000000000000000000000000000000000", "a@b", "12-34", "deadbeef",
             "X4111111111111111111111111111111", "v2.0", "3.14159", "", " ", "plain words only"]


def test_what_is_not_valid_stays(spark):
    texts = NOT_VALID + [f"a {text} b" for text in NOT_VALID]
    assert run(spark, texts) == {i: (text, []) for i, text in enumerate(texts)}


def test_small_domains_are_permuted(spark):
    days = [(date(1904, 1, 1) + timedelta(days=i)) for i in range(0, 71589, 31)]
    got = run(spark, [d.isoformat() for d in days])
    assert len({x[0] for x in got.values()}) == len(days)
    late = [d.replace(day=28).strftime("%d/%m/%Y") for d in days]
    got = run(spark, sorted(set(late)))
    assert len({x[0] for x in got.values()}) == len(set(late)) and all(int(x[0][:2]) > 12 for x in got.values())


def test_neighbours_and_edges(spark):
    rnd = random.Random(5)
    a, b = card(rnd), card(rnd)
    got = run(spark, [f"{a} {b}", f"{a}", f"x\n{a}\n", f"({a}),{b};10.0.0.1.", "+1 (017) 555-7713 224.228.19.86"])
    assert [len(got[i][1]) for i in range(5)] == [2, 1, 1, 3, 2]
    assert got[0][0].split()[0] == got[1][0]


def test_groups_of_four_and_values_after_a_phone(spark):
    rnd = random.Random(12)
    grouped = lambda v: " ".join(v[i:i + 4] for i in range(0, len(v), 4))
    a, b = grouped(card(rnd)), grouped(card(rnd, first="5"))
    ibans = [grouped(v) for v in ("DE89370400440532013000", iban(rnd), iban(rnd, "BE", 12), iban(rnd, "FR", 23), iban(rnd, "NO", 11), "GB82WEST12345698765432")]
    texts = ["+1 555 123 4567 4111 1111 1111 1111", f"call +1 555 123 4567 {a} {b}.", f"+44 20 7946 0958 {a}", "+1 555 123 4567 1234 12 34", f"+1 555 123 4567 {a.replace(' ', '')}"]
    kinds = [["phone", "card"], ["phone", "card", "card"], ["phone", "card"], ["phone"], ["phone", "card"]]
    texts += [f"to {v} THE bank, {v}." for v in ibans] + ["DE12 4111 1111 1111 1111 00", f"DE89 3704 0044 0532 0130 00 {a}"]
    kinds += [["iban", "iban"]] * len(ibans) + [["card"], ["iban", "card"]]
    got = run(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == kinds
    for i, text in enumerate(texts):
        assert SHAPE(got[i][0]) == SHAPE(text) and "4111 1111" not in got[i][0] and a not in got[i][0]
    for i, v in enumerate(ibans, 5):
        one, two = re.fullmatch(r"to (.*) THE bank, (.*)\.", got[i][0]).groups()
        assert one == two != v and valid("iban", one.replace(" ", ""))
    back = run(spark, [got[i][0] for i in range(len(texts))], inverse=True)
    assert [back[i][0] for i in range(len(texts))] == texts


def test_awkward_rows_and_all_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    got = pii.with_pseudonyms(docs)
    assert got.schema == docs.schema or got.schema.names == docs.schema.names
    assert Counter(map(tuple, got.collect())) == Counter(rows)  # nothing personal in them
    assert pii.with_pseudonyms(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_pii_pseudonyms(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        leaks = [m for m in re.findall(r"[\w.+-]+@[\w.-]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+|(?<!\d)\d{16}(?!\d)", text)
                 if m in got[i].text and ("@" in m or "(" in m or "." in m or (m[0] in "23456" and luhn(m)))]
        assert not leaks
        if not re.search(r"\d|@", text):
            assert got[i].text == text and got[i].n_pseudonyms == 0


def test_every_day_has_one_pseudonym_in_all_spellings(spark):
    """All 71,589 days: one pseudonym each, another for each, and back again."""
    days = spark.range(0, 71_589, 1, 8).select(F.date_add(F.lit("1904-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy"]
    late = F.when(F.dayofmonth("date") > 12, F.date_format("date", "dd/MM/yyyy"))
    told = days.select("date", late.alias("late"), *[pii._date("k", F.date_format("date", f), False).alias(f"f{i}") for i, f in enumerate(forms)],
                       pii._date("k", late, False).alias("told"))
    read = told.select("date", "late", "f0", "told", F.to_date("told", "dd/MM/yyyy").alias("from_late"), *[F.to_date(f"f{i}", f).alias(f"d{i}") for i, f in enumerate(forms)])
    read = written(read)
    assert read.where("NOT (d0 = d1 AND d0 = d2) OR d0 IS NULL").isEmpty()
    assert read.where("late IS NOT NULL AND (from_late IS NULL OR from_late <> d0)").isEmpty()
    assert read.select("d0").distinct().count() == 71_589
    assert read.select("date", F.to_date(pii._date("k", F.col("f0"), True)).alias("back")).where("back IS NULL OR back <> date").isEmpty()


def test_the_key_is_a_setting(spark):
    with pytest.warns(UserWarning, match="example key"):
        assert pii.session_key(spark) == pii.KEY
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.session_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
