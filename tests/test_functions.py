import datetime
import difflib
import hashlib
import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.functions import fuzzy, identity, scalars
from recordmill.functions import predicates as P
from recordmill.functions import steps as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def every(spark, texts, function, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_text_predicates(spark):
    texts = ["A123 Systems", "a123 systems", "LG Chem", None, "", "50%_x"]
    assert every(spark, texts, lambda c: P.equals_text(c, "A123 SYSTEMS")) == [True, True, False, False, False, False]
    assert every(spark, texts, lambda c: P.contains_text(c, "%_")) == [False] * 5 + [True]
    assert every(spark, texts, lambda c: P.starts_text(c, "")) == [True] * 6
    assert every(spark, texts, lambda c: P.starts_text(c, "a1")) == [True, True, False, False, False, False]
    assert every(spark, texts, lambda c: P.contains_either_way(c, "lg")) == [False, False, True, False, True, False]
    assert every(spark, texts, lambda c: P.equals(c, None)) == [True] * 6


def test_resembles_equals_the_ratio(spark):
    random.seed(1)
    texts = ["Energizer", "Enegizer", "Energ", "xyz"] + ["".join(random.choices("Energizxy", k=random.randrange(1, 14))) for _ in range(60)]
    want = [(t.lower() in "energizer") or ("energizer" in t.lower()) or difflib.SequenceMatcher(None, t.lower(), "energizer").ratio() >= 0.8 for t in texts]
    assert every(spark, texts, lambda c: P.resembles(c, " Energizer")) == want


def test_fuzzy_score(spark):
    rows = spark.createDataFrame([("Molicel", "INR-21700-P42A", "21700"), ("LG", "MJ1", "18650"), (None, None, None)], "a string, b string, s string")
    got = [r.x for r in rows.select(fuzzy.score(["molicel", "P42A"], F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()]
    assert got[0] == 1.0 and got[1] < 0.5 and got[2] == 0.0
    assert rows.select(fuzzy.score(["18650"], F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()[1].x == 1.0


def test_ranges_and_not_a_number(spark):
    values = [1.0, 5.0, None, float("nan")]
    assert every(spark, values, lambda c: P.in_range(c, 1, 4), "double") == [True, False, False, True]
    assert every(spark, values, lambda c: P.in_range(c), "double") == [True] * 4


def test_facets_and_members(spark):
    assert one(spark, P.has_number(F.array(F.lit(0.1), F.lit(0.5)), 0.5 + 1e-12))
    assert one(spark, P.tri_state(F.lit(None).cast("boolean"), False)) and one(spark, P.tri_state(F.lit(True), None))
    assert one(spark, P.members_matching(F.array(F.lit("cell/a"), F.lit("x/cell/a")), "cell/[a-z]")) == ["cell/a"]
    assert every(spark, ["x-abc123.csv", "y-abc123", "abc123", "", None], lambda c: P.serial_matches(c, "q-abc123.nda")) == [True, True, True, False, False]


def plain_uid(value: int) -> str:
    out = ""
    for _ in range(16):
        value, r = divmod(value, 32)
        out = identity.ALPHABET[r] + out
    return "-".join(out[i : i + 4] for i in range(0, 16, 4))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seeds=st.lists(st.text(min_size=1, max_size=30).filter(lambda s: "\x00" not in s and not any(0xD800 <= ord(c) < 0xE000 for c in s)), min_size=20, max_size=20))
def test_uids(spark, seeds):
    sha = lambda s, n=16: int.from_bytes(hashlib.sha256(s.encode()).digest()[:n], "big")
    assert every(spark, seeds, identity.stable_uid) == [plain_uid(sha(s)) for s in seeds]
    assert every(spark, seeds, identity.sha1_uid) == [plain_uid(int.from_bytes(hashlib.sha1(s.encode()).digest()[:10], "big")) for s in seeds]
    bytewise = ["".join(identity.ALPHABET[b % 32] for b in hashlib.sha256(f"{s}\x1frole".encode()).digest()[:16]) for s in seeds]
    assert every(spark, seeds, lambda c: identity.bytewise_uid(c, F.lit("role"))) == ["-".join(b[i : i + 4] for i in range(0, 16, 4)) for b in bytewise]


def test_uid_forms(spark):
    assert every(spark, ["OIL1-2345-6789-abcd", "oil12345 6789abcd", "short", None], identity.normalised_uid) == ["0111-2345-6789-abcd", None, None, None]
    assert every(spark, ["https://example.org/cell/3m6k-9t2p-7x4h-9nq8/", "a/bc-d"], identity.short_id_of_iri) == ["3m6k9t", "bcd"]
    assert one(spark, identity.seed_of(F.lit(" a "), F.lit(None).cast("string"), F.lit("b"))) == "a::b" and one(spark, identity.seed_of(F.lit(" "))) is None


def test_unix_time_equals_plain_parsing(spark):
    def plain(text):
        t = text.strip()
        if t.isdigit():
            return int(t) if len(t) >= 9 else None
        try:
            parsed = datetime.datetime.fromisoformat(t.replace("Z", "+00:00"))
        except ValueError:
            return None
        return math.floor((parsed if parsed.tzinfo else parsed.replace(tzinfo=datetime.UTC)).timestamp())

    texts = ["2024-01-01", " 2024-01-01T00:00:00Z ", "2024-01-01T12:00", "2024-01-01T12:00:00+01:00", "2024-01-01 12:00:00.25", "20240101", "1704067200", "170406720", "", "soon", "2024-13-01", "1999-12-31T23:59:59-05:00", "2024-01-01T12"]
    skip = {"20240101"}  # the ISO basic form, which Python reads but the rule on digits comes first
    assert [x for t, x in zip(texts, every(spark, texts, scalars.unix_time), strict=True) if t not in skip] == [plain(t) for t in texts if t not in skip]
    assert every(spark, [1.9, -1.9, float("nan"), float("inf"), None], scalars.unix_of_number, "double") == [1, -1, None, None, None]
    assert every(spark, [0, 1704067200], scalars.iso_time, "long") == ["1970-01-01T00:00:00Z", "2024-01-01T00:00:00Z"]


def test_significant_digits(spark):
    values = [0.0, 425192.5, 12345.45, 1.0000005, -0.00123456789, 1e300, None]
    assert every(spark, values, scalars.significant, "double") == [None if v is None else float(f"{v:.6g}") for v in values]


def test_names_and_labels(spark):
    labels = ["Voltage / V", "Current [A]", "plain", "a / b / c", "x []"]
    assert every(spark, labels, scalars.label_of) == ["Voltage", "Current", "plain", "a", "x"]
    assert every(spark, labels, scalars.unit_of) == ["V", "A", None, "b / c", None]
    assert every(spark, ["ORG___Cell-mn2400-2026-02-tpejqj_127.0.0.1-BTS82-1-1-3-4", "org_X"], scalars.batch_key) == ["ORG__cell-mn2400-2026-02-tpejqj", "ORG__x"]
    assert every(spark, ["  Ab c!d-", "--"], scalars.slug) == ["ab-c-d", ""]
    assert every(spark, ["NA", " unk ", "x", None, "tbd"], scalars.cleaned) == [None, None, "x", None, None]
    assert every(spark, ["1.5", "nan", "inf", "NA", "x", None], scalars.finite_number) == [1.5, None, None, None, None, None]
    assert every(spark, ["mA h", " OHMS ", None], lambda c: scalars.normalised_unit(c, F.lit("v"))) == ["mah", "ohm", "v"]


def test_references(spark):
    assert every(spark, ["https://dx.doi.org/10.1/x", "10.1234/y", "text", ""], lambda c: scalars.citation_url(c, F.lit(None).cast("string"))) == ["https://doi.org/10.1/x", "https://doi.org/10.1234/y", "text", None]
    assert every(spark, ["MIT", "other Licence"], lambda c: scalars.licence(c, ["mit"])) == ["mit", "other Licence"]
    assert every(spark, ["a" * 64, "a" * 32, "g" * 64, None], lambda c: scalars.checksum_ok(F.lit("SHA-256"), c)) == [True, False, False, False]


def test_electrolytes(spark):
    got = every(spark, ["1M LiPF6 EC:EMC=3:7wt%", "EC:EC=1:1", "1.5 M LiFSI", "EC:DMC=1"], scalars.electrolyte)
    assert [(s.name, s.fraction) for s in got[0].solvents] == [("EC", 0.3), ("EMC", 0.7)] and got[0].salt == "LiPF6"
    assert [(s.name, s.fraction) for s in got[1].solvents] == [("EC", 1.0)] and got[2].concentration == 1.5
    assert [(s.name, s.fraction) for s in got[3].solvents] == [("EC", None), ("DMC", None)]


def test_steps(spark):
    texts = ["Charge at 1 C until 4.2 V", "Hold at 4.2 V until C/50", "Discharge at 0.5 C for 30 min or until 2.5 V", "Rest for 1 hour", "Rest", "Charge at 4.2.1 A", "Charge at C/0", "Hold at 1 A", "Charge at 1 A and then", "", None]
    got = every(spark, texts, S.step)
    assert [g.problem for g in got] == [None, None, None, None, None, "bad value", "bad value", "wrong quantity", "bad value", "no operation", "no operation"]
    assert [g.mode for g in got[:5]] == ["cc", "cv", "cc", "rest", "rest"]
    assert got[2].duration_s == 1800.0 and [(e.quantity, e.value, e.direction) for e in got[2].termination] == [("voltage", 2.5, "below")]
    again = every(spark, every(spark, texts[:5], lambda c: S.rendered(S.step(c))), S.step)
    assert again == got[:5]


def test_unit_conversion(spark):
    rows = spark.createDataFrame([(2.0, "mm"), (2.0, None), (2.0, "parsec")], "v double, u string")
    assert [r.x for r in rows.select(scalars.converted(F.col("v"), F.col("u"), {"mm": 1e-3}).alias("x")).collect()] == [0.002, 2.0, None]
    g = one(spark, F.to_json(scalars.volume_and_area(F.lit("coin"), F.lit(2.0), F.lit(3.0), F.lit(None).cast("double"), F.lit(None).cast("double"))))
    assert json.loads(g) == {"volume": pytest.approx(9.42478), "area": pytest.approx(25.1327)}
