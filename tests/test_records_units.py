"""Tests of record splitting (p3), unit conversion (p4) and the value functions."""

from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X
from ledgerloom.operators import record_split as S
from ledgerloom.operators.units import UnitSegmenter, base_quantities


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


SHAPES = {
    "1234.5": "1234.5", "1'234.50": "1234.50", "12’345.67": "12345.67", "12'345.-": "12345", "1234.00-": "-1234", "-1234.00": "-1234",
    "(1'234.50)": "-1234.50", "CHF 1'234.50": "1234.50", "-0.00": "0", "CHF  -5": "-5", "-12.-": "-12", "(12.-)": "-12", "007": "7",
    "1,234,567.89": None, "+5": None, "1e5": None, "--5": None, "-5-": None, "1'23": None, "1'2345": None, "": None, "1234'567": None, "5.": None, ".5": None,
    "CHF": None, "chf 5": None, "12-34": None, "(-5)": None, "12..5": None, "12.--": None, "١٢": None,
}


@pytest.mark.parametrize("text,want", SHAPES.items())
def test_number_shapes(spark, text, want):
    got = one(spark, N.parse_number(F.lit(text), F.lit(None).cast("string"), F.lit("'")))[0]
    assert (got is None and want is None) or got == Decimal(want)


def test_number_dialects(spark):
    p = lambda x, d, t: N.parse_number(F.lit(x), F.lit(d), F.lit(t))
    r = one(spark, p("1.234,50", ",", "."), p("1 234,5", ",", " "), p("1.234", ",", None), p("1,5", ".", None), p("1;5", ";", None), p("1'234,5", ",", "."), p("0.0000000000001", ".", None))
    assert [x if x is None else str(x.normalize()) for x in r] == ["1234.5", "1234.5", None, None, None, "1234.5", None]


def test_rate_conversion_rounds_once(spark):
    cases = [("100.00", "1.082250", 1, "108.23"), ("250000", "0.556300", 100, "1390.75"), ("1345.63", "0.931000", 1, "1252.78"), ("-100.00", "1.082250", 1, "-108.23"), ("0.04", "12.499999", 100, "0.00"), ("1000.00", "0.5", 1, "500.00")]
    for a, r, f, want in cases:
        got = one(spark, N.multiply_rate(F.lit(a).cast("decimal(18,2)"), F.lit(r).cast("decimal(18,6)"), F.lit(f)))[0]
        assert got == Decimal(want)
    assert one(spark, N.multiply_rate(F.lit("1").cast("decimal(18,2)"), F.lit("1").cast("decimal(18,6)"), F.lit(0)))[0] is None


def test_dates_and_keys(spark):
    r = one(spark, N.real_date(F.lit("2026-02-30"), F.lit(True)), N.real_date(F.lit("28.02.2026"), F.lit(True)), N.real_date(F.lit("28.02.2026"), F.lit(False)), N.short_date(F.lit("010270")), N.short_date(F.lit("010226")), N.zurich_date(F.lit("2026-03-28T23:30:00Z").cast("timestamp")))
    assert [str(x) for x in r] == ["None", "2026-02-28", "None", "1970-02-01", "2026-02-01", "2026-03-29"]
    r = one(spark, *[X.canonical_order_number(F.lit(x)) for x in ("PO-0045", " 45/00010 ", "00", "PO-AB/1", "", "PO-\t7")], X.mask_middle(F.lit("CH9300762011623852957")), X.mask_middle(F.lit("12345678")), X.line_suffix(F.lit("45/00010")))
    assert list(r) == ["45", "45", "0", "AB", "", "7", "CH93*************2957", "12345678", "00010"]


# -- records ------------------------------------------------------------------------
REC = "record_id long, batch_id string, file string, line long, record_ordinal long, dataset string, raw_text string, natural_key string, outcome string, extra string"
RCP = "receipt_id long, batch_id string, path string, delimiter string, decimal_separator string, thousands_separator string, date_format string, header_line string"
FXH = "base;quote;valid_from;rate_type;valid_to;rate;rate_factor;sequence;status"
GOOD = "EUR;CHF;2025-01-01;DAILY;;1.05;1;3;ACTIVE"


def split(spark, texts, dataset="fx_rate", header=FXH, delim=";", dec=".", fmt=None):
    recs = spark.createDataFrame([(i, "b", "f", i + 2, i + 1, dataset, t, None, None, "x") for i, t in enumerate(texts)], REC)
    frames = S.framed(recs, spark.createDataFrame([(1, "b", "f", delim, dec, None, fmt, header), (2, "b", "f", delim, dec, None, fmt, header)], RCP))
    bad = S.rejects(frames)
    return {r.record_id: r.reason for r in bad.collect()}, S.typed_rows(frames, bad, dataset).orderBy("record_id").collect()


def test_framing_reasons_come_in_order(spark):
    texts = [
        GOOD, GOOD.replace("EUR", '"EUR"'), GOOD.replace("EUR", '"EUR"x'), '"' + GOOD, GOOD.replace("EUR", 'E"R'), GOOD + ";", "EUR", None, "",
        GOOD.replace("DAILY", '"DA""ILY"'), '"EUR;x"' + GOOD[3:], GOOD.replace("ACTIVE", '"ACTIVE'), GOOD.replace("1.05", "1,05"), GOOD.replace("2025-01-01", "2025-02-30"), GOOD.replace(";3;", ";+3;"),
        " EUR ;CHF;2025-01-01;DAILY;;1.05;1;3;ACTIVE", GOOD.replace("EUR", '""'), GOOD.replace("EUR", '"EU\nR"') + ";", "x" * 200_000 + GOOD[3:], '"' + 'a""' * 100_000 + '"' + GOOD[3:],
    ]
    got, rows = split(spark, texts)
    assert got == {2: "quoting", 3: "quoting", 4: "value", 5: "column_count", 6: "column_count", 7: "column_count", 8: "column_count", 9: "value", 10: "value", 11: "quoting", 12: "value", 13: "value", 14: "value", 16: "value", 17: "column_count", 18: "value", 19: "value"}
    assert [r.record_id for r in rows] == [0, 1, 15] and rows[0].rate == Decimal("1.05") and rows[0].valid_to is None and rows[2].base == "EUR"


def test_values_the_types_cannot_hold_are_rejected_not_rounded(spark):
    texts = [GOOD.replace("1.05", "0.93123456789"), GOOD.replace(";3;", ";99999999999999999999;"), GOOD.replace("1.05", "0.1234567890123"), GOOD.replace("1.05", "1" * 27)]
    recs = spark.createDataFrame([(i, "b", "f", i + 2, i + 1, "fx_rate", t, None, None, "x") for i, t in enumerate(texts)], REC)
    frames = S.framed(recs, spark.createDataFrame([(1, "b", "f", ";", ".", None, None, FXH)], RCP))
    assert S.rejects(frames).count() == 0
    bad = S.rejects(frames, ranges=True)
    assert {(r.record_id, r.reason, r.code, r.field) for r in bad.collect()} == {(1, "range", "E_NUMBER_FORMAT", "sequence"), (2, "range", "E_DECIMAL_FORMAT", "rate"), (3, "range", "E_DECIMAL_FORMAT", "rate")}
    rows = S.typed_rows(frames, bad, "fx_rate").collect()
    assert [(r.record_id, r.rate) for r in rows] == [(0, Decimal("0.931234567890"))]


def test_delimiters_of_several_characters(spark):
    for d in ("||", "\t;", "\\E.", "a+"):
        texts = [GOOD.replace(";", d), GOOD.replace("EUR", '"EUR"').replace(";", d), GOOD.replace("ACTIVE", "ACTIVE;").replace(";", d)]
        got, rows = split(spark, texts, header=FXH.replace(";", d), delim=d)
        assert got == {2: "column_count"} and [r.record_id for r in rows] == [0, 1] and rows[1].base == "EUR"


def test_dialects_unknown_files_and_empty_tables(spark):
    assert split(spark, [GOOD.replace(";", "|").replace("1.05", "1,05").replace("2025-01-01", "01.02.2025")], header=FXH.replace(";", "|"), delim="|", dec=",", fmt="DD.MM.YYYY")[0] == {}
    assert split(spark, [GOOD.replace("2025-01-01", "01.02.2025")])[0] == {0: "value"}
    recs = spark.createDataFrame([(1, "nowhere", "f", 1, 1, "fx_rate", GOOD.replace(";", ","), None, None, None), (2, "nowhere", "f", 1, 1, "unheard", "a,b", None, None, None)], REC)
    frames = S.framed(recs, spark.createDataFrame([], RCP))
    assert {r.record_id for r in S.rejects(frames).collect()} == {2}
    assert S.rejects(S.framed(recs.where("false"), spark.createDataFrame([], RCP))).count() == 0


# -- units --------------------------------------------------------------------------
def test_unit_segmentation():
    s = UnitSegmenter()
    want = {"kg": "KG", "KGS": "KG", "Kilogramm": "KG", "kilo": "KG", "kg.": "KG", "g": "G", "gr.": "G", "Gramm": "G", "t": "TON", "to": "TON", "Tonnen": "TON", "m": "M", "Mtr.": "M", "metres": "M", "mètres": "M",
            "m2": "M2", "m²": "M2", "qm": "M2", "sqm": "M2", "Quadratmeter": "M2", "square metres": "M2", "mètre carré": "M2", "l": "L", "Ltr.": "L", "litres": "L", "h": "H", "hrs.": "H", "heures": "H",
            "Std.": "STD", "Stunden": "STD", "Stück": "STK", "STÜCK": "STK", "Stueck": "STK", "stk": "STK", "pcs": "PCE", "pièces": "PCE", "Pcs.": "PCE", "each": "EA", "ea.": "EA", "CTN.": "CTN", "Kartons": "CTN",
            "Ktn.": "CTN", "pau": "PAU", "Pauschale": "PAU", "lump sum": "PAU", "Palette": "PAL", "  kg ": "KG",
            "ml": None, "mm": None, "m3": None, "SET": None, "Rolle": None, "??": None, "": None, "x" * 500: None, "Gebinde": None, "km": None}
    assert {k: s.code(k) for k in want} == want
    assert s.code(None) is None


def test_base_quantities_match_fractions(spark):
    conv = [(None, "KG", 1, 1, "KG"), (None, "G", 1, 1000, "KG"), (None, "STK", 1, 1, "EA"), ("M1", "STK", 1000, 3, "EA"), ("M2", "STK", 1, 8, "EA"), (None, "EA", 1, 1, "EA"), ("M3", "KG", 1024, 1, "KG"), (None, "PAU", 1, 1, "EA"), ("M4", "KG", 2**62, 2**62, "KG")]
    lines = [
        (1, "M0", "5 kg", None, "x"), (2, "M0", "1'250,5", "g", "x"), (3, "M1", "3", "Stk", "x"), (4, "M1", "1", "Stk", "x"), (5, "M2", "(3)", "STK", "x"), (6, "M0", "7", " ", "Rohr, Menge in Stück"),
        (7, "M0", "7", None, "Rohr 12 kg Gebinde"), (8, "M0", "12", "EA", "x"), (9, "M0", None, "KG", "x"), (10, None, "2.-", "KG", "[g] y"), (11, "M0", "9", "SET", "x"), (12, "M0", "4-", None, "[kg] z"), (13, "M0", "99999999999999999999", "KG", "x"), (14, "M0", "1.5", "KG", None),
        (15, "M3", "0.0000009765625", "KG", "x"), (16, "M0", "0.0000000000001", "KG", "x"), (17, "M0", "3", "lump" + " " * 300 + "sum", "x"), (18, "M4", "-7.25", "KG", "x"), (19, "M0", "(" + "0" * 40 + "5)", "KG", "x"),
    ]
    L = spark.createDataFrame([(i, "b", "c" if "," in (q or "") else "p", m, d, q, u, "clash") for i, m, q, u, d in lines], "line_id long, batch_id string, path string, material string, description string, quantity string, uom string, unit string")
    R = spark.createDataFrame([(1, "b", "p", ";", ".", None, None, None), (2, "b", "c", ";", ",", ".", None, None), (3, "b", "c", ";", ",", ".", None, None)], RCP)
    C = spark.createDataFrame(conv, "material string, alt_uom string, numerator long, denominator long, base_uom string")
    want = {1: ("KG", 5000), 3: ("EA", int(Fraction(3) * 1000 / 3 * 1000)), 5: ("EA", -375), 6: ("EA", 7000), 8: ("EA", 12000), 10: ("KG", 2000), 12: ("KG", -4000), 14: ("KG", 1500), 15: ("KG", 1), 17: ("EA", 3000), 18: ("KG", -7250), 19: ("KG", -5000)}
    for limit in (50_000, 0):
        got = {r.line_id: (r.base_uom, r.base_milli) for r in base_quantities(L, R, C, limit).collect()}
        assert got == want  # 2: 1.2505 kg has four decimals
    plain = {r.line_id for r in base_quantities(L, R, C).where("plain").collect()}
    assert plain == {8, 14, 15}
    assert base_quantities(L.where("false"), R, C).count() == 0 and base_quantities(L, R, C.where("false")).count() == 0
