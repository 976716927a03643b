import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry, ids, redact, text


def one(spark, column, *values, schema=None):
    schema = schema or ", ".join(f"c{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, wanted",
    [("a11111", True), ("A1111", True), ("11111111", True), (". . . . . . . .", True), ("a111", False), ("Table 1", False), (None, False)],
)
def test_decorative(spark, value, wanted):
    assert one(spark, text.is_decorative("c0"), value, schema="c0 string") is wanted


def test_leaks_and_repairs(spark):
    c = text.leak_counts("c0")
    value = "signi cant ef cient WORDS rst ​ x = ¼ y ⟦f1⟧\na11111\n"
    got = {k: one(spark, v, value) for k, v in c.items()}
    assert got == {"a": 1, "b": 1, "c": 5, "r2": 1}
    assert one(spark, text.repair_ligatures("c0"), "Signi cant, EF CIENT and rst but RST") == "Significant, EFFICIENT and first but RST"
    assert one(spark, text.sanitize_block("c0"), "xy ​z ð12Þ") == f"x{text.GAP_MARK}y z (12)"
    assert one(spark, text.noise_count("c0"), "- 12 -\nReferences\n10.1000/abc.def\nA plain line\n22") == 2


def test_splits(spark):
    assert one(spark, text.sentences("c0"), "One two.  Three? Four") == ["One two.", "Three?", "Four"]
    assert one(spark, text.segments("c0"), "a b\nc\n \n\nd\n\nlong  one") == ["a b c", "long one"]
    assert one(spark, text.numbers("c0"), "3 mg in [1, 2] and 4.5%") == ["3 mg", "[1, 2]", "4.5%"]
    assert one(spark, text.preview("c0"), "First. " + "x" * 300) == "First."
    assert one(spark, text.wrap("c0", 3), "abcdefg") == ["abc", "def", "g"]
    assert one(spark, text.parse_numbered("c0", F.lit(3)), "1. a\n2) b") == ["a", "b", ""]
    assert one(spark, text.latex_paragraphs("c0"), r"\section{A} one two three four five six seven eight % no" + "\n\nshort") == ["A one two three four five six seven eight"]


def test_translations(spark):
    ok = lambda f, t, s: one(spark, f(F.col("c0"), F.col("c1")), t, s)
    assert ok(text.landed, "译文", "text") and not ok(text.landed, "text", "text") and not ok(text.landed, "other words", "text")
    assert ok(text.settled, "Same Words", "same  words") and ok(text.unchanged_ok, "BLEU", "BLEU") and not ok(text.unchanged_ok, "a b c d", "a b c d")
    assert ok(text.translation_integrity, "译 ⟦f1⟧ [2]", "x") != "" and one(spark, text.translation_integrity(F.col("c0"), F.col("c1")), "⟦f1⟧ [2]", "译 ⟦f1⟧ [2]") == ""


def test_lines(spark):
    yes = lambda c, v: one(spark, c, v)
    assert yes(text.is_metadata("c0"), "doi: 10.1000/xyz") and yes(text.is_metadata("c0"), "Open  Access") and not yes(text.is_metadata("c0"), "A body line.")
    assert yes(text.looks_like_author("c0"), "Ada Lovelace, Alan Turing") and not yes(text.looks_like_author("c0"), "This is a sentence that says something. And more of it.")
    assert yes(text.is_page_chrome("c0"), "12") and yes(text.is_page_chrome("c0"), "arXiv:1706.03762v7") and not yes(text.is_page_chrome("c0"), "Body")
    assert yes(text.trust("c0"), "ab") == "garbled" and yes(text.trust("c0"), "  ") == "empty" and yes(text.trust("c0"), "fine") == "text-layer"
    assert tuple(yes(text.figure_label("c0"), "Table 3b. Results")) == ("table", "3b") and yes(text.figure_label("c0"), "Results") is None
    assert yes(text.is_code_face("c0"), "CMTT10") and yes(text.is_math_face("c0"), "CMMI10") and not yes(text.is_code_face("c0"), "Monolith")


def test_bytes_and_reviews(spark):
    f = lambda n: one(spark, text.approx_bytes(F.col("c0")), n, schema="c0 double")
    assert [f(x) for x in (0.0, 512.0, 1024.0, 1536.0, 10240.0, 1048576.0 * 123.4)] == ["0 B", "512 B", "1 KB", "1.5 KB", "10 KB", "123 MB"]
    r = one(spark, text.review_fold(F.col("c0")), [5, 5, 5], schema="c0 array<int>")
    assert (r["reps"], round(r["ease"], 2), r["interval"]) == (3, 2.8, 8.0)
    r = one(spark, text.review_fold(F.col("c0")), [5, 5, 0], schema="c0 array<int>")
    assert (r["reps"], r["interval"]) == (0, 1.0)


def test_redaction(spark):
    raw = "//user:pw@host sk-abc_1 Bearer xyz DeepL-Auth-Key k1 ?api_key=zz&a=1"
    assert one(spark, redact.redact("c0"), raw) == "//***:***@host *** Bearer *** DeepL-Auth-Key *** ?api_key=***&a=1"
    assert one(spark, redact.redact_strict("c0"), "short abcdefghijklmnopqrstuvwxyz") == "short ***"
    url = lambda u: one(spark, redact.scrub_url("c0"), u)
    assert url("HTTPS://u:p@Ex.org/a;token=1;v=2/key=3/b?q&token=x&x-amz-date=1&a=b#f") == "https://ex.org/a;v=2/b?q&a=b"
    assert url("file:///etc") == "" and url("http://ex.org") == "http://ex.org/" and url(None if False else "") == ""
    assert one(spark, redact.scrub_event_url("c0"), "file:///etc") == "file:"
    assert one(spark, redact.scrub_message("c0", ["supersecret"]), "at https://u:p@h.org/x?y supersecret") == "at https://h.org ***"
    blob = json.dumps({"apiKey": "abcdef", "a": {"token": "keep", "secrets": {"x": "longvalue", "token": "t"}}, "l": [{"password": "pw1234"}]})
    assert json.loads(one(spark, redact.strip_secrets("c0"), blob)) == {"a": {"token": "keep", "secrets": {"x": "longvalue"}}, "l": [{}]}
    assert one(spark, redact.secret_values("c0"), blob) == ["abcdef", "longvalue", "pw1234"]
    assert one(spark, redact.strip_secrets("c0"), "no json") is None
    key = lambda k, p: one(spark, redact.is_secret_key("c0", "c1"), k, p)
    assert key("API-Key", "") and key("token", "headers") and not key("token", "placeholders")


def test_ids(spark):
    def fnv(s):
        h = 2166136261
        for c in map(ord, s):
            h = (h ^ (c & 0xFFFF)) * 16777619 & 0xFFFFFFFF
            if c > 0xFFFF:
                h = (h ^ (c >> 16)) * 16777619 & 0xFFFFFFFF
        out = ""
        while h:
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
            h //= 36
        return out.rjust(7, "0")

    for s in ("", "abc", "é😀 mixed", "long" * 50):
        assert one(spark, ids.fnv36(F.col("c0")), s) == fnv(s)
    q = lambda v: one(spark, ids.quantize(F.col("c0")), v, schema="c0 double")
    assert [q(v) for v in (1.005, -0.004, float("nan"), None, 2.675)] == [1.0, 0.0, 0.0, 0.0, 2.68]
    assert one(spark, ids.block_text("c0"), "A ⟦f1⟧ b-C é!") == "abcé"
    a = lambda u: (lambda r: r and tuple(r))(one(spark, ids.arxiv_id("c0"), u))
    assert a("https://arxiv.org/pdf/1706.03762v7.pdf") == ("1706.03762", "v7") and a("hep-th/9711200") == ("hep-th/9711200", None) and a("https://x.org/1706.03762") is None


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(geometry.iou(a, b), geometry.overlap_ratio(a, b), geometry.holds_centre(a, b), geometry.union(a, b), geometry.upper_median(F.array(*map(F.lit, [4, 1, 3, 2])))).first()
    assert (round(r[0], 4), r[1], r[2], tuple(r[3]), r[4]) == (0.1429, 0.25, True, (0.0, 0.0, 3.0, 3.0), 3)


def test_years_of_other_than_four_digits(spark):
    shown = text.relative_time(F.make_timestamp(F.col("y"), F.lit(12), F.lit(31), F.lit(1), F.lit(2), F.lit(3)), F.to_timestamp(F.lit("2024-03-10 15:00:00")))
    df = spark.createDataFrame([(-5, ), (0, ), (75, ), (1904, ), (12024, )], "y int")
    assert [r["r"] for r in df.select(shown.alias("r")).collect()] == ["-5-12-31", "0000-12-31", "0075-12-31", "1904-12-31", "12024-12-31"]


def test_edges_of_words_are_ascii(spark):
    assert one(spark, text.leak_counts("c0")["c"], "Dürst ürst xrst rstä, arst") == 3
    assert one(spark, text.repair_ligatures("c0"), "Dürst xrst rstä") == "Düfirst xrst firstä"
    assert one(spark, text.is_metadata("c0"), "copyrightä 2020") is True
    assert one(spark, redact.redact("c0"), "äBearer abc") == "äBearer ***"


def test_lines_with_a_hole_after_another_letter_are_left_out(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(1, "ürst of all\nfirst of all"), (2, "rstä")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["blocks_sanitized"](spark, str(tmp_path)).select("doc_id", "ord", "clean").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()["blocks_sanitized"]).select("doc_id, ord, clean").fetchall())
    assert [r["doc_id"] for r in got] == [1]


def test_plain_words_are_told_apart_before_the_tests_on_chrome(spark):
    words = "the of a ab abc vol vols preprint preprints copyright method methods letter letters cell cells nature science plos bmj icml iclr proceedings abstract results references arxiv issn no pp x1 a11111 2019 12 vol12".split()
    words += [" preprint ", "Nature", "et al", "open access", "", "issue", "commentary", "editorial", "perspective", "conference", "workshop", "neurips", "subcell"]
    df = spark.createDataFrame([(w, x, y, h) for w in words for x in (5.0, 300.0, 600.0) for y in (5.0, 50.0, 400.0, 745.0, 785.0) for h in (8.0, 10.0, 20.0)], "str string, x double, y double, h double")
    item = [F.col("str"), F.col("x"), F.col("y"), F.col("h"), F.lit(792.0), F.lit(612.0)]
    quick, full = text.is_page_chrome_item(*item), text._is_page_chrome_item(*item)
    got = df.select("str", quick.alias("a"), full.alias("b")).collect()
    assert [r["str"] for r in got if bool(r["a"]) != bool(r["b"])] == [] and any(r["a"] for r in got)
