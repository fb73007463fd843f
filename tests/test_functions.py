import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F


from quire.functions.align import Align, distance, lcs_length, opcodes, partial_ratio, ratio
from quire.functions.text import category, cause, change_kind, garbled, normalise, spliced
from quire.operators.joins import interval_anti, nearest
from quire.plans.evaluation import pooled_exact, pooled_interval
from quire.plans.pages import near_repeats, page_gaps
from quire.plans.sequences import settled_numbers
from quire.plans.typesetting import block_diff, curled, epub, hyphen_joins, quote_faults
from quire.sources.tables import html_blocks, json_log


def test_alignment_is_minimal_and_reconstructs():
    r = random.Random(4)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 8))) for _ in range(2))
        script = opcodes(a, b)
        assert "".join(a[i:j] if t == "equal" else b[k:m] for t, i, j, k, m in script) == b
        assert sum(max(j - i, m - k) for t, i, j, k, m in script if t != "equal") == distance(a, b)


def test_similarities():
    assert ratio("", "") == 100 and ratio("abcd", "abxd") == 75 and partial_ratio("bc", "abcd") == 100
    assert lcs_length("xaybz", "ab") == 2


def test_align_table_function(spark):
    spark.udtf.register("align", Align)
    got = spark.sql("SELECT * FROM align(array('a','b','c'), array('a','x','c','d'))").collect()
    assert [tuple(r) for r in got] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]


def test_kinds_of_error(spark):
    cases = [
        ("", "a", "missing words", "missing text"), ("a", "", "extra words", "extra text"), ("ab", "a b", "word breaks", "glued or split words"), ("„ja”", "'ja'", "quotes", "quote glyph"),
        ("ja.", "ja,", "punctuation", "punctuation swapped"), ("rat", "cat", "letters", "letters misread"), ("a cat", "cat", "words", "words"), ("Cat", "cat", "letters", "case"),
        ("zijn", "zíjn", "letters", "stress accent"), ("geeerd", "geëerd", "letters", "diaeresis"), ("in . . . Oh", "in ... Oh", "word breaks", "glued or split words"), ("in ... Oh", "in... Oh", "word breaks", "dash or dot spacing"), ("wat? ja", "wat ja", "punctuation", "punctuation swapped"), ("reeel", "reeël", "letters", "diaeresis"), ("a-b", "ab", "punctuation", "compound hyphen"), ("a–b", "a —b", "punctuation", "punctuation swapped"), ("a–b", "a—b", "punctuation", "dash"), ("ja...", "ja.", "punctuation", "dots and stops"), ("‘ja", "ja", "quotes", "quote missing or extra"), ("é", "ë", "letters", "other accent"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "got string, want string")
    got = df.select(category("got", "want"), cause("got", "want")).collect()
    for case, row in zip(cases, got):
        assert row[0] == case[2], case
        assert row[1] == case[3], case


def test_text_folds(spark):
    df = spark.createDataFrame([("„Ja” – nee . . . x²­",)], "t string")
    assert df.select(normalise("t")).first()[0] == '"Ja" — nee ... x2'
    df = spark.createDataFrame([("a . . b",), ("a . . . . b",), ("ground!” ’ ‘ “Two",), ("1⁄2",)], "t string")
    assert [r[0] for r in df.select(normalise("t")).collect()] == ["a . . b", "a .... b", "ground!\"' '\"Two", "1/2"]
    df = spark.createDataFrame([("~~ ^| 3x4 ok",), ("a normal line.",), ("",)], "t string")
    assert [r[0] for r in df.select(garbled("t")).collect()] == [True, False, False]
    df = spark.createDataFrame([("één", "een"), ("a b", "ab"), ("A", "a"), ("'a'", "a"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(change_kind("a", "b")).collect()] == ["accent", "space", "case", "quote", "letters"]


def test_splice(spark):
    df = spark.createDataFrame([("hello world", [(6, 11, "all"), (0, 1, "J")])], "t string, s array<struct<s:int,e:int,new:string>>")
    assert df.select(spliced("t", "s")).first()[0] == "Jello all"


def test_gaps(spark):
    pages = [(1, p, p - 5 if p < 10 else p - 3) for p in range(1, 20)]
    got = page_gaps(spark.createDataFrame(pages, "book long, pdf long, folio long")).collect()
    assert [tuple(r) for r in got] == [(1, 10, 5, 6)]


def test_repeat_of_a_repeat_is_no_original(spark):
    text = "some long line of words " * 20
    rows = [("b", 1, text), ("b", 2, text + "x"), ("b", 3, text), ("b", 40, text), ("b", 9, "other " * 60)]
    got = {(r.n, r.m) for r in near_repeats(spark.createDataFrame(rows, "book string, n long, text string")).collect()}
    assert got == {(2, 1), (3, 1)}


def test_interval_anti_and_nearest(spark):
    left = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30), (2, 3, 0, 10)], "g long, i long, s long, e long")
    right = spark.createDataFrame([(1, 9, 12), (1, 30, 40)], "g long, s long, e long")
    assert {r.i for r in interval_anti(left, right, ["g"], "s", "e", "s", "e", 8).collect()} == {2, 3}
    pics = spark.createDataFrame([(1, 5, 50), (1, 15, 51)], "g long, at long, pic long")
    caps = spark.createDataFrame([(1, 10, 1), (1, 14, 2), (1, 0, 3), (2, 0, 4)], "g long, at long, i long")
    assert {(r.i, r.pic) for r in nearest(caps, pics, ["g"], "at", "pic").collect()} == {(1, 50), (2, 51), (3, 50), (4, None)}


def test_settled_numbers(spark):
    rows = [(1, i, n) for i, n in enumerate([1, 2, 8, 4, 5, 9, 10])]
    got = settled_numbers(spark.createDataFrame(rows, "user_id long, n long, read long"), "user_id").orderBy("n").collect()
    assert [r.settled for r in got] == [1, 2, 3, 4, 5, 9, 10]


def test_hyphens(spark):
    broken = spark.createDataFrame([("well", "known"), ("to", "day"), ("x", "y")], "head string, tail string")
    spelled = spark.createDataFrame([("well-known", 4), ("today", 7)], "word string, n long")
    assert {r.joined for r in hyphen_joins(broken, spelled).collect()} == {"well-known", "today", "xy"}


def test_quotes():
    assert curled('"Ja", zei \'t \'kind\'.') == "“Ja”, zei ’t ‘kind’."
    assert curled("6' 2\" tall, a \" b and 'tis") == "6' 2\" tall, a \" b and ’tis"
    assert quote_faults("“a “b”") == [(0, "not closed")] and quote_faults("a”") == [(1, "not opened")] and quote_faults("it’s “ok”") == []


def test_html(spark):
    html = '<nav><li>x</li></nav><h1>T &amp; U</h1><p>a<br>b <i>c</i></p><div class="ad big">no</div><script>p</script><p>d'
    got = html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id", "block").collect()
    assert [(r.tag, r.text) for r in got] == [("h1", "T & U"), ("p", "a b c"), ("p", "d")]


def test_json_log_drops_a_torn_end(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k": ')
    assert sorted(r.k for r in json_log(spark, str(tmp_path / "log.jsonl"), "k long").collect()) == [1, 2]
    (tmp_path / "torn.jsonl").write_text('{"k": 1}\n{"k": \n{"k": 3}\n')
    with pytest.raises(Exception, match="torn"):
        json_log(spark, str(tmp_path / "torn.jsonl"), "k long").collect()


def test_epub_is_stable_and_typed_first():
    a = epub("T", [("One", ["x < y"])])
    assert a == epub("T", [("One", ["x < y"])])
    z = zipfile.ZipFile(BytesIO(a))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and b"x &lt; y" in z.read("s0.xhtml")


def test_block_diff(spark):
    f = lambda *t: spark.createDataFrame([("b", i, x) for i, x in enumerate(t)], "book string, n long, text string")
    got = {tuple(r) for r in block_diff(f("a", "b", "c"), f("a", "x", "c", "d")).collect()}
    assert got == {("b", "changed", 1, 1), ("b", "added", None, 3)}


def test_bootstrap_agrees_with_drawing_pages(spark):
    r = random.Random(2)
    books = {b: [(r.random(), r.random() + 0.3) for _ in range(60)] for b in "xyz"}
    rows = [(b, i, x, y) for b, pages in books.items() for i, (x, y) in enumerate(pages)]
    got = pooled_interval(spark.createDataFrame(rows, "book string, page long, before double, after double")).first()
    low, high = pooled_exact(list(books.values()))
    assert abs(got.low - low) < 0.03 and abs(got.high - high) < 0.03


def test_registry_without_other_packages():
    import subprocess
    import sys

    code = "import sys; import quire.plans; assert not any(m.startswith('quire.llm') or m == 'corpus_pipeline' for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)




def test_scripts_with_few_rows_kept_are_the_same(monkeypatch):
    import random

    from quire.functions import align

    r = random.Random(3)
    cases = [([r.choice("abcd") for _ in range(r.randint(0, 40))], [r.choice("abcd") for _ in range(r.randint(0, 40))]) for _ in range(200)]
    whole = [align.opcodes(a, b) for a, b in cases]
    monkeypatch.setattr(align, "CELLS", 0)
    assert [align.opcodes(a, b) for a, b in cases] == whole


def test_build_diff_reads_whole_documents(spark, tmp_path):
    from quire.plans.typesetting import build_diff

    text = "\n".join(["b", "b", "c", *(f"x{k}" for k in range(60))])
    other = "\n".join([*(f"y{k}" for k in range(50)), *(f"y{k}" for k in range(50))])
    spark.createDataFrame([(1, text, "en", "s"), (2, other, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    import quire.plans.typesetting as t

    rows = t.lines(t.table(spark, str(tmp_path), "documents")).selectExpr("CAST(doc_id AS STRING) book", "line n", "text")
    late = t.block_diff(rows, rows.where("n <> 45")).collect()
    assert {(x.book, x.change, x.old_n) for x in late} == {("1", "removed", 45), ("2", "removed", 45)}
    seen = []
    whole, t.block_diff = t.block_diff, lambda old, new: seen.append(old.agg({"n": "max"}).first()[0]) or whole(old, new)
    try:
        build_diff(spark, str(tmp_path)).collect()
    finally:
        t.block_diff = whole
    assert seen == [99]


def test_what_a_version_only_misreads(spark):
    from quire.functions import readings as R

    cases = [
        ("huis", "buis"), ("bet", "het"), ("dijk", "duk"), ("ijsdijk", "ijsdiik"), ("dijk", "dak"), ("voor", "vóor"), ("voor", "vóór"), ("née", "nee"), ("so", "s~o"), ("stem,", "stem."), ("stem", "stem."), ("stem;", "stem."),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, ours string, version string")
    got = df.select("i", R.b_for_h("ours", "version"), R.ij_misread("ours", "version"), R.brings(R.half_accented, "ours", "version"), R.brings(R.unprinted, "ours", "version"), R.stop_for_comma("ours", "version", F.lit("‘dat")))
    want = {0: [1], 2: [2], 3: [2], 5: [3], 8: [4], 9: [5], 10: [5]}
    assert {r[0]: [k for k in range(1, 6) if r[k]] for r in got.collect() if any(r[1:])} == want


def test_lines_and_labels(spark):
    from quire.functions import readings as R

    df = spark.createDataFrame([("* * *",), ("⁂",), ("**",), ("a * *",), ("",)], "t string")
    assert [r[0] for r in df.select(R.scene_break("t")).collect()] == [True, True, False, False, False]
    df = spark.createDataFrame([(None, "de"), ("so.", "de"), ("so", "de"), ("so", "De"), ("so ”  ", "de")], "a string, t string")
    assert [r[0] for r in df.select(R.starts_paragraph("a", "t")).collect()] == [True, True, False, True, True]
    df = spark.createDataFrame([(9, 2), (9, 9), (9, None)], "n int, o int")
    assert [r[0] for r in df.select(R.page_label("n", "o")).collect()] == ["PDF page 9 (the page prints 7)", "PDF page 9 (the page prints no number)", "PDF page 9 (the page prints no number)"]
    df = spark.createDataFrame([(20,), (89,), (3600,), (7500,)], "s int")
    assert [r[0] for r in df.select(R.duration("s")).collect()] == ["under a minute", "1 min", "1 h 00 min", "2 h 05 min"]
    df = spark.createDataFrame([("ﬁn , de ﬂuit . . . Щука",)], "t string")
    assert df.select(R.tidied("t"), R.latin("t"), R.strokes("t")).first()[0] == "fin, de fluit . . . Щука"
    assert df.select(R.latin("t")).first()[0].endswith("Schuka")
