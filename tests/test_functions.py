"""Measures, cleaning, sources, sinks and edge cases on literal inputs."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import cleaning
from lexiloom.functions import measures as m
from lexiloom.functions.tokens import annotated, positions, real, sentence_rows, sentences, tokens
from lexiloom.operators import association, bilingual, catalog, concordance, frequency, lexical, syntax, vision
from lexiloom.sources import frequency_lists, markup, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CASES = [
    (lambda: m.mutual_information(1, 100, 100, 10000), 0),
    (lambda: m.mutual_information(200, 100, 100, 10000), 7.643856),
    (lambda: m.mutual_information(0, 1, 1, 10), -math.inf),
    (lambda: m.t_score(200, 100, 100, 10000), 14.071425),
    (lambda: m.t_score(10, 1000, 1000, 10000), -28.460499),
    (lambda: m.dice(10, 20, 30), 0.4),
    (lambda: m.log_dice(10, 10, 10), 14),
    (lambda: m.log_likelihood(10, 990, 5, 995), 1.711585),
    (lambda: m.log_likelihood(0, 100, 100, 0), 277.258872),
    (lambda: m.chi_square(10, 990, 5, 995), 1.679261),
    (lambda: m.chi_square(50, 0, 0, 50), 100),
    (lambda: m.chi_square(25, 25, 25, 25), 0),
    (lambda: m.delta_p(80, 100, 200, 1000)[0], 0.666667),
    (lambda: m.delta_p(80, 100, 200, 1000)[1], 0.375),
    (lambda: m.log_ratio(100, 10, 10000, 10000), 3.321928),
    (lambda: m.log_ratio(0, 5, 10, 10), -math.inf),
    (lambda: m.log_ratio(5, 0, 10, 10), math.inf),
    (lambda: m.log_ratio(0, 0, 10, 10), 0),
    (lambda: m.percent_difference(100, 10, 10000, 10000), 900),
    (lambda: m.simple_maths(100, 10, 10000, 10000), 9.991009),
    (lambda: m.odds_ratio(100, 10, 10000, 10000), 10.090909),
    (lambda: m.sentiment_score(F.lit(2), F.lit(0)), 0.666667),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_measure(spark, i):
    column, want = CASES[i]
    got = value(spark, column())
    assert got == want if math.isinf(want) else got == pytest.approx(want, abs=1e-6)


def test_toy_collocation_scopes(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps. the lazy dog sleeps. a quick fox runs")], "doc_id bigint, text string")
    for scope, n, mi in (("corpus", 13, 2.7004), ("node_sentences", 9, 2.1699)):
        rows = {r["collocate"]: r for r in association.collocations(docs, "fox", window=2, min_freq=1, scope=scope).collect()}
        assert {k: r["o_raw"] for k, r in rows.items()} == {"quick": 2, "brown": 1, "jumps": 1, "a": 1, "runs": 1}
        assert rows["quick"]["n"] == n and rows["quick"]["mi"] == pytest.approx(mi, abs=1e-4)


def test_ngrams_stay_in_sentences(spark):
    docs = spark.createDataFrame([(1, "A b. B c. A b"), (2, None), (3, "")], "doc_id bigint, text string")
    rows = {r["ngram"]: (r["freq"], r["range"]) for r in frequency.ngrams(docs, 2, min_freq=1).collect()}
    assert rows == {"A b": (2, 1), "B c": (1, 1)}
    with pytest.raises(ValueError):
        frequency.ngrams(docs, 11)


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert frequency.frequency(tokens(docs)).count() == 0
    assert frequency.corpus_statistics(docs).first()["documents"] == 0
    assert concordance.search_concordance(docs, "a").count() == 0
    assert lexical.sentiment(docs).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id bigint, text string, lang string")
    assert sentences(one).count() == 0
    assert frequency.corpus_statistics(one).first()["tokens"] == 0


def test_positions_match_a_global_order(spark):
    rows = [(i * 7919 % 200_003, i % 5) for i in range(300)]
    got = {r["doc_id"]: r["offset"] for r in positions(spark.createDataFrame(rows, "doc_id bigint, n int"), block=1000).collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n


def test_wildcards_escape_like_signs():
    assert concordance.like_pattern("100%") is None
    assert concordance.like_pattern("a_b*") == "a\\_b%"
    assert concordance.like_pattern("th?n") == "th_n"


def test_clean_order(spark):
    o = cleaning.CleanOptions(strip_entities=True, remove_urls=True, remove_emails=True, remove_numbers=True, remove_symbols=True, remove_punctuation=True, lowercase=True, remove_stop_words=True, min_token_length=2, compose=True)
    got = value(spark, cleaning.clean_text(F.lit("See &amp; https://a.b/c?d=1 me@x.org 12.5 \U0001f600 The Café, x «Yes»!"), o))
    assert got == "see café yes"
    assert value(spark, cleaning.clean_text(F.lit(None).cast("string"), o)) is None
    assert value(spark, cleaning.clean_text(F.lit("a\r\nb\t\t c\n\n\n\nd "))) == "a\nb c\n\nd"


def test_markdown_and_names(spark):
    assert value(spark, cleaning.strip_markdown(F.lit("# T\n```\ncode\n```\n**b** [x](y)"))) == "T\ncode\nb x"
    assert value(spark, cleaning.safe_filename(F.lit(' a/b: "c" '))) == "a_b___c"
    assert value(spark, cleaning.safe_filename(F.lit("..."))) == "export"
    assert value(spark, cleaning.buckwalter(F.lit("كتاب"))) == "ktAb"


def test_markup_parsers():
    page = "<html><body><nav>menu</nav><article><p>One</p><script>x()</script><p>Two &amp; 3</p></article></body></html>"
    assert markup.html_text(page) == "One\nTwo & 3"
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>no</title></teiHeader><text><body><p>A <hi>b</hi> c.</p><p><w>d</w><w>e</w></p></body></text></TEI>'
    assert markup.tei_text(tei) == "A b c.\n\nd e"
    assert markup.csv_text("id,text\n1,hello\n2,\n3,there\n") == "hello\nthere"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        f.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>P1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>C1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert markup.docx_text(z.getvalue()) == "P1\n\nC1"


def test_xml_with_entities_is_refused():
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;&a;">]><text>&b;</text>'
    with pytest.raises(ValueError, match="entity declarations"):
        markup.tei_text(bomb)
    assert markup.tei_text("<!DOCTYPE TEI><text>a &amp; b</text>") == "a & b"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x\r\ny")
    (tmp_path / "b.xml").write_text("<broken")
    rows = {r["path"].rpartition("/")[2]: r for r in markup.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"]["text"] == "x\ny" and rows["b.xml"]["text"] is None and "ParseError" in rows["b.xml"]["error"]


def test_archives_keep_every_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for i in range(700):
            z.writestr(f"root/news/{i}.txt", f"text {i}")
    rows = markup.read_archives(spark, str(tmp_path / "c.zip"))
    assert rows.count() == 700 and rows.select("genre").distinct().collect()[0][0] == "news"


def test_frequency_lists(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# note\nthe\t10\nTHE\t5\nof\tx\nand\t0\n\n")
    assert [tuple(r) for r in frequency_lists.read_tsv(spark, str(tmp_path / "l.tsv")).collect()] == [("the", 15)]
    (tmp_path / "l.json").write_text('[{"word":"The","freq":3},{"word":"","freq":2},{"word":"a","freq":0}]')
    assert [tuple(r) for r in frequency_lists.read_json(spark, str(tmp_path / "l.json")).collect()] == [("the", 3)]
    (tmp_path / "l.lst").write_bytes(sinks.to_lst([("The", 3, 1.5), ("The", 1, 0.5)], "c", 10))
    assert sorted(tuple(r) for r in frequency_lists.read_lst(spark, str(tmp_path / "l.lst")).collect()) == [("The", 1), ("The", 3)]


def test_sinks(spark, tmp_path):
    h, r = ["a", "b"], [["x", 1.5], ["نص", math.inf]]
    assert sinks.to_csv(h, r, bom=True).startswith(b"\xef\xbb\xbfa,b\nx,1.5\n")
    assert json.loads(sinks.to_json(h, r))[1] == {"a": "نص", "b": None}
    assert zipfile.ZipFile(io.BytesIO(sinks.to_xlsx(h, r))).namelist()[0] == "[Content_Types].xml"
    assert b"----" in sinks.to_fixed_width(h, r)
    with pytest.raises(ValueError):
        sinks.serialize("png", h, r)
    key = F.lit(b"0123456789abcdef")
    assert value(spark, sinks.decrypt(sinks.encrypt(F.lit("s").cast("binary"), key), key)) == b"s"
    assert "<svg" in sinks.network_svg("of", [{"x": 1.0, "y": 0.0, "edge_width": 1, "radius": 12, "collocate": "<a>"}])


def test_annotated_defaults(spark):
    t = annotated(spark.createDataFrame([(1, 0, 0, "Hi", None, "PUNCT"), (1, 0, 1, "You", None, None)], "doc_id bigint, sentence_idx int, token_idx int, text string, lemma string, pos string"))
    assert [(r["lemma"], r["pos"], r["dep_rel"]) for r in t.orderBy("token_idx").collect()] == [("Hi", "PUNCT", "dep"), ("You", "X", "dep")]
    assert real(t).count() == 2 and sentence_rows(t).first()["toks"][1]["text"] == "You"
    assert set(syntax.DETECTORS) == {"passive", "modal", "negation", "relative_clause", "complex_np", "tense"}


def test_redaction_gate(spark):
    docs = spark.createDataFrame([(1, "A tall man. He ran! Fine?"), (2, None), (3, "adulthood")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in lexical.redact_sentences(docs, ["tall", "adult"], "[x]").collect()}
    assert rows[1]["text"] == "[x] He ran! Fine?" and rows[2]["text"] is None and rows[3]["was_filtered"] is False
    assert lexical.redact_sentences(docs, gate_open=True).where("was_filtered").count() == 0


def test_translation_and_merge(spark):
    words = spark.createDataFrame([("book",), ("x",)], "word string")
    table = spark.createDataFrame([("kitab", ["book", "volume"])], "source string, targets array<string>")
    rows = {r["word"]: r["source"] for r in bilingual.translate_words(words, table, reverse=True).collect()}
    assert rows == {"book": "kitab", "x": None}
    a, b = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert sorted(tuple(r) for r in catalog.merge_by_id([a, b]).collect()) == [(1, "a"), (2, "c")]
    meta = spark.createDataFrame([({"k": "1"},), (None,)], "meta map<string,string>")
    assert [r["meta"]["k"] for r in catalog.merge_metadata(meta, {"k": "2"}).collect()] == ["2", "2"]


def test_small_table(spark, tmp_path):
    t = catalog.Table(spark, str(tmp_path / "t"), "id int, name string")
    assert t.rows().count() == 0
    t.add([(1, "a"), (2, "b")])
    t.remove(F.col("id") == 1)
    assert [tuple(r) for r in t.rows().collect()] == [(2, "b")]


def test_pixels(spark):
    red = bytes([255, 0, 0] * 100)
    r = vision.analyse_pixels(spark.createDataFrame([(1, 10, 10, red)], "image_id bigint, width int, height int, rgb binary")).first()
    assert r["dominant"] == ["#e00000"] and r["warm_cold"] == 1.0 and r["salience_x"] == 0.5 and r["contrast"] == 0.0


def test_stream_ingest(spark, tmp_path):
    from lexiloom.streaming.ingest import start_ingest

    spark.createDataFrame([(1, "One two. Three", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
