"""Named queries: (spark, sf_dir) -> DataFrame, one for each operator and its main variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, lexicons
from ..functions import measures as m
from ..functions.tokens import sentences, tokens
from ..operators import annotation, arabic, association, bilingual, catalog, concordance, frequency, language, lexical, multimodal, perceptron, syntax, tools, versions, vision
from ..sources import archives, charset, frequency_lists, images, manifest, storage, wikitext
from ..sources.storage import stored
from ..streaming import ingest
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("lang = 'en'")


@query
def freq_word(spark, d):
    return frequency.frequency(tokens(english(spark, d)), "text_lc", limit=100)


@query
def freq_word_min5(spark, d):
    return frequency.frequency(tokens(docs(spark, d)), "text", min_freq=5, limit=None)


@query
def freq_per_language(spark, d):
    return tokens(docs(spark, d), ("lang",)).groupBy("lang", "text_lc").agg(F.count("*").alias("freq"))


@query
def corpus_stats(spark, d):
    return frequency.corpus_statistics(docs(spark, d))


@query
def type_token_by_lang(spark, d):
    out = frequency.corpus_statistics(docs(spark, d), ("lang",))
    return out.withColumn("ttr", F.round(m.type_token_ratio(F.col("types"), F.col("tokens")), 6))


@query
def sttr_en(spark, d):
    return frequency.standardised_ttr(english(spark, d))


@query
def kwic_the(spark, d):
    return concordance.search_concordance(english(spark, d), "the", limit=None)


@query
def kwic_page(spark, d):
    return concordance.search_concordance(english(spark, d), "the", limit=100, offset=50)


@query
def kwic_wildcard(spark, d):
    return concordance.search_concordance(docs(spark, d), "th?n*", limit=None)


@query
def kwic_case_sensitive(spark, d):
    return concordance.search_concordance(docs(spark, d), "The", case_sensitive=True, window=3, limit=None)


@query
def kwic_total(spark, d):
    return concordance.count_matches(docs(spark, d), "the")


@query
def kwic_accent_folded(spark, d):
    sents = sentences(docs(spark, d))
    return sents.select("doc_id", "sentence_idx", F.size(F.filter("toks", lambda t: concordance.folded_matches(t, "ele"))).cast("long").alias("n")).where("n > 0")


@query
def kwic_compare(spark, d):
    x = docs(spark, d)
    return concordance.compare_concordance(x.where("source = 'src1'"), x.where("source = 'src2'"), "the")


@query
def colloc_of(spark, d):
    return association.collocations(english(spark, d), "of", scope="node_sentences", limit=None)


@query
def colloc_of_textbook(spark, d):
    return association.collocations(english(spark, d), "of", scope="corpus", limit=None)


@query
def colloc_top(spark, d):
    return association.collocations(english(spark, d), "of", scope="corpus", limit=100)


def _counts(df: DataFrame) -> DataFrame:
    return frequency.count_items(tokens(df), "text_lc")


@query
def keyness_source_vs_rest(spark, d):
    words = tokens(english(spark, d).where("source is not null"), ("source",))
    return association.keyness_of_parts(words, F.col("source") == "src1")


@query
def keyness_top(spark, d):
    return association.top_keyness(keyness_source_vs_rest(spark, d), "positive", 50)


@query
def keyness_conversation_roles(spark, d):
    x = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role", "text")
    return association.keyness_of_parts(tokens(x.where("role in ('user', 'assistant')"), ("role",)), F.col("role") == "user")


@query
def keyness_quality_labels(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels").where("quality in (0, 1)"), "doc_id")
    return association.keyness_of_parts(tokens(x, ("quality",)), F.col("quality") == 1)


@query
def keyness_vs_freq_list(spark, d):
    """English documents against a frequency list in a file, which has the words of the benchmark passages."""
    words = frequency.count_items(tokens(table(spark, d, "benchmark"), id_col="item_id"), "text_lc")
    path = storage.shared_folder(spark, "frequency-list")
    words.select(F.concat_ws("\t", "item", F.col("freq").cast("string"))).write.text(path)
    reference = frequency_lists.read_tsv(spark, path).withColumnRenamed("word", "item")
    return association.keyness(_counts(english(spark, d)), reference)


@query
def dispersion_the(spark, d):
    return frequency.dispersion(english(spark, d), "the")


@query
def dispersion_by_source(spark, d):
    return frequency.dispersion(docs(spark, d), "the", part="source")


@query
def dispersion_parts(spark, d):
    return frequency.part_frequencies(docs(spark, d), "the", part="source")


@query
def dispersion_weighted(spark, d):
    return frequency.weighted_dispersion(frequency.part_frequencies(docs(spark, d), "the"))


@query
def bigrams(spark, d):
    return frequency.ngrams(english(spark, d), 2, limit=None)


@query
def trigrams_bundles(spark, d):
    return frequency.ngrams(english(spark, d), 3, min_freq=3, min_range=2, limit=None)


@query
def ngrams_skip_stop(spark, d):
    return frequency.ngrams(english(spark, d), 2, min_freq=3, stop_words=lexicons.STOP_WORDS_EN, limit=None)


@query
def sentiment_sentences(spark, d):
    return lexical.sentiment(english(spark, d), lexicons.ATTESTED["positive"], lexicons.ATTESTED["negative"])


@query
def sentiment_summary(spark, d):
    return lexical.sentiment_summary(lexical.sentiment(english(spark, d)))


@query
def discourse_categories(spark, d):
    return lexical.metadiscourse(english(spark, d), lexicons.ATTESTED["metadiscourse"])


@query
def discourse_default_lexicon(spark, d):
    return lexical.metadiscourse(docs(spark, d))


@query
def vocab_bands(spark, d):
    return lexical.vocabulary_bands(docs(spark, d), lexicons.ATTESTED["basic"], lexicons.ATTESTED["academic"])


@query
def rare_words(spark, d):
    return lexical.rare_words(docs(spark, d))


def _cleaned(spark, d, **options):
    c = cleaning.clean_text(F.col("text"), cleaning.CleanOptions(**options))
    return docs(spark, d).select("doc_id", c.alias("c")).select("doc_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query
def clean_basic(spark, d):
    return _cleaned(spark, d, strip_entities=True, remove_emails=True, lowercase=True)


@query
def clean_stopwords(spark, d):
    return _cleaned(spark, d, remove_punctuation=True, lowercase=True, remove_stop_words=True)


@query
def clean_min_len(spark, d):
    return _cleaned(spark, d, min_token_length=4)


@query
def clean_corpus_effect(spark, d):
    x = docs(spark, d)
    c = cleaning.clean_text(F.col("text"), cleaning.CleanOptions(lowercase=True, remove_stop_words=True))
    before = frequency.corpus_statistics(x).withColumn("state", F.lit("before"))
    after = frequency.corpus_statistics(x.withColumn("text", c)).withColumn("state", F.lit("after"))
    return before.unionByName(after).select("state", "documents", "tokens", "types")


@query
def html_text(spark, d):
    text = cleaning.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.alias("c")).select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query
def wikitext_plain(spark, d):
    """Documents dressed up as wiki pages, with nested templates, tables and links, and their text again."""
    words = F.trim(F.regexp_replace("text", fixtures.NO_MARKUP, " "))
    opening, head, tail = fixtures.WIKI_PAGE
    page = F.concat(F.lit(opening), "source", F.lit(head), words, F.lit(tail))
    return docs(spark, d).select("doc_id", wikitext.strip_wikitext(page).alias("x")).select("doc_id", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("digest"))


@query
def redact_sentences(spark, d):
    out = lexical.redact_sentences(docs(spark, d), lexicons.ATTESTED["redaction"])
    return out.select("doc_id", "was_filtered", F.size(F.split("text", r"\[redacted")).cast("long").alias("parts"), F.md5("text").alias("digest"))


@query
def persuasion_markers(spark, d):
    return lexical.persuasion(docs(spark, d))


@query
def framing_markers(spark, d):
    return lexical.framing(docs(spark, d))


@query
def narrative_stages(spark, d):
    return lexical.narrative(docs(spark, d))


@query
def cultural_markers(spark, d):
    return lexical.cultural(docs(spark, d), lists=lexicons.ATTESTED["cultural"])


@query
def top_words(spark, d):
    return frequency.word_frequency_top(docs(spark, d))


@query
def register_scores(spark, d):
    return docs(spark, d).select("doc_id", bilingual.register(F.col("text"), ["the", "der", "una"], ["of", "and"]).alias("r")).select("doc_id", "r.*")


def in_arabic(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their Latin letters written as Arabic ones: the tables hold no Arabic."""
    return docs(spark, d).withColumn("text", F.translate(F.lower("text"), fixtures.LATIN, fixtures.ARABIC))


@query
def dialect_heuristic(spark, d):
    return in_arabic(spark, d).select("doc_id", bilingual.dialect(F.col("text"), fixtures.DIALECTS).alias("x")).select("doc_id", "x.*")


@query
def arabic_normalised(spark, d):
    x = F.col("text")
    forms = {"normalised": cleaning.normalise_arabic(x), "buckwalter": cleaning.buckwalter(x), "plain": cleaning.dediacritise(x)}
    return in_arabic(spark, d).select("doc_id", *(F.md5(v).alias(k) for k, v in forms.items()))


@query
def arabic_words(spark, d):
    return arabic.word_analysis(in_arabic(spark, d))


@query
def arabic_roots(spark, d):
    return arabic.root_frequency(arabic.word_analysis(in_arabic(spark, d)))


@query
def arabic_segments(spark, d):
    """How often each run of prefixes and suffixes stands around a stem of each kind."""
    return arabic.segment_counts(in_arabic(spark, d), ("lang",))


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = docs(spark, d)
    pairs = x.where("lang = 'en'").select("doc_id", (F.col("doc_id") + 1).alias("target_id"))
    return x.where("lang = 'en'"), x, pairs


@query
def align_positional(spark, d):
    return bilingual.align(*_sides(spark, d)).select("doc_id", "target_id", "sentence_idx", "confidence")


@query
def parallel_kwic(spark, d):
    source, target, pairs = _sides(spark, d)
    return bilingual.parallel_concordance(source, target, "the", pairs, limit=None)


@query
def subcorpus_filter(spark, d):
    x = docs(spark, d).withColumn("meta", F.create_map(F.lit("genre"), F.col("source"), F.lit("year"), (F.lit(2000) + F.pmod("doc_id", F.lit(20))).cast("string")))
    return catalog.subcorpus(x, year_min="2005", year_max="2010", genre="src5").select("doc_id", "lang")


@query
def delete_documents(spark, d):
    return frequency.corpus_statistics(catalog.delete_document(docs(spark, d), spark.range(4).withColumnRenamed("id", "doc_id")))


@query
def ai_disclosure(spark, d):
    return catalog.ai_disclosure(table(spark, d, "conversations"))


@query
def precheck(spark, d):
    """Every source as a corpus: without long texts it has no generated ones, with an even number of documents its recipe is whole."""
    n = F.count("*")
    corpora = docs(spark, d).groupBy(F.col("source").alias("corpus")).agg(F.sum("n_chars").alias("token_count"), F.count_if(F.col("n_chars") > 10_000).alias("ai_turns"), F.lit("regex").alias("backend"), F.max("lang").alias("model_name"), F.when(n % 2 == 0, "1").alias("model_version"), (n - 1).alias("document_count"))
    return catalog.precheck(corpora)


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """(source, word, o, r, c, n): a word's count in a source, in all, the source's size and that of all; words of 100 and more."""
    cells = stored(tokens(docs(spark, d), ("source",)).groupBy("source", F.col("text_lc").alias("word")).agg(F.count("*").alias("o")), "word-counts")
    r = cells.groupBy("word").agg(F.sum("o").alias("r")).where("r >= 100")
    c = cells.groupBy("source").agg(F.sum("o").alias("c"))
    both = cells.join(r, "word").join(c, "source")
    return both.crossJoin(F.broadcast(cells.agg(F.sum("o").alias("n"))))


@query
def measures_by_source(spark, d):
    """All measures of association between words and sources."""
    t = word_counts(spark, d)
    o, r, c, n = (F.col(x) for x in "orcn")
    forward, backward = m.delta_p(o, r, c, n)
    out = {
        "mi": m.mutual_information(o, r, c, n),
        "t_score": m.t_score(o, r, c, n),
        "dice": m.dice(o, r, c),
        "log_dice": m.log_dice(o, r, c),
        "ll": m.log_likelihood(o, r, c, n),
        "chi2": m.chi_square(o, r, c, n),
        "dp_yx": forward,
        "dp_xy": backward,
        "simple": m.simple_maths(o, r, c, n),
    }
    return t.select("source", "word", *(F.round(v, 6).alias(k) for k, v in out.items()))


@query
def dispersion_by_word(spark, d):
    """Dispersion over sources of every frequent word; sources without it count as zero."""
    t = word_counts(spark, d).select("source", "word", "o")
    every = t.select("word").distinct().crossJoin(F.broadcast(docs(spark, d).select("source").distinct()))
    rows = every.join(t, ["word", "source"], "left").select("word", F.coalesce("o", F.lit(0)).alias("f"))
    s = rows.groupBy("word").agg(F.sum("f").alias("total"), F.count("*").alias("n"), F.avg("f").alias("mean"), F.stddev_pop("f").alias("sd"))
    share = F.abs(F.col("f") / F.col("total") - 1 / F.col("n"))
    dp = rows.join(s, "word").groupBy("word").agg(F.sum(share).alias("x"))
    return s.join(dp, "word").select("word", F.round(m.juilland_d(F.col("mean"), F.col("sd"), F.col("n")), 6).alias("d"), F.round(m.deviation_of_proportions(F.col("x")), 6).alias("dp"))


PLACE = ("sentence_idx", "token_idx")
HEADED = (*PLACE, "text", "lemma", "pos", "morph", "dep_head", "dep_rel", "head_text", "head_lemma", "head_pos")
SHOWN = (*PLACE, "text", "lemma", "pos", "morph", "dep_rel", "head_text", "modifiers")


def parsed(spark: SparkSession, d: str, columns: tuple[str, ...] = HEADED, only: dict[str, tuple] | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
    return annotation.RuleAnnotator().annotate(docs(spark, d), ("lang",), columns, only, by)


@query
def rule_annotation(spark, d):
    """Every token's annotation, summed up: counts, heads and lemmas of each kind of token."""
    kind = ("lang", "pos", "dep_rel", "morph", "head_pos")
    # Parts by lemma, which tasks add up: one pass over the texts, and no task sorts tokens for distinct counts or greatest strings.
    parts = stored(parsed(spark, d, (*kind[1:], "lemma", "dep_head", "is_stop", "head_lemma"), by=(*kind, "lemma")), "annotation-parts")
    own = parts.groupBy(*kind, "lemma").agg(F.sum("n").alias("freq"), F.sum("dep_head").alias("heads"), F.sum("is_stop").alias("stop_words"))
    own = own.groupBy(*kind).agg(F.sum("freq").alias("freq"), F.sum("heads").alias("heads"), F.count("*").alias("lemmas"), F.sum("stop_words").alias("stop_words"))
    heads = parts.groupBy(*kind, "head_lemma").agg(F.count("*").alias("parts"))
    heads = heads.groupBy(*kind).agg(F.max("head_lemma").alias("last_head")).withColumnsRenamed({c: f"{c}_" for c in kind})
    same = [own[c].eqNullSafe(heads[f"{c}_"]) for c in kind]
    return own.join(heads, same).select(*kind, "freq", "heads", "lemmas", "last_head", "stop_words")


@query
def trained_annotation(spark, d):
    """A model of 1,000 documents' sentences, applied to all documents: how often each tag and relation is given."""
    x = docs(spark, d)
    model = perceptron.train(perceptron.training_sentences(x, annotation.RuleAnnotator(), most=1000), rounds=3)
    parts = perceptron.TrainedAnnotator(model).annotate(x, ("lang",), ("pos", "dep_rel"), by=("lang", "pos", "dep_rel"))
    return parts.groupBy("lang", "pos", "dep_rel").agg(F.sum("n").alias("freq"))


@query
def grammar(spark, d):
    return syntax.grammar(parsed(spark, d, SHOWN))


@query
def grammar_counts(spark, d):
    def tokens_of(ids: DataFrame) -> DataFrame:
        return annotation.RuleAnnotator().annotate(docs(spark, d).join(ids, "doc_id", "left_semi"), ("lang",), SHOWN)

    out = syntax.grammar_counts(parsed(spark, d, SHOWN), tokens_of=tokens_of)
    return out.select("pattern", "freq", F.array_join("examples", ",").alias("examples"))


@query
def pos_distribution(spark, d):
    return syntax.pos_distribution(parsed(spark, d, ("pos",), by=("pos",)))


@query
def pos_bigrams(spark, d):
    return syntax.pos_ngrams(parsed(spark, d, ("token_idx", "tags"), {"token_idx": (0,)}), 2, min_freq=1, limit=None)


@query
def dependency_pairs(spark, d):
    pair = ("lemma", "dep_rel", "head_lemma")
    return syntax.dependency_pairs(parsed(spark, d, pair, {"dep_rel": ("nsubj",)}, pair), limit=None)


@query
def dependency_examples(spark, d):
    """Verbs and their objects with the first three places of each pair."""
    t = parsed(spark, d, (*PLACE, "lemma", "dep_head", "dep_rel", "head_text", "head_lemma", "head_pos"), {"dep_rel": ("obj",)})
    return syntax.dependency_pairs(t, "obj", None, examples=3).withColumn("examples", F.array_join("examples", ","))


@query
def metaphor_candidates(spark, d):
    return syntax.metaphor_candidates(parsed(spark, d, only={"dep_rel": ("nsubj",)}), limit=None)


@query
def lemma_kwic(spark, d):
    return concordance.annotated_concordance(parsed(spark, d, (*PLACE, "text", "lemma", "pos", "is_punct", "toks"), {"lemma": ("be",)}), "be", "lemma", window=2)


@query
def collocation_network(spark, d):
    return association.network_layout(association.collocations(english(spark, d), "of", limit=None))


def document_images(spark: SparkSession, d: str) -> DataFrame:
    """Documents' bytes written as PNG files and read back."""
    return images.text_pixels(docs(spark, d))


@query
def image_pixels(spark, d):
    return document_images(spark, d).select("image_id", "width", "height", F.md5("rgb").alias("digest"), "error")


@query
def image_measures(spark, d):
    """Colour and composition of every document's image."""
    return vision.analyse_texts(docs(spark, d))


@query
def image_regions(spark, d):
    return images.text_regions(docs(spark, d))


@query
def visual_grammar(spark, d):
    return vision.visual_grammar(vision.analyse_texts(docs(spark, d)))


@query
def region_alignment(spark, d):
    """Regions of documents' images against captions made of the documents' columns."""
    caption = F.concat(F.lit("A "), F.get(F.array(*map(F.lit, fixtures.CAPTION_COLOURS)), F.pmod("doc_id", F.lit(len(fixtures.CAPTION_COLOURS))).cast("int")), F.lit(" page, "), "source", F.lit(", with (left) text at the bottom in "), "lang")
    spans = vision.text_spans(docs(spark, d).select(F.col("doc_id").alias("image_id"), caption.alias("caption")), ["with", "this", "that"])
    return vision.align_regions(images.text_regions(docs(spark, d)), spans)


def captioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents as captions of images whose measures come from their ids: a test of rules, not of images."""
    n = F.col("doc_id")
    colours = F.array(*map(F.lit, fixtures.DOMINANT))
    return docs(spark, d).select(
        n.alias("image_id"),
        F.col("text").alias("caption"),
        F.col("source").alias("ocr"),
        ((F.pmod(n, F.lit(21)) - 10) / 10).alias("warm_cold"),
        (F.pmod(n, F.lit(11)) / 10).alias("saturation"),
        F.pmod(n, F.lit(256)).cast("double").alias("brightness"),
        (F.pmod(n, F.lit(8)) / 8).alias("iv_centre"),
        F.array(F.get(colours, F.pmod(n, F.lit(len(fixtures.DOMINANT))).cast("int"))).alias("dominant"),
    )


@query
def social_semiotic(spark, d):
    return multimodal.social_semiotic(captioned(spark, d))


@query
def critical_discourse(spark, d):
    out = None
    for k in multimodal.CDA_FRAMEWORKS:
        found = multimodal.critical_discourse(captioned(spark, d), k).withColumn("framework", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return out


@query
def visual_metaphor(spark, d):
    return multimodal.visual_metaphor(captioned(spark, d))


@query
def combined_emotion(spark, d):
    return multimodal.combined_emotion(captioned(spark, d))


@query
def detect_languages(spark, d):
    """Documents against the profiles of the languages that they are said to be in."""
    x = docs(spark, d)
    return language.detect_own(x, default="en")


@query
def language_profiles(spark, d):
    return language.fit_profiles(docs(spark, d))


@query
def charset_round_trip(spark, d):
    """Documents written in six encodings, the encodings found by what is known of all texts, and the texts decoded."""
    x = docs(spark, d)
    pairs = stored(charset.fit_byte_pairs(x), "byte-pairs")  # writer and reader use the same
    found = charset.detect_and_decode(charset.written(x, pairs=pairs), pairs, "doc_id")
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query
def corpus_versions(spark, d):
    """Documents ingested, then cleaned: counts of both versions, and for how many documents each made rows."""
    store = versions.Versions(spark, storage.shared_folder(spark, "versions"))
    x = docs(spark, d).select("doc_id", "text")
    cleaned = x.withColumn("text", cleaning.clean_text(F.col("text"), cleaning.CleanOptions(lowercase=True, remove_stop_words=True)))
    out = None
    for label, source in (("before", x), ("after", cleaned)):
        entry = store.commit(source, tokens, "regex-tokens", {"version": 1})
        counts = store.rows().agg(F.count("*").alias("tokens"), F.countDistinct("text_lc").alias("types"))
        counts = counts.select(F.lit(label).alias("state"), F.lit(entry["documents"]).cast("long").alias("documents"), F.lit(entry["made"]).cast("long").alias("made"), "tokens", "types")
        out = counts if out is None else out.unionByName(counts)
    return out


@query
def manifest_tree(spark, d):
    """The tree of digests over all documents."""
    return manifest.build(manifest.row_digests(docs(spark, d), "doc_id", ["text", "lang", "source"]), depth=2)


@query
def manifest_damage(spark, d):
    """Documents of one language changed and those of one source lost: what their manifest names."""
    x = docs(spark, d)
    damaged = x.where("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    a, b = (manifest.row_digests(t, "doc_id", ["text", "lang", "source"]) for t in (x, damaged))
    return manifest.differences(a, b, manifest.build(a, depth=2), manifest.build(b, depth=2))


@query
def archive_members(spark, d):
    """Documents written as zip and tar.gz archives and read back by ranges of members."""
    out = None
    for kind in ("zip", "tar.gz"):
        folder = storage.shared_folder(spark, "archives")
        archives.write_archives(docs(spark, d), folder, kind)
        got = archives.read_members(spark, folder).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out.select("kind", "name", "genre", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


@query
def tool_results(spark, d):
    """Tools called by name over all documents, and how many rows each gives."""
    calls = {"concordance": {"query": "the"}, "frequency": {"min_freq": 2}, "grammar": {"patterns": ["modal", "complex_np", "tense"]}, "dependency_pairs": {"relation": "obj"}, "tags": {}, "languages": {"default": "en"}, "redaction": {"words": ["the", "und"]}, "statistics": {}}
    out = None
    for name, found in tools.call_all(docs(spark, d), {name: (name, arguments) for name, arguments in calls.items()}).items():
        n = found.agg(F.lit(name).alias("tool"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query
def event_windows(spark, d):
    """The stream operator over the events table as one batch: counts by window and type."""
    found = ingest.event_counts(table(spark, d, "events"), "1 hour")
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n")
