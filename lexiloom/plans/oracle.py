"""The same queries in DuckDB SQL, written from their definitions."""

from __future__ import annotations

from ..functions import lexicons
from ..functions.cleaning import BUCKWALTER, DIACRITICS
from ..operators import annotation, arabic, lexical, vision
from . import fixtures

TEXT_TOKENS = """
sents AS (SELECT * EXCLUDE (ss), unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_idx FROM (
  SELECT * EXCLUDE (text), list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM base)),
sent_toks AS (SELECT *, regexp_extract_all(sentence, '[\\p{L}\\p{M}\\p{N}]+') AS toks FROM sents),
toks AS (SELECT * EXCLUDE (toks, sentence), unnest(toks) AS text, generate_subscripts(toks, 1) - 1 AS token_idx FROM sent_toks)
"""
EN = "SELECT * FROM documents WHERE lang = 'en'"
ALL = "SELECT * FROM documents"


def with_tokens(base: str, rest: str, more: str = "") -> str:
    return f"WITH base AS ({base}), {TEXT_TOKENS} {more} {rest}"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(xs: list[str]) -> str:
    return "(" + ", ".join(map(text, xs)) + ")"


def values(rows: list[tuple], columns: str, casts: str = "*") -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return text(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v)

    return f"SELECT {casts} FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


def kwic(base: str, where: str, w: int, tail: str = "") -> str:
    return with_tokens(base, f"""SELECT doc_id, sentence_idx::INT AS sentence_idx, token_idx::INT AS token_idx,
      array_to_string(list_slice(toks, greatest(token_idx - {w}, 0) + 1, token_idx), ' ') AS left_context, node,
      array_to_string(list_slice(toks, token_idx + 2, token_idx + 1 + {w}), ' ') AS right_context,
      doc_id || ':' || sentence_idx || ':' || token_idx AS evidence_id
      FROM (SELECT doc_id, sentence_idx, toks, unnest(toks) AS node, generate_subscripts(toks, 1) - 1 AS token_idx FROM sent_toks) WHERE {where} {tail}""")


def ll(a: str, b: str, c: str, d: str) -> str:
    n = f"({a} + {b} + {c} + {d})"
    terms = [f"(CASE WHEN {o} > 0 AND {r} * {k} > 0 THEN {o} * ln({o} / ({r} * {k} / {n})) ELSE 0 END)" for o, r, k in ((a, f"({a} + {b})", f"({a} + {c})"), (b, f"({a} + {b})", f"({b} + {d})"), (c, f"({c} + {d})", f"({a} + {c})"), (d, f"({c} + {d})", f"({b} + {d})"))]
    return "(2 * (" + " + ".join(terms) + "))"


def chi(a: str, b: str, c: str, d: str) -> str:
    n = f"({a} + {b} + {c} + {d})"
    terms = [f"(CASE WHEN {r} * {k} > 0 THEN ({o} - {r} * {k} / {n}) * ({o} - {r} * {k} / {n}) / ({r} * {k} / {n}) ELSE 0 END)" for o, r, k in ((a, f"({a} + {b})", f"({a} + {c})"), (b, f"({a} + {b})", f"({b} + {d})"), (c, f"({c} + {d})", f"({a} + {c})"), (d, f"({c} + {d})", f"({b} + {d})"))]
    return "(" + " + ".join(terms) + ")"


def colloc(scope: str, tail: str = "") -> str:
    base = "own" if scope == "node_sentences" else "low"
    return with_tokens(EN, f"""SELECT collocate, o_raw, o::BIGINT AS o, fx::BIGINT AS fx, fy::BIGINT AS fy, n::BIGINT AS n,
      round(log2(q * dn / (x * y)), 4) AS mi, round((q - x * y / dn) / sqrt(q), 4) AS t_score,
      round({ll('a', '(x - a)', '(y - a)', '(dn - x - y + a)')}, 4) AS log_likelihood,
      round({chi('a', '(x - a)', '(y - a)', '(dn - x - y + a)')}, 4) AS chi_square,
      round(2 * q / (x + y), 4) AS dice, round(14 + log2(2 * q / (x + y)), 4) AS log_dice,
      round(q / x - CASE WHEN dn - x > 0 THEN (y - q) / (dn - x) ELSE 0 END, 4) AS delta_p_yx,
      round(q / y - CASE WHEN dn - y > 0 THEN (x - q) / (dn - y) ELSE 0 END, 4) AS delta_p_xy
      FROM scored WHERE x - a >= 0 AND y - a >= 0 AND dn - x - y + a >= 0 {tail}""", f""",
    low AS (SELECT list_transform(toks, lambda t: lower(t)) AS toks FROM sent_toks),
    own AS (SELECT * FROM low WHERE list_contains(toks, 'of')),
    counts AS (SELECT w, count(*) AS f FROM (SELECT unnest(toks) AS w FROM {base}) GROUP BY w),
    totals AS (SELECT sum(f)::BIGINT AS n, coalesce(sum(f) FILTER (w = 'of'), 0)::BIGINT AS fx FROM counts),
    nodes AS (SELECT toks, i FROM (SELECT toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM own) WHERE t = 'of'),
    pairs AS (SELECT c AS collocate, count(*) AS o_raw FROM (SELECT unnest(list_concat(list_slice(toks, greatest(i - 5, 1), i - 1), list_slice(toks, i + 1, i + 5))) AS c FROM nodes) GROUP BY c HAVING count(*) >= 3),
    scored AS (SELECT collocate, o_raw, least(o_raw, fx, f) AS o, fx, f AS fy, n, o_raw::DOUBLE AS q, least(o_raw, fx, f)::DOUBLE AS a, fx::DOUBLE AS x, f::DOUBLE AS y, n::DOUBLE AS dn FROM pairs JOIN counts ON w = collocate, totals)""")


def keyness(target: str, reference: str, raw_reference: str | None = None, tail: str = "") -> str:
    """Two token queries with a column w, or a (w, f) reference."""
    b = raw_reference or f"SELECT w, count(*) AS f FROM ({reference}) GROUP BY w"
    return f"""WITH a AS (SELECT w, count(*) AS f FROM ({target}) GROUP BY w), b AS ({b}),
    s AS (SELECT (SELECT coalesce(sum(f), 0) FROM a)::BIGINT AS n1, (SELECT coalesce(sum(f), 0) FROM b)::BIGINT AS n2),
    j AS (SELECT coalesce(a.w, b.w) AS term, coalesce(a.f, 0)::BIGINT AS f1, coalesce(b.f, 0)::BIGINT AS f2, n1, n2 FROM a FULL OUTER JOIN b ON a.w = b.w, s),
    p AS (SELECT *, f1::DOUBLE AS x, f2::DOUBLE AS y, n1::DOUBLE AS m, n2::DOUBLE AS k, CASE WHEN n1 > 0 THEN f1 / n1 * 1e6 ELSE 0 END AS p1, CASE WHEN n2 > 0 THEN f2 / n2 * 1e6 ELSE 0 END AS p2 FROM j WHERE greatest(f1, f2) >= 5)
    SELECT * FROM (SELECT term, f1, f2, n1, n2, round({ll('x', '(m - x)', 'y', '(k - y)')}, 4) AS log_likelihood, round({chi('x', '(m - x)', 'y', '(k - y)')}, 4) AS chi_square,
      round(CASE WHEN p1 = 0 AND p2 = 0 THEN 0 WHEN p1 = 0 THEN '-inf'::DOUBLE WHEN p2 = 0 THEN 'inf'::DOUBLE ELSE log2(p1 / p2) END, 4) AS log_ratio,
      round(CASE WHEN p2 > 0 THEN (p1 - p2) / p2 * 100 WHEN p1 > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS pct_diff,
      round((p1 + 1) / (p2 + 1), 4) AS simple_maths,
      round(CASE WHEN y * (m - x) > 0 THEN x * (k - y) / (y * (m - x)) WHEN x > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS odds_ratio,
      CASE WHEN p1 = p2 THEN 'none' WHEN p1 > p2 THEN 'positive' ELSE 'negative' END AS direction FROM p) {tail}"""


def token_words(base: str) -> str:
    return f"SELECT lower(t) AS w FROM (SELECT unnest(flatten(list_transform(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS t FROM ({base}))"


def ngrams(n: int, rest: str, toks: str = "toks") -> str:
    return with_tokens(EN, f"""SELECT ngram, count(*) AS freq, count(DISTINCT doc_id) AS range FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ts) - {n} + 2), lambda i: array_to_string(list_slice(ts, i, i + {n - 1}), ' '))) AS ngram FROM (SELECT doc_id, {toks} AS ts FROM sent_toks) WHERE len(ts) >= {n}) GROUP BY ngram HAVING {rest}""")


def stats(base: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN types USING ({by})" if by else ", types"
    return f"""WITH base AS ({base}), {TEXT_TOKENS},
    types AS (SELECT {cols} count(DISTINCT lower(text)) AS types FROM toks {group}),
    n AS (SELECT {cols} count(*) AS tokens FROM toks {group}),
    s AS (SELECT {cols} count(*) AS sentences FROM sents {group}),
    d AS (SELECT {cols} count(*) AS documents FROM base {group})"""


def stats_all(base: str) -> str:
    return stats(base) + " SELECT documents, sentences, tokens, types FROM d, s, n, types"


def markers(expr: str, xs: list[str]) -> str:
    return "(" + " + ".join(f"contains({expr}, {text(x)})::INT" for x in xs) + ")"


def claim_sql(rules: list[tuple[str, str, str]], base: str = "SELECT doc_id, lower(text) AS t FROM documents") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {text(k)} AS category, round(({v})::DOUBLE, 6) AS confidence FROM ({base}) WHERE {c}" for k, c, v in rules)


def dispersion(base: str, part: str) -> str:
    return f"""WITH p AS (SELECT {part}, sum(len(list_filter(flatten(list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'))), lambda t: lower(t) = 'the')))::BIGINT AS f FROM ({base}) GROUP BY {part}),
    s AS (SELECT sum(f)::BIGINT AS total, count(*) AS n, avg(f) AS mean, stddev_pop(f) AS sd FROM p)
    SELECT max(total) AS frequency, max(n) AS parts, round(max(CASE WHEN n < 2 THEN 1 WHEN mean = 0 THEN 0 ELSE greatest(0, 1 - sd / mean / sqrt(n - 1)) END), 6) AS juilland_d,
    round(coalesce(0.5 * sum(CASE WHEN total > 0 THEN abs(f / total - 1 / n) END), 0), 6) AS gries_dp FROM p, s"""


WS = r"'^\s+|\s+$', '', 'g'"


def collapse(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def finish(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), {WS})"


def split_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


PUNCT = "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~‘’“”–—…«»¡¿]+'"
STOPPED = f"array_to_string(list_filter({split_words('t1')}, lambda t: NOT list_contains({'[' + ', '.join(map(text, lexicons.STOP_WORDS_EN)) + ']'}, t)), ' ')"
EDGES = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~‘’“”–—…«»¡¿'"


def digest(inner: str, last: str) -> str:
    return f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {last} AS c FROM ({inner}))"


CLOSED_ROWS = [(lang, w, tag, *(annotation.FORMS.get(w, (w, "")) if lang == "en" else (w, ""))) for lang, classes in annotation.CLOSED.items() for tag, ws in classes.items() for w in ws.split()]
ENDING_ROWS = [(lang, i, ending, tag, morph, int(cut)) for lang, rows in annotation.ENDINGS.items() for i, (ending, tag, morph, cut) in enumerate(rows)]
SENTENCE_OF = "PARTITION BY doc_id, sentence_idx"


def nearest(kind: str, ahead: bool) -> str:
    frame = "BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING" if ahead else "BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"{'min' if ahead else 'max'}(CASE WHEN pos = '{kind}' THEN token_idx END) OVER ({SENTENCE_OF} ORDER BY token_idx ROWS {frame})"


#: The annotated tokens p: words looked up in the lists, heads from windows over each sentence.
PARSED = with_tokens(ALL, f"""SELECT t.doc_id, t.lang, t.sentence_idx::INT AS sentence_idx, t.token_idx::INT AS token_idx, t.text, x.lemma, x.pos, x.morph, x.lw, rel[1]::INT + 1 AS dep_head, rel[2] AS dep_rel FROM r JOIN x USING (doc_id, sentence_idx, token_idx) JOIN toks t USING (doc_id, sentence_idx, token_idx)""", f""",
  closed AS ({values(CLOSED_ROWS, "lang, w, tag, lemma, morph")}), endings AS ({values(ENDING_ROWS, "lang, i, ending, tag, morph, cut")}),
  voc AS (SELECT DISTINCT CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'en' END AS lang, lower(text) AS w FROM toks),
  ended AS (SELECT v.lang, v.w, arg_min(struct_pack(tag, morph, cut, n := length(ending)), i) AS e FROM voc v JOIN endings e ON e.lang = v.lang AND suffix(v.w, ending) AND length(v.w) > length(ending) + 1 GROUP BY ALL),
  lex AS (SELECT v.lang, v.w, CASE WHEN c.w IS NOT NULL THEN c.lemma WHEN num THEN v.w WHEN e.cut = 1 THEN left(v.w, length(v.w) - e.n) ELSE v.w END AS lemma,
    CASE WHEN c.w IS NOT NULL THEN c.tag WHEN num THEN 'NUM' ELSE coalesce(e.tag, 'NOUN') END AS pos, CASE WHEN c.w IS NOT NULL THEN c.morph WHEN num THEN '' ELSE coalesce(e.morph, '') END AS morph
    FROM (SELECT *, regexp_full_match(w, '\\p{{Nd}}+') AS num FROM voc) v LEFT JOIN closed c USING (lang, w) LEFT JOIN ended USING (lang, w)),
  x AS MATERIALIZED (SELECT doc_id, sentence_idx, token_idx, w AS lw, lemma, pos, morph FROM (SELECT doc_id, sentence_idx, token_idx, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'en' END AS lang, lower(text) AS w FROM toks) JOIN lex USING (lang, w)),
  near AS (SELECT *, {nearest('NOUN', True)} AS na, {nearest('NOUN', False)} AS nb, {nearest('VERB', True)} AS va, lag(pos) OVER s AS before, lag(lw) OVER s AS word_before,
    coalesce(min(token_idx) FILTER (pos = 'VERB') OVER a, min(token_idx) FILTER (pos = 'AUX') OVER a, min(token_idx) FILTER (pos = 'NOUN') OVER a, 0) AS root FROM x WINDOW s AS ({SENTENCE_OF} ORDER BY token_idx), a AS ({SENTENCE_OF})),
  r AS (SELECT n.doc_id, n.sentence_idx, n.token_idx, CASE WHEN n.token_idx = root THEN row(-1, 'root')
    WHEN n.pos = 'DET' AND na IS NOT NULL THEN row(na, 'det') WHEN n.pos = 'ADJ' AND na IS NOT NULL THEN row(na, 'amod') WHEN n.pos = 'NUM' AND na IS NOT NULL THEN row(na, 'nummod')
    WHEN n.pos = 'ADP' AND na IS NOT NULL THEN row(na, 'case') WHEN n.pos = 'CCONJ' AND na IS NOT NULL THEN row(na, 'cc')
    WHEN n.pos = 'AUX' AND n.lemma = 'be' AND v.morph = 'Tense=Past' THEN row(va, 'aux:pass') WHEN n.pos = 'AUX' AND va IS NOT NULL THEN row(va, 'aux') WHEN n.pos = 'PART' AND va IS NOT NULL THEN row(va, 'neg') WHEN n.pos = 'ADV' AND va IS NOT NULL THEN row(va, 'advmod')
    WHEN n.pos = 'VERB' AND word_before IN ('who', 'which', 'qui') AND nb IS NOT NULL THEN row(nb, 'relcl') WHEN n.pos = 'VERB' THEN row(root, 'conj')
    WHEN n.pos = 'NOUN' AND na = n.token_idx + 1 THEN row(na, 'compound')
    WHEN n.pos = 'NOUN' AND h.pos IN ('VERB', 'AUX') AND n.token_idx < root AND coalesce(na > root, true) THEN row(root, 'nsubj')
    WHEN n.pos = 'NOUN' AND h.pos IN ('VERB', 'AUX') AND n.token_idx > root AND coalesce(nb < root, true) THEN row(root, 'obj')
    WHEN n.pos = 'NOUN' AND nb IS NOT NULL AND before <> 'NOUN' THEN row(nb, 'nmod')
    WHEN n.pos = 'PRON' AND n.token_idx < root THEN row(root, 'nsubj') WHEN n.pos = 'PRON' THEN row(root, 'obj') ELSE row(root, 'dep') END AS rel
    FROM near n LEFT JOIN x v ON v.doc_id = n.doc_id AND v.sentence_idx = n.sentence_idx AND v.token_idx = va LEFT JOIN x h ON h.doc_id = n.doc_id AND h.sentence_idx = n.sentence_idx AND h.token_idx = root)
""")
HEAD = "JOIN p h ON h.doc_id = t.doc_id AND h.sentence_idx = t.sentence_idx AND h.token_idx = t.dep_head - 1"
EV = "t.doc_id || ':' || t.sentence_idx || ':' || t.token_idx AS evidence_id"
GRAMMAR = f"""p AS MATERIALIZED ({PARSED}), g AS (
  SELECT t.doc_id, t.sentence_idx, t.token_idx, 'passive' AS pattern, t.text AS marker, h.text AS target, {EV} FROM p t {HEAD} WHERE t.dep_rel IN ('aux:pass', 'auxpass')
  UNION ALL SELECT t.doc_id, t.sentence_idx, t.token_idx, 'modal', t.text, h.text, {EV} FROM p t {HEAD} WHERE t.dep_rel = 'aux' AND lower(t.lemma) IN {words(lexicons.MODALS)}
  UNION ALL SELECT t.doc_id, t.sentence_idx, t.token_idx, 'negation', t.text, NULL, {EV} FROM p t WHERE t.dep_rel = 'neg' OR (t.pos = 'PART' AND contains(coalesce(t.morph, ''), 'Neg'))
  UNION ALL SELECT t.doc_id, t.sentence_idx, t.token_idx, 'relative_clause', t.text, NULL, {EV} FROM p t WHERE t.dep_rel IN ('acl:relc', 'relcl')
  UNION ALL SELECT t.doc_id, t.sentence_idx, t.token_idx, 'complex_np', t.marker, t.target, {EV} FROM (SELECT t.doc_id, t.sentence_idx, h.token_idx, string_agg(t.text, ' ' ORDER BY t.token_idx) AS marker, h.text AS target FROM p t {HEAD} WHERE h.pos = 'NOUN' AND t.dep_rel IN ('amod', 'nmod', 'compound', 'nummod', 'appos') GROUP BY ALL HAVING count(*) >= 2) t
  UNION ALL SELECT t.doc_id, t.sentence_idx, t.token_idx, 'tense', CASE WHEN contains(morph, 'Tense=Past') THEN 'past' WHEN contains(morph, 'Tense=Pres') THEN 'present' ELSE 'future' END, t.text, {EV} FROM p t WHERE pos IN ('VERB', 'AUX') AND regexp_matches(morph, 'Tense=(Past|Pres|Fut)'))"""
WORD_COUNTS = with_tokens(ALL, "SELECT source, word, o, sum(o) OVER (PARTITION BY word) AS r, sum(o) OVER (PARTITION BY source) AS c, sum(o) OVER () AS n FROM (SELECT source, lower(text) AS word, count(*) AS o FROM toks GROUP BY ALL) QUALIFY r >= 100")
D = "o::DOUBLE AS o, r::DOUBLE AS r, c::DOUBLE AS c, n::DOUBLE AS n"
ALIGN = f"""WITH base AS ({ALL}), {TEXT_TOKENS}, pr AS (SELECT a.doc_id, b.doc_id AS target_id, a.sentence_idx::INT AS sentence_idx, a.sentence AS source, b.sentence AS target FROM sents a JOIN sents b ON b.doc_id = a.doc_id + 1 AND b.sentence_idx = a.sentence_idx WHERE a.lang = 'en')"""
ALIGN_LEFT = ALIGN.replace("FROM sents a JOIN", "FROM sents a LEFT JOIN")
ATT = lexicons.ATTESTED


def metadiscourse(base: str, taxonomy: dict[str, list[str]]) -> str:
    parts = []
    for k, xs in taxonomy.items():
        single = [x.lower() for x in xs if " " not in x and "." not in x]
        phrase = [" ".join(x.lower().replace(".", " ").split()) for x in xs if " " in x or "." in x]
        e = f"len(list_filter(ts, lambda t: list_contains([{', '.join(map(text, single))}]::VARCHAR[], t)))"
        e += "".join(f" + contains(line, {text(' ' + x + ' ')})::INT" for x in phrase)
        parts.append(f"SELECT {text(k)} AS category, coalesce(sum({e}), 0)::BIGINT AS freq FROM low")
    union = " UNION ALL ".join(parts)
    return with_tokens(base, f"SELECT category, freq, round(CASE WHEN n > 0 THEN freq / n * 1e6 ELSE 0 END, 2) AS per_million FROM ({union}), (SELECT coalesce(sum(len(ts)), 0) AS n FROM low)", ", low AS (SELECT list_transform(toks, lambda t: lower(t)) AS ts, ' ' || lower(array_to_string(toks, ' ')) || ' ' AS line FROM sent_toks)")


SENT = with_tokens(EN, "", f""", h AS (SELECT doc_id, sentence_idx::INT AS sentence_idx, len(list_filter(toks, lambda t: lower(t) IN {{p}}))::INT AS pos_hits, len(list_filter(toks, lambda t: lower(t) IN {{n}}))::INT AS neg_hits FROM sent_toks),
  sc AS (SELECT *, (pos_hits - neg_hits) / (pos_hits + neg_hits + 1) AS s FROM h)""".replace("{{", "{").replace("}}", "}"))


def sentiment(p: list[str], n: list[str], rest: str) -> str:
    return SENT.replace("{p}", words(p)).replace("{n}", words(n)) + rest


LABEL = "CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'neutral' END"
BOTH_SIDES = "SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})"

ORACLE: dict[str, str] = {
    "freq_word": with_tokens(EN, "SELECT item, freq, round(freq / total_tokens * 1e6, 2) AS per_million, round(freq / total_tokens * 100, 4) AS percent, total_tokens, total_types FROM c, (SELECT sum(freq)::BIGINT AS total_tokens, count(*) AS total_types FROM c) ORDER BY freq DESC, item LIMIT 100", ", c AS (SELECT lower(text) AS item, count(*) AS freq FROM toks GROUP BY 1)"),
    "freq_word_min5": with_tokens(ALL, "SELECT item, freq, round(freq / total_tokens * 1e6, 2) AS per_million, round(freq / total_tokens * 100, 4) AS percent, total_tokens, total_types FROM c, (SELECT sum(freq)::BIGINT AS total_tokens, count(*) AS total_types FROM c) WHERE freq >= 5", ", c AS (SELECT text AS item, count(*) AS freq FROM toks GROUP BY 1)"),
    "freq_per_language": with_tokens(ALL, "SELECT lang, lower(text) AS text_lc, count(*) AS freq FROM toks GROUP BY ALL"),
    "corpus_stats": stats_all(ALL),
    "type_token_by_lang": stats(ALL, "lang") + " SELECT lang, documents, sentences, tokens, types, round(types / tokens, 6) AS ttr FROM d JOIN s USING (lang) JOIN n USING (lang) JOIN types USING (lang)",
    "sttr_en": with_tokens(EN, "SELECT round(CASE WHEN chunks > 1 THEN mean ELSE ttr END, 6) AS sttr, chunks FROM (SELECT avg(t / 1000) AS mean, count(*) AS chunks FROM ch WHERE k = 1000), (SELECT count(DISTINCT text) / count(*) AS ttr FROM toks)", ", ch AS (SELECT c, count(*) AS k, count(DISTINCT text) AS t FROM (SELECT text, (row_number() OVER (ORDER BY doc_id, sentence_idx, token_idx) - 1) // 1000 AS c FROM toks) GROUP BY c)"),
    "kwic_the": kwic(EN, "lower(node) = 'the'", 5),
    "kwic_page": kwic(EN, "lower(node) = 'the'", 5, "ORDER BY doc_id, sentence_idx, token_idx LIMIT 100 OFFSET 50"),
    "kwic_wildcard": kwic(ALL, "lower(node) LIKE 'th_n%'", 5),
    "kwic_case_sensitive": kwic(ALL, "node = 'The'", 3),
    "kwic_total": with_tokens(ALL, "SELECT count(*) AS total FROM toks WHERE lower(text) = 'the'"),
    "kwic_accent_folded": with_tokens(ALL, "SELECT doc_id, sentence_idx::INT AS sentence_idx, count(*) AS n FROM toks WHERE strip_accents(lower(text)) = 'ele' GROUP BY ALL"),
    "kwic_compare": BOTH_SIDES.format(a="SELECT *, 'target' AS side FROM (" + kwic("SELECT * FROM documents WHERE source = 'src1'", "lower(node) = 'the'", 5, "ORDER BY doc_id, sentence_idx, token_idx LIMIT 20") + ")", b="SELECT *, 'reference' AS side FROM (" + kwic("SELECT * FROM documents WHERE source = 'src2'", "lower(node) = 'the'", 5, "ORDER BY doc_id, sentence_idx, token_idx LIMIT 20") + ")"),
    "colloc_of": colloc("node_sentences"),
    "colloc_of_textbook": colloc("corpus"),
    "keyness_source_vs_rest": keyness(token_words(EN + " AND source = 'src1'"), token_words(EN + " AND source <> 'src1'")),
    "keyness_top": keyness(token_words(EN + " AND source = 'src1'"), token_words(EN + " AND source <> 'src1'"), tail="WHERE direction = 'positive' ORDER BY log_likelihood DESC, term LIMIT 50"),
    "keyness_conversation_roles": keyness(token_words("SELECT * FROM conversations WHERE role = 'user'"), token_words("SELECT * FROM conversations WHERE role = 'assistant'")),
    "keyness_quality_labels": keyness(token_words("SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality = 1"), token_words("SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality = 0")),
    "keyness_vs_freq_list": keyness(token_words(EN), token_words("SELECT item_id AS doc_id, text FROM benchmark")),
    "dispersion_the": dispersion(EN, "doc_id"),
    "dispersion_by_source": dispersion(ALL, "source"),
    "bigrams": ngrams(2, "count(*) >= 5"),
    "trigrams_bundles": ngrams(3, "count(*) >= 3 AND count(DISTINCT doc_id) >= 2"),
    "ngrams_skip_stop": ngrams(2, "count(*) >= 3", f"list_filter(toks, lambda t: lower(t) NOT IN {words(lexicons.STOP_WORDS_EN)})"),
    "sentiment_sentences": sentiment(ATT["positive"], ATT["negative"], f" SELECT doc_id, sentence_idx, pos_hits, neg_hits, round(s, 6) AS score, {LABEL} AS label FROM sc"),
    "sentiment_summary": sentiment(lexicons.POSITIVE, lexicons.NEGATIVE, f" SELECT count(*) AS sentences, count(*) FILTER (l = 'positive') AS positive, count(*) FILTER (l = 'negative') AS negative, count(*) FILTER (l = 'neutral') AS neutral, round(coalesce(avg(round(s, 6)), 0), 3) + 0 AS avg_score FROM (SELECT s, {LABEL} AS l FROM sc)"),
    "discourse_categories": metadiscourse(EN, ATT["metadiscourse"]),
    "discourse_default_lexicon": metadiscourse(ALL, lexicons.METADISCOURSE),
    "vocab_bands": with_tokens(ALL, "SELECT band, sum(f)::BIGINT AS freq, count(*) AS types, round(sum(f) / (SELECT sum(f) FROM c) * 100, 4) AS percent FROM c GROUP BY band", f", c AS (SELECT CASE WHEN w IN {words(ATT['basic'])} THEN 'K1' WHEN w IN {words(ATT['academic'])} THEN 'AWL' ELSE 'Off-list' END AS band, f FROM (SELECT lower(text) AS w, count(*) AS f FROM toks GROUP BY 1))"),
    "rare_words": with_tokens(ALL, "SELECT lower(text) AS text_lc, count(*) AS freq FROM toks GROUP BY 1 HAVING count(*) <= 1 ORDER BY 1 LIMIT 100"),
    "clean_basic": digest(rf"SELECT doc_id, lower({collapse(chr(39).join(['regexp_replace(regexp_replace(text, ', '&[a-zA-Z]+;|&#\\d+;', ', ', ' ', ', ', 'g', '), ', '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', ', ', ' ', ', ', 'g', ')']))}) AS t1 FROM documents".replace("\\\\d", "\\d").replace("\\\\.", "\\."), finish("t1")),
    "clean_stopwords": digest(f"SELECT doc_id, lower(regexp_replace({collapse('text')}, {PUNCT}, ' ', 'g')) AS t1 FROM documents", finish(STOPPED)),
    "clean_min_len": digest(f"SELECT doc_id, {collapse('text')} AS t1 FROM documents", finish(f"array_to_string(list_filter({split_words('t1')}, lambda t: length(trim(t, {EDGES})) >= 4), ' ')")),
    "clean_corpus_effect": f"SELECT 'before' AS state, documents, tokens, types FROM ({stats_all(ALL)}) UNION ALL SELECT 'after', documents, tokens, types FROM ({stats_all(f'SELECT doc_id, {finish(STOPPED)} AS text FROM (SELECT doc_id, lower({collapse(chr(116) + chr(101) + chr(120) + chr(116))}) AS t1 FROM documents)')})",
    "html_text": rf"SELECT page_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g'), '\s*\n\s*', chr(10), 'g'), {WS}) AS c FROM pages)",
    "persuasion_markers": claim_sql([(k, f"{markers('t', w)} > 0", f"least(1.0::DOUBLE, {markers('t', w)} / 3)") for k, w in lexicons.PERSUASION.items()] + [("argument_structure", f"{markers('t', lexicons.TOULMIN)} > 0", "0.6")]),
    "framing_markers": claim_sql([(k, f"{markers('t', w)} > 0", "0.6") for k, w in lexicons.FRAMING.items()]),
    "narrative_stages": claim_sql([("abstract", f"{markers('coalesce(list_filter(string_split(t, chr(46)), lambda s: length(trim(s)) > 0)[1], chr(32))', lexicons.NARRATIVE_OPENING)} > 0", "0.5")] + [(k, f"{markers('t', w)} > 0", "0.5") for k, w in lexicons.NARRATIVE.items()]),
    "cultural_markers": claim_sql([(k, f"{markers('t', w)} > 0", "0.5") for k, w in lexicons.ATTESTED["cultural"].items()]),
    "top_words": r"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE length(word) >= 2 GROUP BY word ORDER BY freq DESC, word LIMIT 50",
    "register_scores": r"SELECT doc_id, round(c / (c + d + 1), 3) AS classical, round(1 / (c + d + 1), 3) AS msa, round(d / (c + d + 1), 3) AS dialectal FROM (SELECT doc_id, len(list_intersect(w, ['the', 'der', 'una'])) AS c, len(list_intersect(w, ['of', 'and'])) AS d FROM (SELECT doc_id, list_distinct(regexp_split_to_array(text, '\s+')) AS w FROM documents))",
    "align_positional": ALIGN + " SELECT doc_id, target_id, sentence_idx, round(greatest(0, 1 - 0.5 * abs(1 - length(source) / length(target))), 6) AS confidence FROM pr",
    "parallel_kwic": ALIGN_LEFT + rf", w AS (SELECT doc_id, sentence_idx, target, {split_words('source')} AS w FROM pr) SELECT doc_id, sentence_idx, (i - 1)::INT AS token_idx, array_to_string(list_slice(w, greatest(i - 5, 1), i - 1), ' ') AS left_context, node, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS right_context, target FROM (SELECT *, unnest(w) AS node, generate_subscripts(w, 1) AS i FROM w) WHERE lower(node) = 'the'",
    "subcorpus_filter": "SELECT doc_id, lang FROM documents WHERE source = 'src5' AND (2000 + doc_id % 20)::VARCHAR BETWEEN '2005' AND '2010'",
    "delete_documents": stats_all("SELECT * FROM documents WHERE doc_id NOT IN (0, 1, 2, 3)"),
    "ai_disclosure": "SELECT count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'user') AS user_turns, count(DISTINCT conv_id) AS conversations, (SELECT string_agg(role, ',' ORDER BY role) FROM (SELECT DISTINCT role FROM conversations)) AS roles FROM conversations",
    "measures_by_source": f"SELECT source, word, round(log2(o / (r * c / n)), 6) + 0 AS mi, round((o - r * c / n) / sqrt(o), 6) + 0 AS t_score, round(2 * o / (r + c), 6) AS dice, round(14 + log2(2 * o / (r + c)), 6) + 0 AS log_dice, round({ll('o', 'r', 'c', 'n')}, 6) AS ll, round({chi('o', 'r', 'c', 'n')}, 6) AS chi2, round(o / r - CASE WHEN n - r > 0 THEN (c - o) / (n - r) ELSE 0 END, 6) + 0 AS dp_yx, round(o / c - CASE WHEN n - c > 0 THEN (r - o) / (n - c) ELSE 0 END, 6) + 0 AS dp_xy, round((o / c * 1e6 + 1) / (r / n * 1e6 + 1), 6) AS simple FROM (SELECT source, word, {D} FROM ({WORD_COUNTS}))",
    "dispersion_by_word": f"WITH k AS MATERIALIZED ({WORD_COUNTS}), t AS (SELECT word, coalesce(o, 0) AS f FROM (SELECT DISTINCT word FROM k) CROSS JOIN (SELECT DISTINCT source FROM documents) LEFT JOIN k USING (word, source)), s AS (SELECT word, sum(f) AS total, count(*) AS n, avg(f) AS mean, stddev_pop(f) AS sd FROM t GROUP BY word) SELECT word, round(max(CASE WHEN n < 2 THEN 1 ELSE greatest(0, 1 - sd / mean / sqrt(n - 1)) END), 6) AS d, round(0.5 * sum(abs(f / total - 1 / n)), 6) AS dp FROM t JOIN s USING (word) GROUP BY word",
    "grammar": f"WITH {GRAMMAR} SELECT * FROM g",
    "grammar_counts": f"WITH {GRAMMAR}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id, sentence_idx, token_idx, evidence_id) AS k FROM g) SELECT pattern, freq, examples FROM (SELECT pattern, count(*) AS freq FROM g GROUP BY pattern) JOIN (SELECT pattern, string_agg(evidence_id, ',' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY pattern) USING (pattern)",
    "pos_distribution": f"WITH p AS MATERIALIZED ({PARSED}) SELECT pos, count(*) AS freq, round(count(*) / (SELECT count(*) FROM p) * 100, 4) AS percent FROM p GROUP BY pos",
    "pos_bigrams": f"WITH p AS MATERIALIZED ({PARSED}) SELECT pattern, count(*) AS freq FROM (SELECT pos || ' ' || lead(pos) OVER (PARTITION BY doc_id, sentence_idx ORDER BY token_idx) AS pattern FROM p) WHERE pattern IS NOT NULL GROUP BY pattern",
    "dependency_pairs": f"WITH p AS MATERIALIZED ({PARSED}) SELECT h.lemma AS governor, t.lemma AS dependent, count(*) AS freq FROM p t {HEAD} WHERE t.dep_rel = 'nsubj' GROUP BY ALL",
    "metaphor_candidates": f"WITH p AS MATERIALIZED ({PARSED}), s AS (SELECT doc_id, sentence_idx, dep_head - 1 AS v, arg_min(lemma, token_idx) AS lemma, arg_min(pos, token_idx) AS pos FROM p WHERE dep_rel = 'nsubj' GROUP BY ALL) SELECT t.doc_id, t.sentence_idx, t.token_idx, lower(t.lemma) AS verb, s.lemma AS subject, {EV} FROM p t JOIN s ON s.doc_id = t.doc_id AND s.sentence_idx = t.sentence_idx AND s.v = t.token_idx WHERE t.pos = 'VERB' AND lower(t.lemma) NOT IN {words(lexicons.LIGHT_VERBS)} AND s.pos = 'NOUN' AND lower(s.lemma) NOT IN {words(lexicons.CONCRETE_NOUNS)}",
}


RECIPE = " AND ".join(f"coalesce({c}, '') <> ''" for c in ("backend", "model_name", "model_version"))
CHECKS = {"annotation_version": ("token_count > 0", "fail"), "ai_nondeterminism": ("coalesce(ai_turns, 0) = 0", "warn"), "pipeline_recipe": (RECIPE, "fail"), "documents": ("document_count > 0", "fail")}
LETTERS, SIGNS = (text(x) for x in BUCKWALTER)

ORACLE |= {
    "colloc_top": f"SELECT * FROM ({colloc('corpus')}) ORDER BY coalesce(nullif(log_likelihood, 0), nullif(mi, 0), o) DESC, collocate LIMIT 100",
    "collocation_network": f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY log_likelihood DESC, collocate) - 1 AS k FROM ({colloc('corpus')}) ORDER BY log_likelihood DESC, collocate LIMIT 20)
      SELECT collocate, round(cos(2 * pi() * k / (SELECT count(*) FROM t)), 6) + 0 AS x, round(sin(2 * pi() * k / (SELECT count(*) FROM t)), 6) + 0 AS y,
      round(greatest(0.5, 4 * abs(log_likelihood) / (SELECT max(abs(log_likelihood)) FROM t)), 4) AS edge_width, round(12 + 18 * o / (SELECT max(o) FROM t), 4) AS radius FROM t""",
    "precheck": f"""WITH c AS (SELECT source AS corpus, sum(n_chars) AS token_count, count(*) FILTER (n_chars > 10000) AS ai_turns, 'regex' AS backend, max(lang) AS model_name, CASE WHEN count(*) % 2 = 0 THEN '1' END AS model_version, count(*) - 1 AS document_count FROM documents GROUP BY 1),
      s AS ({" UNION ALL ".join(f"SELECT corpus, '{k}' AS ck, CASE WHEN {ok} THEN 'pass' ELSE '{bad}' END AS status FROM c" for k, (ok, bad) in CHECKS.items())})
      SELECT corpus, CASE WHEN bool_or(status = 'fail') OVER w THEN 'fail' WHEN bool_or(status = 'warn') OVER w THEN 'warn' ELSE 'pass' END AS overall, ck AS "check", status FROM s WINDOW w AS (PARTITION BY corpus)""",
    "lemma_kwic": f"""WITH p AS MATERIALIZED ({PARSED}) SELECT t.doc_id, t.sentence_idx, t.token_idx,
      coalesce((SELECT string_agg(c.text, ' ' ORDER BY c.token_idx) FROM p c WHERE c.doc_id = t.doc_id AND c.sentence_idx = t.sentence_idx AND c.token_idx BETWEEN t.token_idx - 2 AND t.token_idx - 1), '') AS left_context, t.text AS node,
      coalesce((SELECT string_agg(c.text, ' ' ORDER BY c.token_idx) FROM p c WHERE c.doc_id = t.doc_id AND c.sentence_idx = t.sentence_idx AND c.token_idx BETWEEN t.token_idx + 1 AND t.token_idx + 2), '') AS right_context
      FROM p t WHERE t.lemma = 'be'""",
}

#: Bytes of texts as pixels of images 48 wide, and the mean colours of three by three cells.
REGIONS = """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs, strlen(text) AS n FROM documents),
      bytes AS (SELECT doc_id, n, unnest(range(1, n + 1)) - 1 AS i, ('0x' || unnest(hs))::INT AS v FROM h),
      size AS (SELECT doc_id, greatest(3, ((n + 431) // 432) * 3) AS height FROM h),
      cells AS (SELECT doc_id, i % 3 AS channel, (i // 144) // (height // 3) * 3 + (i // 3) % 48 // 16 AS region, sum(v) AS s FROM bytes JOIN size USING (doc_id) GROUP BY ALL),
      grid AS (SELECT doc_id, height, region FROM size, range(9) t(region)),
      regions AS (SELECT doc_id AS image_id, region, round((region % 3 * 16 + 8) / 48, 3) AS x, round((region // 3 + 0.5) / 3, 3) AS y, coalesce(sum(s) FILTER (channel = 0), 0) // (height // 3 * 16) AS r,
        coalesce(sum(s) FILTER (channel = 1), 0) // (height // 3 * 16) AS g, coalesce(sum(s) FILTER (channel = 2), 0) // (height // 3 * 16) AS b FROM grid LEFT JOIN cells USING (doc_id, region) GROUP BY doc_id, region, height)"""
CAPTION_COLOUR = "[" + ", ".join(map(text, fixtures.CAPTION_COLOURS)) + "][doc_id % 5 + 1]"
COLOUR_ROWS = ", ".join(f"('{k}', {r}, {g}, {b})" for k, (r, g, b) in vision.COLOURS.items())
PLACES = " ".join(f"WHEN span = '{k}' THEN CASE WHEN {rule} THEN 0.7 ELSE 0.0 END" for k, rule in vision.POSITIONS.items())
TERMS = ", ".join(f"'{k}'" for k in [*vision.COLOURS, *vision.POSITIONS])
REDACTED = text(lexical.keyword_pattern(ATT["redaction"]))

ORACLE |= {
    "region_alignment": rf"""{REGIONS}, r AS (SELECT image_id, region, x, y, r, g, b FROM regions),
      c AS (SELECT doc_id AS image_id, 'A ' || {CAPTION_COLOUR} || ' page, ' || source || ', with (left) text at the bottom in ' || lang AS caption FROM documents), w AS (SELECT image_id, string_split_regex(lower(caption), '\s+') AS ws FROM c),
      t AS (SELECT image_id, (i - 1)::INT AS "at", regexp_replace(ws[i], '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') AS span FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
      s AS (SELECT * FROM t WHERE (length(span) >= 4 OR span IN ({TERMS})) AND span NOT IN ('with', 'this', 'that')),
      k AS (SELECT * FROM (VALUES {COLOUR_ROWS}) v(name, cr, cg, cb))
      SELECT * FROM (SELECT r.image_id, region, "at", span, round(coalesce(CASE WHEN name IS NOT NULL THEN greatest(0.0, 1 - 2 * sqrt((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)) / (sqrt(3.0) * 255)) END, CASE {PLACES} END, 0.2)::DOUBLE, 6) AS score
      FROM r JOIN s ON r.image_id = s.image_id LEFT JOIN k ON span = name) WHERE score > 0.1""",
    "redact_sentences": rf"""WITH s AS (SELECT doc_id, text, regexp_matches(text, {REDACTED}) AS hit, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
      SELECT doc_id, hit AS was_filtered, (1 + len(list_filter(parts, lambda x: regexp_matches(x, {REDACTED}))))::BIGINT AS parts,
      md5(CASE WHEN hit THEN array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, {REDACTED}) THEN {text(lexicons.REDACTION_MARK)} ELSE x END), ' ') ELSE text END) AS digest FROM s""",
}

CAPTIONED = f"""SELECT doc_id AS image_id, coalesce(text, '') AS caption, coalesce(source, '') AS ocr, (doc_id % 21 - 10) / 10 AS warm, (doc_id % 11) / 10 AS sat,
  doc_id % 256 AS bright, (doc_id % 8) / 8 AS centre, doc_id % {len(fixtures.DOMINANT)} AS hue, string_split_regex(lower(coalesce(text, '')), '\\s+') AS ws,
  lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS said FROM documents"""


def readings(rules: list[tuple[str, str, str]], base: str = CAPTIONED, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT image_id, '{k}' AS category, round(({v})::DOUBLE, 6) AS confidence{more} FROM ({base}) WHERE {ok}" for k, ok, v in rules)


def one_of(x: str, ws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in ws) + ")"


def how_many(x: str, ws: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {text(w)})::INT" for w in ws) + ")"


def words_in(ws: list[str]) -> str:
    return "(" + " + ".join(f"list_contains(ws, {text(w)})::INT" for w in ws) + ")"


GROUPS = words_in(lexicons.IN_GROUP + lexicons.OUT_GROUP)
TONE = "CASE WHEN warm > 0.2 AND bright > 150 THEN 'positive/warm' WHEN warm < -0.2 AND bright < 100 THEN 'negative/cold' WHEN bright > 200 THEN 'positive/bright' ELSE 'neutral' END"
FEELINGS = f"SELECT image_id, {TONE} AS tone, {how_many('said', lexicons.GLAD_WORDS)} AS glad, {how_many('said', lexicons.SAD_WORDS)} AS sad FROM ({CAPTIONED})"
CDA = {
    "fairclough": [("textual_analysis", "caption <> '' OR ocr <> ''", "0.5"), ("ideological_naturalization", "sat > 0.5", "least(1, sat)")],
    "van_dijk": [("us_them_polarization", f"{GROUPS} > 0", f"least(1, {GROUPS} / 5)")],
    "wodak": [("historical_context", "TRUE", "0.4")],
    "machin_mayr": [("visual_evaluative_loading:warm", "warm > 0.2", "least(1, abs(warm))"), ("visual_evaluative_loading:cold", "warm < -0.2", "least(1, abs(warm))")],
}


def parts(by: str) -> str:
    return with_tokens(ALL, f"SELECT {by} AS part, count(*) FILTER (lower(text) = 'the') AS freq, count(*) AS tokens FROM toks GROUP BY 1")


ORACLE |= {
    "social_semiotic": readings(
        [
            *((f"symbolic_attribute:{k}", f"hue = {i}", "0.5") for i, k in enumerate(["red", "yellow", "green", "blue", "purple"])),
            ("symbolic_attribute:high_key", "bright > 200", "0.5"),
            ("symbolic_attribute:low_key", "bright < 60", "0.5"),
            ("power_relation", "centre > 0.6", "least(1, 2 * (centre - 0.5))"),
            ("identity", one_of("lower(caption)", lexicons.FIRST_PERSON), "0.6"),
        ]
    ),
    "critical_discourse": " UNION ALL ".join(readings(rules, more=f", '{k}' AS framework") for k, rules in CDA.items()),
    "visual_metaphor": readings(
        [
            ("visual_metaphor_candidate", "warm > 0.3 AND sat > 0.4", "0.4"),
            ("cross_modal_metaphor_candidate", f"caption <> '' AND ocr <> '' AND warm > 0.2 AND {one_of('said', lexicons.COLD_WORDS)}", "0.3"),
        ]
    ),
    "combined_emotion": readings(
        [
            *((f"image_emotion:{k}", f"tone = '{k}'", "0.5") for k in ("positive/warm", "negative/cold", "positive/bright", "neutral")),
            ("text_emotion:positive", "glad > sad", "least(1, (glad + sad) / 5)"),
            ("text_emotion:negative", "glad + sad > 0 AND glad <= sad", "least(1, (glad + sad) / 5)"),
            ("emotional_mismatch", "tone LIKE 'positive%' AND glad + sad > 0 AND glad <= sad", "0.4"),
        ],
        FEELINGS,
    ),
    "dispersion_parts": f"""SELECT b.source, coalesce(freq, 0) AS freq, coalesce(tokens, 0) AS tokens FROM (SELECT DISTINCT source FROM documents) b
      LEFT JOIN ({parts('source')}) p ON b.source IS NOT DISTINCT FROM p.part""",
    "dispersion_weighted": f"""WITH q AS (SELECT coalesce(freq, 0) AS f, coalesce(tokens, 0) AS n FROM (SELECT DISTINCT doc_id FROM documents) b LEFT JOIN ({parts('doc_id')}) p ON doc_id = part)
      SELECT coalesce(sum(f), 0)::BIGINT AS frequency, count(*) AS parts, round(coalesce(sum(abs(f / nullif((SELECT sum(f) FROM q), 0) - n / nullif((SELECT sum(n) FROM q), 0))) / 2, 0.0), 6) AS weighted_dp FROM q""",
}

GRAMS = r"""
x AS (SELECT doc_id, lang, length(text) AS n_chars, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents WHERE regexp_matches(text, '\p{L}')),
grams AS (SELECT doc_id, lang, n_chars, unnest(list_concat(list_filter(c, lambda y: y <> ' '), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM x)
"""
PROFILES = "SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM (SELECT lang, gram, count(*) AS n FROM grams WHERE lang IS NOT NULL {more} GROUP BY ALL) QUALIFY rank <= 300"
ORACLE |= {
    "language_profiles": f"WITH {GRAMS} {PROFILES.format(more='')}",
    "detect_languages": f"""WITH {GRAMS}, p AS MATERIALIZED ({PROFILES.format(more='')}),
      own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM (SELECT doc_id, gram, count(*) AS n FROM grams WHERE n_chars > 100 GROUP BY ALL) QUALIFY r <= 300),
      far AS (SELECT doc_id, k.lang, sum(coalesce(abs(p.rank - r), 300))::BIGINT AS d FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) k LEFT JOIN p ON p.lang = k.lang AND p.gram = own.gram GROUP BY ALL),
      best AS (SELECT doc_id, list(lang ORDER BY d, lang) AS l, list(d ORDER BY d, lang) AS d FROM far GROUP BY ALL)
      SELECT doc_id, coalesce(l[1], 'en') AS detected, d[1] AS distance, d[2] AS runner_up FROM documents LEFT JOIN best USING (doc_id)""",
}

ORACLE["rule_annotation"] = f"""WITH p AS MATERIALIZED ({PARSED}) SELECT t.lang, t.pos, t.dep_rel, t.morph, h.pos AS head_pos, count(*) AS freq, sum(t.dep_head)::BIGINT AS heads, count(DISTINCT t.lemma) AS lemmas, max(h.lemma) AS last_head, count(*) FILTER (t.lw IN {words(lexicons.STOP_WORDS_EN)}) AS stop_words FROM p t LEFT {HEAD} GROUP BY ALL"""

IN_ARABIC = f"SELECT doc_id, lang, translate(lower(text), {text(fixtures.LATIN)}, {text(fixtures.ARABIC)}) AS text FROM documents"


def plain(x: str) -> str:
    return f"regexp_replace({x}, {text(DIACRITICS)}, '', 'g')"


PREFIX_ROWS = [(form, kind, parts, other) for form, kind, parts in arabic.prefixes() for other in arabic.TOGETHER[kind]]
TEMPLATE_ROWS = [(i, t, tag, broken, *(t.index(x) + 1 for x in "فعل")) for i, (t, tag, broken) in enumerate(arabic.TEMPLATES)]
#: All readings of all words, the best one first; templates are compared letter by letter.
ARABIC_WORDS = f"""WITH base AS ({IN_ARABIC}), {TEXT_TOKENS},
  freq AS (SELECT text AS word, count(*) AS freq FROM toks WHERE regexp_matches(text, {text(arabic.SCRIPT)}) GROUP BY 1),
  w AS (SELECT word, translate(replace({plain("word")}, 'ـ', ''), 'أإآٱ', 'اااا') AS w FROM freq),
  pre AS ({values(PREFIX_ROWS, "prefix, pk, pp, sk")}), suf AS ({values(arabic.suffixes(), "suffix, sk, sp")}), tem AS ({values(TEMPLATE_ROWS, "number, template, tag, broken, a, b, c")}),
  cut AS (SELECT word, pk, pp, pre.sk, sp, substring(w, length(prefix) + 1, length(w) - length(prefix) - length(suffix)) AS stem, length(prefix) + length(suffix) AS affixes FROM w JOIN pre ON starts_with(w, prefix) JOIN suf ON suf.sk = pre.sk AND ends_with(w, suffix) AND length(prefix) + length(suffix) + 3 <= length(w) WHERE w NOT IN {words(arabic.PARTICLES)}),
  fit AS (SELECT *, stem[a] || stem[b] || stem[c] AS root, starts_with(pk, 'verb') OR starts_with(sk, 'verb') AS verbal, pk IN ('noun', 'article') OR starts_with(sk, 'noun') AS nominal FROM cut JOIN tem ON length(stem) = length(template)
    AND len(list_filter(range(1, length(template) + 1), lambda i: i NOT IN (a, b, c) AND stem[i] <> template[i])) = 0),
  best AS (SELECT * FROM fit WHERE CASE WHEN verbal THEN tag IN ('verb', 'any') WHEN nominal THEN tag <> 'verb' ELSE true END
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY len(list_distinct(list_filter(string_split(translate(root, 'اويىءئؤ', ''), ''), lambda x: x <> ''))) DESC, affixes, length(template) DESC, number, pk, sk, pp) = 1),
  named AS (SELECT word, freq, coalesce(pp, '') AS prefix, coalesce(stem, w) AS stem, coalesce(sp, '') AS suffix, coalesce(root, '') AS root, coalesce(template, '') AS template,
    CASE WHEN root IS NULL THEN CASE WHEN w IN {words(arabic.PARTICLES)} THEN 'part' ELSE 'x' END WHEN tag <> 'any' THEN tag WHEN verbal THEN 'verb' ELSE 'noun' END AS pos,
    CASE WHEN root IS NULL THEN '' WHEN broken OR regexp_matches(sp, '^(ات|ون|ين|وا|تم)') THEN 'p' WHEN sp = 'ان' THEN 'd' ELSE 's' END AS number,
    CASE WHEN root IS NULL THEN '' WHEN regexp_matches(sp, '^(ة|ات|ت)') THEN 'f' ELSE 'm' END AS gender, coalesce(broken, false) AS broken_plural FROM w JOIN freq USING (word) LEFT JOIN best USING (word)),
  words AS MATERIALIZED (SELECT *, array_to_string(list_filter([prefix, stem, suffix], lambda x: x <> ''), '+') AS segments, translate(word, {LETTERS}, {SIGNS}) AS buckwalter FROM named)"""
KNOWN_DIALECT = " ".join(f"WHEN {markers('text', ws)} > 0 THEN '{k}'" for k, ws in fixtures.DIALECTS.items())
ORACLE |= {
    "arabic_words": f"{ARABIC_WORDS} SELECT * FROM words",
    "arabic_roots": f"{ARABIC_WORDS} SELECT root, sum(freq)::BIGINT AS freq, count(*) AS words FROM words WHERE root <> '' GROUP BY root",
    "arabic_segments": f"{ARABIC_WORDS} SELECT lang, prefix, suffix, pos, number, gender, broken_plural, count(*) AS freq, count(DISTINCT stem) AS stems FROM toks JOIN words ON word = text GROUP BY ALL",
    "arabic_normalised": f"SELECT doc_id, md5(translate(text, 'أإآةى', 'اااهي')) AS normalised, md5(translate(text, {LETTERS}, {SIGNS})) AS buckwalter, md5({plain('text')}) AS plain FROM ({IN_ARABIC})",
    "dialect_heuristic": f"SELECT doc_id, CASE WHEN k = 'none' THEN 0.85 ELSE 0.3 END::DOUBLE AS msa, CASE WHEN k = 'egy' THEN 0.6 ELSE 0.05 END::DOUBLE AS egy, CASE WHEN k = 'glf' THEN 0.6 ELSE 0.05 END::DOUBLE AS glf, CASE WHEN k = 'lev' THEN 0.6 ELSE 0.05 END::DOUBLE AS lev FROM (SELECT doc_id, CASE {KNOWN_DIALECT} ELSE 'none' END AS k FROM ({IN_ARABIC}))",
}
ORACLE["charset_round_trip"] = "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents"
ORACLE["wikitext_plain"] = rf"""SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT doc_id, source || chr(10) || 'bold shown' || chr(10) || chr(10) ||
  regexp_replace(regexp_replace(text, {text(fixtures.NO_MARKUP)}, ' ', 'g').trim() || ' site here Plain', '^ +', '') || chr(10) || chr(10) || 'end' AS x FROM documents)"""
ORACLE |= {
    "image_regions": f"{REGIONS} SELECT image_id, region, x, y, r::INT AS r, g::INT AS g, b::INT AS b FROM regions",
    "image_pixels": "SELECT doc_id AS image_id, 48 AS width, greatest(3, ((strlen(text) + 431) // 432) * 3) AS height, md5(encode(text) || repeat(chr(0), CASE WHEN text = '' THEN 432 ELSE (432 - strlen(text) % 432) % 432 END)::BLOB) AS digest, NULL::VARCHAR AS error FROM documents",
}

CLEANED = f"SELECT doc_id, {finish(STOPPED)} AS text FROM (SELECT doc_id, lower({collapse('text')}) AS t1 FROM documents)"


def token_state(label: str, base: str, made: str) -> str:
    return f"SELECT '{label}' AS state, (SELECT count(*) FROM documents) AS documents, ({made}) AS made, * FROM (" + with_tokens(base, "SELECT count(*) AS tokens, count(DISTINCT lower(text)) AS types FROM toks") + ")"


ORACLE["corpus_versions"] = " UNION ALL ".join(
    [token_state("before", ALL, "SELECT count(*) FROM documents"), token_state("after", CLEANED, f"SELECT count(*) FROM documents d JOIN ({CLEANED}) c USING (doc_id) WHERE d.text IS DISTINCT FROM c.text")]
)
ORACLE |= {
    "manifest_tree": """WITH t AS (SELECT doc_id::VARCHAR AS name, sha256('=' || text || chr(0) || '=' || lang || chr(0) || '=' || source) AS digest FROM documents),
      l2 AS (SELECT left(sha256(name), 2) AS prefix, sha256(string_agg(name || ' ' || digest, chr(10) ORDER BY name)) AS digest, count(*) AS things FROM t GROUP BY 1),
      l1 AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(prefix || ' ' || digest, chr(10) ORDER BY prefix)) AS digest, sum(things)::BIGINT AS things FROM l2 GROUP BY 1),
      l0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || ' ' || digest, chr(10) ORDER BY prefix)) AS digest, sum(things)::BIGINT AS things FROM l1)
      SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""",
    "manifest_damage": "SELECT doc_id::VARCHAR AS name, CASE WHEN source = 'src3' THEN 'lost' ELSE 'changed' END AS change FROM documents WHERE source = 'src3' OR lang = 'es'",
}
ORACLE["archive_members"] = "SELECT kind, source || '/' || doc_id || '.txt' AS name, source AS genre, strlen(text) AS n_bytes, md5(text) AS digest FROM documents, (VALUES ('zip'), ('tar.gz')) k(kind)"
TOOL_ROWS = {
    "concordance": kwic(ALL, "lower(node) = 'the'", 5),
    "frequency": with_tokens(ALL, "SELECT lower(text) AS item FROM toks GROUP BY 1 HAVING count(*) >= 2"),
    "grammar": f"SELECT * FROM ({ORACLE['grammar']}) WHERE pattern IN ('modal', 'complex_np', 'tense')",
    "dependency_pairs": ORACLE["dependency_pairs"].replace("dep_rel = 'nsubj'", "dep_rel = 'obj'"),
    "tags": ORACLE["pos_distribution"],
    **dict.fromkeys(("languages", "redaction"), "SELECT * FROM documents"),
    "statistics": "SELECT 1",
}
ORACLE["tool_results"] = " UNION ALL ".join(f"SELECT '{k}' AS tool, count(*) AS n_rows FROM ({v})" for k, v in TOOL_ROWS.items())
ORACLE["event_windows"] = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"
ORACLE["dependency_examples"] = f"""WITH p AS MATERIALIZED ({PARSED}), f AS (SELECT h.lemma AS governor, t.lemma AS dependent, {EV}, row_number() OVER (PARTITION BY h.lemma, t.lemma ORDER BY t.doc_id, t.sentence_idx, t.token_idx) AS k FROM p t {HEAD} WHERE t.dep_rel = 'obj')
  SELECT governor, dependent, count(*) AS freq, string_agg(evidence_id, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM f GROUP BY ALL"""
