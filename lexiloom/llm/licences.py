"""Licence scan: Aho-Corasick over words, shunting-yard over licence expressions.

Texts are lower-cased (A-Z only) and reduced to their words, joined by single
spaces.  One Aho-Corasick automaton holds all notice phrases and identifier tags; a
hit counts where it ends at a word's end, so a phrase matches its words standing
consecutively whatever stands between them.  Behind a tag and its colon or equals
sign, the raw text is read token by token as a licence expression, as long as it is
one: a shunting-yard parser turns ``and``, ``or``, ``with`` and brackets into postfix
form, which is then evaluated: the licences named and how freely the text may be used.
Operands are identifiers of the list below, later versions of them, or references.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
#: Between a tag and its expression: a quote of the key, a colon or equals sign, a quote of the value.
ASSIGNED = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
#: The phrases and labels that every scan reports.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of the tags behind which an expression stands: source files, package metadata.
TAGS = ["spdx license identifier", "spdx licence identifier", "license expression", "license", "licence", "licenses"]
#: Notice phrases of well-known licences and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "this software is provided as is without any express or implied warranty": "zlib",
    "the unlicense": "unlicense",
    "free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "bsd license": "bsd",
    "2 clause bsd": "bsd-2-clause",
    "3 clause bsd": "bsd-3-clause",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nd",
    "cc by nd": "cc-by-nd",
    "open data commons attribution license": "odc-by",
    "open database license": "odbl",
    "public domain dedication": "public-domain",
    "in the public domain": "public-domain",
    "public domain": "public-domain",
    "no rights reserved": "public-domain",
    "some rights reserved": "some-rights",
    "not for commercial use": "non-commercial",
    "for non commercial use only": "non-commercial",
    "for research purposes only": "non-commercial",
    "do not distribute": "no-redistribution",
    "not for redistribution": "no-redistribution",
    "may not be reproduced": "no-redistribution",
    "reproduction in whole or in part": "no-redistribution",
    "unauthorized copying of this file": "proprietary",
    "proprietary and confidential": "proprietary",
    "trade secret": "proprietary",
}
#: Identifiers of licences in expressions (lower case); -only, -or-later and + may follow.
IDENTIFIERS = set("""
    0bsd aal afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0
    bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6
    cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
    cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b
    cecill-c cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0
    gpl-3.0 hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl
    mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sleepycat sspl-1.0
    unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
#: Exceptions that may stand behind ``with``.
EXCEPTIONS = set("""
    389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-3.0-linking-exception libtool-exception linux-syscall-note
    llvm-exception openssl-exception ocaml-lgpl-linking-exception qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1
""".split())
#: How freely a label allows reuse, 0 to 1; families by prefix, the longest counts.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "zlib": 1.0, "bsl": 1.0, "pddl": 1.0, "psf": 1.0, "postgresql": 1.0, "x11": 1.0,
    "cc-by": 0.9, "odc-by": 0.9, "ofl": 0.8, "artistic": 0.8, "afl": 0.8, "ms-pl": 0.8, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cpl": 0.6, "eupl": 0.5, "cc-by-sa": 0.6, "odbl": 0.5,
    "lgpl": 0.5, "osl": 0.4, "gfdl": 0.4, "gpl": 0.3, "agpl": 0.2, "sspl": 0.1, "busl": 0.1, "elastic": 0.1, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "non-commercial": 0.2,
    "reserved": 0.0, "proprietary": 0.0, "no-redistribution": 0.0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def is_licence(token: str) -> bool:
    """An identifier of the list, a later version of one, or a reference to a licence text."""
    plain = token.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return plain in IDENTIFIERS or re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", token) is not None


def freedom(label: str) -> float:
    """The freedom of a label's family; an unknown one counts half."""
    best = max((p for p in FREEDOM if label == p or label.startswith(p + "-")), key=len, default="")
    return FREEDOM.get(best, 0.5)


def to_postfix(text: str, at: int = 0) -> list[str]:
    """Shunting-yard: the lower-case expression that stands at a place of a text, in postfix order.

    Tokens are read one by one and reading stops before the first that cannot continue
    an expression, so prose behind it is not touched; an unclosed bracket is closed at
    the end and an operator without a right side is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, ahead = True, TOKEN.match(text, at)
    while ahead:
        token = ahead[1]
        if token not in "()":
            token = token.rstrip(".:")
        if operand and stack and stack[-1] == "with":
            if token not in EXCEPTIONS:
                break
            out.append(token)
            operand = False
        elif operand:
            if token == "(":
                stack.append(token)
            elif is_licence(token):
                out.append(token)
                operand = False
            else:
                break
        elif token in PRECEDENCE:
            if token == "with" and text[ahead.start() - 1] == ")":
                break  # an exception belongs to one licence
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        ahead = TOKEN.match(text, ahead.end())
    while operand and stack:  # what waits for an operand that never came
        if stack.pop() != "(":
            operand = False
    out += [t for t in reversed(stack) if t != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and its freedom: or takes the freest, and the least free; with adds an exception to its licence."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (b, fb), (a, fa) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x} with {y}" for x in a for y in b}, fa))
            else:
                stack.append((a | b, max(fa, fb) if token == "or" else min(fa, fb)))
        else:
            stack.append(({token}, freedom(token)))
    return stack[-1] if stack else (set(), 1.0)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags; a phrase that is both a notice and a base one reports as base."""
    found = ahocorasick.Automaton()
    entries = {t: (None, False) for t in TAGS} | {p: (v, False) for p, v in NOTICES.items()} | {p: (v, True) for p, v in BASE.items()}
    for phrase, (label, base) in entries.items():
        found.add_word(" " + phrase, (phrase.count(" ") + 1, label, base))
    found.make_automaton()
    return found


def scan(text: str) -> dict:
    """Findings in one text: words, base places, labels and how freely it may be used.

    ``score`` is the lowest freedom over notices and expressions; 1 without any.  Labels
    are sets and places all count, so ties have no order.  The time is linear in the text.
    """
    lower = text.translate(UPPER) if not text.isascii() else text.lower()
    words = WORD.findall(lower)
    line = " " + " ".join(words)
    places, base, labels, expressions, score = [], set(), set(), [], 1.0
    size, upto, begun, spans = len(line), 0, 0, None
    for end, (n, label, is_base) in automaton().iter(line):
        if end + 1 < size and line[end + 1] != " ":
            continue
        begun += line.count(" ", upto, end + 1)
        upto = end + 1
        first = begun - n
        if is_base:
            places.append(first)
            base.add(label)
        if label is not None:
            labels.add(label)
            score = min(score, freedom(label))
            continue
        if spans is None:
            spans = [m.end() for m in WORD.finditer(lower)]
        sign = ASSIGNED.match(lower, spans[begun - 1])
        postfix = to_postfix(lower, sign.end()) if sign else []
        if postfix:
            named, free = evaluate(postfix)
            labels |= named
            score = min(score, free)
            expressions.append(" ".join(postfix))
    return {"n_words": len(words), "places": places, "base_labels": sorted(base), "labels": sorted(labels), "expressions": expressions, "score": score}


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of findings for each document.

    A null or empty text has no words, no labels and score 1.  Rows are
    independent, so repeated rows repeat and an empty table stays empty.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, base_places array<bigint>, base_labels array<string>, labels array<string>, expressions array<string>, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_words", "base_places", "base_labels", "labels", "expressions", "score"]
        strings = pa.list_(pa.string())
        for batch in batches:
            got = [scan(t) for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array([g["n_words"] for g in got], pa.int64()), pa.array([g["places"] for g in got], pa.list_(pa.int64())),
                *(pa.array([g[c] for g in got], strings) for c in ("base_labels", "labels", "expressions")), pa.array([g["score"] for g in got], pa.float64()),
            ], names=names)

    return map_batches(df, [id_col, text_col], run, schema)
