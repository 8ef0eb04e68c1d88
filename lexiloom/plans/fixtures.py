"""Fixed parts of queries that dress documents up as wiki pages, Arabic texts or captions."""

from __future__ import annotations

#: What no markup consists of; everything else gives way to spaces before a text becomes a wiki page.
NO_MARKUP = r"[^\p{L}\p{N} .,]+"
#: A wiki page before its title, before its words and after them.
WIKI_PAGE = (
    "== ",
    " ==\n{{Infobox|a={{b|{{c}}}}|d=[[e]]}}'''bold''' [[Target|shown]]\n{|\n|-\n| {{x|}}\n{|\n| inner\n|}\n|}\n* ",
    '<ref name="x">[http://example.org cite {{y}}]</ref> [http://example.org site here]<!-- [[gone --> [[Plain]]\n\n\n\n;;end <br/>',
)

#: Latin letters and the Arabic ones, with short vowels among them, that stand for them in tables without Arabic.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñó", "ابثديفغهيجكلمنوصقرستوشوخةزأإآىَُِّئؤ"
DIALECTS = {"egy": ["تهته"], "glf": ["يرين"], "lev": ["تيون"]}

CAPTION_COLOURS = ["red", "grey", "olive", "brown", "green"]

DOMINANT = ["#e02020", "#e0e020", "#20a020", "#2020c0", "#c020c0", "#808080"]
