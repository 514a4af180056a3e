"""License scans with DataFrame functions alone.

Texts whose words hold none of a few gates are passed over; a gate is a stretch of
words that every match of its rules has, worked out from the patterns themselves.
For the others, each signature rule whose own keyword occurs is matched as a
regular expression on the text with single spaces, so that line ends do not
matter, and every match is a detection: an interval with the rule's label and priority.  Of
two detections one of which contains the other, the one of better priority
stays, of equal priority the longer, and of equal intervals the earlier rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as constants
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases: consecutive words, and their label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_V = r",? ?(?:version |v\.? ?)?"
# License names: label, keyword that must occur, signature of the name, and of its address or "".
NAMES = (
    ("mit", "mit", r"\bmit(?: / ?x11)? licen[cs]e", r"opensource\.org/licenses?/mit\b"),
    ("mit-0", "mit-0", r"\bmit-0\b", r"opensource\.org/licenses?/mit-0"),
    ("mit-0", "mit no attribution", r"\bmit no attribution\b", ""),
    ("x11", "x11", r"\bx11 licen[cs]e", ""),
    ("isc", "isc", r"\bisc licen[cs]e", r"opensource\.org/licenses?/isc"),
    ("apache-1.0", "apache", rf"\bapache(?: software)? licen[cs]e{_V}1\.0", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", "apache", rf"\bapache(?: software)? licen[cs]e{_V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", rf"\bapache(?: software)?(?: licen[cs]e)?{_V}2(?:\.0)?\b", r"apache\.org/licenses/license-2\.0"),
    ("bsd-2-clause", "bsd", r"\b(?:simplified|freebsd|2-clause|two-clause) bsd|\bbsd[ -](?:2|two)[ -]clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"\b(?:new|modified|revised|3-clause|three-clause) bsd|\bbsd[ -](?:3|three)[ -]clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"\b(?:original|4-clause|four-clause) bsd|\bbsd[ -](?:4|four)[ -]clause", ""),
    ("0bsd", "bsd", r"\b(?:zero-clause bsd|0bsd|bsd zero clause)", r"opensource\.org/licenses?/0bsd"),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[cs]e", r"opensource\.org/licenses?/bsd-license"),
    ("gpl-1.0", "gpl", rf"\bgpl{_V}1(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl", rf"\bgpl{_V}2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl", rf"\bgpl{_V}3(?:\.0)?\b", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-1.0", "general public", rf"\bgnu general public licen[cs]e{_V}1(?:\.0)?\b", ""),
    ("gpl-2.0", "general public", rf"\bgnu general public licen[cs]e{_V}2(?:\.0)?\b", ""),
    ("gpl-3.0", "general public", rf"\bgnu general public licen[cs]e{_V}3(?:\.0)?\b", r"gnu\.org/licenses/gpl\.(?:html|txt)"),
    ("lgpl-2.0", "library general public", rf"\blibrary general public licen[cs]e{_V}2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lesser general public", rf"\blesser general public licen[cs]e{_V}2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser general public", rf"\blesser general public licen[cs]e{_V}3(?:\.0)?\b", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lgpl", r"\blgpl\b", r"gnu\.org/(?:copyleft|licenses)/lgpl\.html"),
    ("agpl-3.0", "affero", rf"\baffero general public licen[cs]e{_V}3(?:\.0)?\b", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "agpl", r"\bagpl(?:v3)?\b", r"gnu\.org/licenses/agpl\.html"),
    ("gfdl", "free documentation", r"\bgnu free documentation licen[cs]e", r"gnu\.org/(?:copyleft|licenses)/fdl"),
    ("mpl-1.0", "mozilla", rf"\bmozilla public licen[cs]e{_V}1\.0", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", "mozilla", rf"\bmozilla public licen[cs]e{_V}1\.1", r"mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2.0", "mozilla", rf"\bmozilla public licen[cs]e{_V}2(?:\.0)?\b", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "eclipse", rf"\beclipse public licen[cs]e{_V}1(?:\.0)?\b", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", rf"\beclipse public licen[cs]e{_V}2(?:\.0)?\b", r"eclipse\.org/legal/epl-2\.0"),
    ("edl-1.0", "eclipse", r"\beclipse distribution licen[cs]e", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", "common development", rf"\bcommon development and distribution licen[cs]e{_V}1\.0", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cddl", "cddl", r"\bcddl\b", ""),
    ("cpl-1.0", "common public", r"\bcommon public licen[cs]e", r"opensource\.org/licenses?/cpl1\.0"),
    ("artistic-1.0", "artistic", rf"\bartistic licen[cs]e{_V}1\.0", r"opensource\.org/licenses?/artistic-license-1\.0"),
    ("artistic-2.0", "artistic", rf"\bartistic licen[cs]e{_V}2(?:\.0)?\b", r"opensource\.org/licenses?/artistic-(?:license-)?2\.0"),
    ("artistic", "artistic", r"\bartistic licen[cs]e", ""),
    ("bsl-1.0", "boost", r"\bboost software licen[cs]e", r"boost\.org/license_1_0\.txt"),
    ("busl-1.1", "business source", r"\bbusiness source licen[cs]e", r"mariadb\.com/bsl11"),
    ("elastic-2.0", "elastic", r"\belastic licen[cs]e", r"elastic\.co/licensing/elastic-license"),
    ("sspl-1.0", "server side public", r"\bserver side public licen[cs]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("unlicense", "unlicense", r"\bthe unlicense\b", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", r"wtfpl\.net"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]e", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", r"\blibpng licen[cs]e", ""),
    ("python-2.0", "python", r"\bpython (?:software foundation )?licen[cs]e", r"docs\.python\.org/[^ ]{0,200}license"),
    ("php-3.01", "php", rf"\bphp licen[cs]e(?:{_V}3\.01)?", r"php\.net/license"),
    ("ruby", "ruby", r"\bruby licen[cs]e", ""),
    ("openssl", "openssl", r"\bopenssl licen[cs]e", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", r"\bpostgresql licen[cs]e", r"postgresql\.org/about/licence"),
    ("ofl-1.1", "open font", rf"\b(?:sil )?open font licen[cs]e(?:{_V}1\.1)?", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"\bopen (?:data commons open )?database licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", r"\bopen data commons attribution licen[cs]e", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain dedication", r"\bpublic domain dedication and licen[cs]e", r"opendatacommons\.org/licenses/pddl"),
    ("ms-pl", "microsoft public", r"\bmicrosoft public licen[cs]e", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"\bmicrosoft reciprocal licen[cs]e", r"opensource\.org/licenses?/ms-rl"),
    ("afl-3.0", "academic free", r"\bacademic free licen[cs]e", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", "open software", rf"\bopen software licen[cs]e{_V}3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("eupl-1.2", "european union public", r"\beuropean union public licen[cs]e", r"eupl\.eu"),
    ("cecill-2.1", "cecill", r"\bcecill(?:-[bc])?\b", r"cecill\.info"),
    ("ncsa", "ncsa", r"\b(?:university of illinois/)?ncsa open source licen[cs]e", r"opensource\.org/licenses?/ncsa"),
    ("vim", "vim", r"\bvim licen[cs]e", ""),
    ("upl-1.0", "universal permissive", r"\buniversal permissive licen[cs]e", r"opensource\.org/licenses?/upl"),
    ("openrail", "openrail", r"\bopenrail(?:-m|\+\+)?\b", ""),
    ("llama", "llama", r"\bllama ?[23]?(?:\.\d)? community licen[cs]e", ""),
    ("cc0-1.0", "cc0", r"\bcc0(?: 1\.0)?\b", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b", r"creativecommons\.org/publicdomain/mark"),
)
# Creative Commons elements; with versions they give a family of rules.
CC_ELEMENTS = (("by", "attribution"), ("by-sa", "attribution[- ]share ?-?alike"), ("by-nd", "attribution[- ]no ?-?deriv(?:ative)?s?(?:[- ]works)?"), ("by-nc", "attribution[- ]non ?-?commercial"), ("by-nc-sa", "attribution[- ]non ?-?commercial[- ]share ?-?alike"), ("by-nc-nd", "attribution[- ]non ?-?commercial[- ]no ?-?deriv(?:ative)?s?(?:[- ]works)?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# SPDX identifiers that have no rule of their own above.
SPDX_ONLY = ("aal", "apsl-2.0", "apache-2.0-with-llvm-exception", "beerware", "bsd-1-clause", "bsd-3-clause-clear", "bsl-1.0", "cc-pddc", "cnri-python", "curl", "ecl-2.0", "efl-2.0", "ftl", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "hpnd", "icu", "ijg", "ipl-1.0", "lppl-1.3c", "miros", "mulanpsl-2.0", "naist-2003", "nposl-3.0", "ogl-uk-3.0", "ogtsl", "psf-2.0", "qpl-1.0", "sleepycat", "spl-1.0", "tcl", "unicode-dfs-2016", "w3c", "watcom-1.0", "wxwindows", "xnet", "zpl-2.1")
# Clauses of license bodies: label, keyword, signature, weight.
CLAUSES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("isc", "permission to use", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee", 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification", 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used", 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("zlib", "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty", 0.9),
    ("bsl-1.0", "machine-executable", r"machine-executable object code generated by a source language processor", 0.9),
    ("apache-2.0", "limitations under the license", r"see the license for the specific language governing permissions and limitations under the license", 0.85),
    ("gpl", "free software", r"this program is free software[:;,] you can redistribute it", 0.9),
    ("lgpl", "free software", r"this library is free software[:;,] you can redistribute it", 0.9),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "do what the", r"do what the [a-z*]+ you want to public licen[cs]e", 0.95),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts", 0.95),
    ("cc-by", "creative commons", r"creative commons attribution\b", 0.7),
    ("creative-commons", "creative commons", r"\bcreative commons licen[cs]e", 0.6),
    ("no-warranty", "warranty", r"without warranty of any kind", 0.3),
    ("no-redistribution", "reproduc", r"no part of this (?:publication|book|document|work) may be reproduced", 0.7),
    ("reserved", "reserved", r"\b(?:all|some|no) rights? reserved\b", 0.5),
    ("copyright", "copyright", r"\bcopyright (?:\(c\)|©) ?(?:19|20)\d\d", 0.4),
    ("copyright", "©", r"© ?(?:copyright )?(?:19|20)\d\d", 0.4),
    ("proprietary", "proprietary", r"\bproprietary and confidential\b", 0.7),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction) [^.]{0,60}?(?:strictly )?prohibited", 0.7),
    ("unknown-license", "licensed under", r"\blicensed under [^.\n]{2,60}", 0.3),
    ("unknown-license", "licence", r"\bunder (?:the|an?) [a-z0-9 .-]{2,40}? licence\b", 0.3),
)
#: Words, one stretch of which every match of a rule holds; a rule goes by the first that its pattern or keyword has.
GATES = ("spdx license identifier", "commons", "apache", "gnu org", "mozilla", "eclipse", "opensource", "licen", "bsd", "gpl", "cc by", "cc0", "mit 0", "mit no attribution", "public domain", "cddl", "copyright", "\u00a9", "reserved", "warranty", "permission", "redistribut", "proprietary", "unauthorized", "may be reproduced", "wtfpl", "cecill", "openrail", "eupl", "mariadb", "sil org", "opendatacommons", "invariant", "contributors", "advertising", "as is", "machine executable", "unencumbered", "limitations")
#: No match is longer than this many characters, so detections further apart cannot nest.
LONGEST = 1024


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # lower is better
    keyword: str
    pattern: str
    weight: float


def rules() -> list[Rule]:
    """The ordered signature rules, from the tables above and one pattern for each way of naming a license."""
    found: list[Rule] = []
    grant = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?(?:gnu )?"
    ids = dict.fromkeys([n[0] for n in NAMES] + [f"cc-{e}-{v}" for e, _ in CC_ELEMENTS for v in CC_VERSIONS] + list(SPDX_ONLY))
    found += [Rule(i, 1, i, rf"spdx-license-identifier: ?\(?{i.replace('.', '[.]')}(?![a-z0-9.-])", 0.99) for i in ids]
    for label, keyword, name, address in NAMES:
        if address:
            found.append(Rule(label, 2, address.split("\\")[0].split("(")[0].rstrip("/?"), rf"(?:https?://)?(?:www\.)?{address}", 0.95))
        bare = name.removeprefix(r"\b").replace("gnu ", "(?:gnu )?")
        found.append(Rule(label, 3, keyword, rf"{grant}(?:{bare})", 0.95))
        found.append(Rule(label, 5, keyword, name, 0.6))
    for element, words in CC_ELEMENTS:
        short = element.replace("-", "[- ]")
        for version in CC_VERSIONS:
            v, label = version.replace(".", "[.]"), f"cc-{element}-{version}"
            found.append(Rule(label, 2, "creativecommons", rf"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/{element}/{v}", 0.97))
            found.append(Rule(label, 3, "cc", rf"\bcc[- ]{short}[- ]{v}(?![0-9])", 0.9))
            found.append(Rule(label, 3, "creative commons", rf"creative commons {words}(?: international| unported| generic)?(?: licen[cs]e)?,? ?{v}(?![0-9])", 0.9))
        found.append(Rule(f"cc-{element}", 4, "cc", rf"\bcc[- ]{short}(?![a-z0-9-])", 0.7))
    found += [Rule(label, 9 if label == "unknown-license" else 6, keyword, pattern, weight) for label, keyword, pattern, weight in CLAUSES]
    return found


def in_words(text: str) -> str:
    """The text with single spaces for all stretches of ASCII that are neither letters nor digits."""
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text)


def _needed(nodes) -> list[str]:
    """Stretches of words that every match of a parsed pattern holds."""
    found, run = [], ""
    for kind, value in nodes:
        if kind is constants.LITERAL:
            run += chr(value)
        elif kind is constants.IN and all(k is constants.LITERAL and in_words(chr(c)) == " " for k, c in value):
            run += " "
        elif kind is not constants.AT:
            if kind is constants.SUBPATTERN or kind is constants.MAX_REPEAT and value[0] > 0:
                found += _needed(value[-1])
            found.append(run)
            run = ""
    return [in_words(x) for x in [*found, run] if x]


def gate_of(rule: Rule) -> str:
    """The first of GATES that the words of every text with a match of the rule hold."""
    sure = [in_words(rule.keyword), *_needed(parser.parse(rule.pattern))]
    return next(g for g in GATES if any(g in x for x in sure))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """The text with A to Z in lower case.

    Other letters may change case as well, which no phrase or signature can tell, but for the two
    letters whose lower case has ASCII in it: texts with those go letter by letter.
    """
    return F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _all_starts(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def here(word: Column, i: Column) -> Column:
        found = word == first
        for k, w in enumerate(rest, 1):
            found = found & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return F.when(found, i.cast("long"))

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


_DETECTION = "struct<priority: int, number: int, label: string, start: int, end: int, weight: double>"
#: Matches that are placed one after the other at a time, so that the cost of many does not grow with their square.
_AT_ONCE = 128


def _matches(text: Column, rule: Column) -> Column:
    """A detection for every match of the rule, with its interval in code points (none: null)."""

    def placed(sizes: Column) -> Column:
        """The matches of some (gap before, length), counted from zero, and where the last ends."""

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            found = F.struct(rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label"), start.alias("start"), (start + x["n"]).alias("end"), rule["weight"].alias("weight"))
            return F.struct((start + x["n"]).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

        return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_DETECTION}>)").alias("found")), step)

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["found"], lambda h: F.struct(h["priority"].alias("priority"), h["number"].alias("number"), h["label"].alias("label"), (h["start"] + by).alias("start"), (h["end"] + by).alias("end"), h["weight"].alias("weight")))

    def chained(blocks: Column) -> Column:
        def step(state: Column, block: Column) -> Column:
            return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["found"], F.array(moved(block, state["at"]))).alias("found"))

        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{_DETECTION}>>)").alias("found")), step, lambda state: F.flatten(state["found"]))

    def spans(hits: Column) -> Column:
        def sized(pieces: Column) -> Column:
            sizes = F.transform(hits, lambda h, k: F.struct(F.char_length(F.get(pieces, k)).alias("gap"), F.char_length(h).alias("n")))
            return _let(sizes, lambda s: chained(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _AT_ONCE).cast("int")), lambda b: placed(F.slice(s, b * _AT_ONCE + 1, F.lit(_AT_ONCE))))))

        return F.when(F.size(hits) > 0, _let(F.split(text, rule["pattern"], -1), sized))

    return _let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), spans)


def bounded(pattern: str) -> str:
    """The pattern with its word edges spelt out, since what \\b takes for a letter differs between Java's versions."""
    return re.sub(r"\\b(?=[0-9a-z(])", r"(?<![\\p{L}\\p{N}_])", pattern).replace(r"\b", r"(?![\p{L}\p{N}_])").replace(r"\d", "[0-9]")


_TABLE = "array<struct<gate: string, words: array<struct<keyword: string, rules: array<struct<number: int, label: string, priority: int, pattern: string, weight: double>>>>>>"


@lru_cache(maxsize=1)
def gates() -> dict[str, dict[str, list[dict]]]:
    """The rules by gate, then by keyword."""
    grouped: dict[str, dict[str, list[dict]]] = {}
    for n, r in enumerate(rules()):
        row = {"number": n, "label": r.label, "priority": r.priority, "pattern": bounded(r.pattern), "weight": r.weight}
        grouped.setdefault(gate_of(r), {}).setdefault(r.keyword, []).append(row)
    return grouped


def rule_table() -> Column:
    """The rules as a constant; read from one text, since a Column for each value takes the driver seconds."""
    table = [{"gate": gate, "words": [{"keyword": word, "rules": rows} for word, rows in words.items()]} for gate, words in gates().items()]
    return F.from_json(F.lit(json.dumps(table)), _TABLE)


def gated(words: Column) -> Column:
    """Whether any rule can match a text of these words."""
    found = F.lit(False)
    for word in gates():
        found = found | F.contains(words, F.lit(word))
    return found


def detections(text: Column, words: Column) -> Column:
    """The detections that stand, of a lower-case text with single spaces (null: none) and its words."""
    table = rule_table()

    def stand(near: Column, mine: Callable[[Column], Column]) -> Column:
        """Those of near that are mine and that no other of near beats."""

        def beaten(h: Column) -> Column:
            def by(g: Column) -> Column:
                inside = (g["start"] <= h["start"]) & (g["end"] >= h["end"])
                around = (h["start"] <= g["start"]) & (h["end"] >= g["end"])
                wider = (g["end"] - g["start"]) > (h["end"] - h["start"])
                first = (g["end"] - g["start"] == h["end"] - h["start"]) & (g["number"] < h["number"])
                return (inside | around) & ((g["priority"] < h["priority"]) | ((g["priority"] == h["priority"]) & (wider | first)))

            return F.exists(near, by)

        return F.filter(near, lambda h: mine(h) & ~beaten(h))

    def resolve(hits: Column) -> Column:
        place = lambda h: F.floor(h["start"] / LONGEST)
        stretches = F.array_distinct(F.transform(hits, place))
        return F.flatten(F.transform(stretches, lambda k: _let(F.filter(hits, lambda h: F.abs(place(h) - k) <= 1), lambda near: stand(near, lambda h: place(h) == k))))

    def scan(t: Column) -> Column:
        open_ = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["gate"])), lambda g: g["words"]))
        able = F.flatten(F.transform(F.filter(open_, lambda w: F.contains(t, w["keyword"])), lambda w: w["rules"]))
        hits = F.flatten(F.filter(F.transform(able, lambda r: _matches(t, r)), lambda m: m.isNotNull()))
        return _let(hits, resolve)

    return F.when(text.isNotNull(), _let(text, scan))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row.

    Null and empty texts have no words, no labels and score 0; very long texts are
    read whole, and detections are compared with their neighbours only; a null
    doc_id stays null; repeated rows are returned once each; other columns are not
    read; an empty table gives no rows.
    """
    lower = lower_ascii(F.coalesce("text", F.lit("")))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower.alias("lower"))
    words = words.withColumn("norm", F.concat(F.lit(" "), F.trim(F.regexp_replace("lower", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" ")))
    count = F.when(F.col("norm") == "  ", F.lit(0)).otherwise(F.octet_length("norm") - F.octet_length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) - 1)
    phrased = F.lit(False)
    for phrase, _ in PHRASES:
        phrased = phrased | F.contains("norm", F.lit(f" {phrase} "))
    flat = F.when(gated(F.col("norm")), F.regexp_replace("lower", r"\s+", " "))
    none = F.expr("cast(array() as array<array<bigint>>)")
    starts = F.when(phrased, _let(F.split(F.trim("norm"), " ", -1), lambda w: F.array(*[_all_starts(w, p) for p, _ in PHRASES]))).otherwise(none)
    read = words.select("doc_id", count.cast("long").alias("n_words"), starts.alias("starts"), detections(flat, F.col("norm")).alias("detections"))
    places = F.flatten("starts")
    base = F.filter(F.array(*[F.when(F.size(F.coalesce(F.get("starts", F.lit(k)), F.expr("cast(array() as array<bigint>)"))) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    found = F.coalesce("detections", F.expr(f"cast(array() as array<{_DETECTION}>)"))
    read = read.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), base.alias("base"), found.alias("detections"))
    doubt = F.aggregate("detections", F.lit(1.0), lambda d, h: d * (1 - h["weight"])) * F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(1.0))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda h: h["label"]))))
    return read.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (1 - doubt).alias("score"), "detections")
