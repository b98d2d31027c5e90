"""License scan: ordered signature rules behind a keyword filter.

A text becomes its words (A-Z lowered; runs of digits, small letters and non-ASCII characters), joined by one blank each. Rules are regular
expressions over that line, made from ``NAMES`` (how each license is written) and ``FORMS`` (the phrases a license is named in), and by hand in
``PASSAGES``. Every rule has gate words; a rule runs on texts that hold all its gate words, so most texts run none. What matches is a
detection, an interval of words. Forms are in order: of two detections where one lies within the other, that of the later form goes,
and of one form the shorter one, then the one whose rule comes later; names without a version come after all forms of names with one. The ``BASE`` phrases are found besides and are never suppressed.

``score`` is one minus the product, over the labels found, of one minus the confidence of the label's best form.

Long texts are read in parts, with the last ``OVERLAP`` words of the part before; no rule spans more words. Defined results: a null or empty text has
no words, no labels (empty strings), null places and score 0. An empty table gives an empty one, rows that repeat an id are scanned each by itself.
Other columns are passed on; those named like a result are replaced.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import let_go, release

PART = 1 << 20
OVERLAP = 64
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label: string, form: string, first: long, last: long, confidence: double>>"
)

# Phrases and labels that always count.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licenses as they are written, in words. A gate word stands in every way of writing.
NAMES: list[tuple[str, str, str]] = [
    # label, gate, pattern
    ("mit", "mit", r"mit|mit x11|x11 mit|expat mit"),
    ("mit-0", "mit", r"mit 0|mit no attribution"),
    ("x11", "x11", r"x11"),
    ("expat", "expat", r"expat"),
    ("isc", "isc", r"isc|internet systems consortium"),
    ("0bsd", "0bsd", r"0bsd|0bsd zero clause bsd"),
    ("bsd-1", "bsd", r"bsd 1 clause|(?:1|one) clause bsd"),
    ("bsd-2", "bsd", r"bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd bsd"),
    ("bsd-3", "bsd", r"bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd new"),
    ("bsd-4", "bsd", r"bsd 4 clause|(?:4|four) clause bsd|original bsd"),
    ("bsd", "bsd", r"bsd|bsd style|berkeley bsd"),
    ("apache-1", "apache", r"apache (?:software )?1 [01]|apache (?:software )?licen[cs]e (?:version |v )?1 [01]"),
    ("apache-2", "apache", r"apache 2(?: 0)?|apache v2(?: 0)?|apache (?:software )?licen[cs]e (?:version |v )?v?2(?: 0)?"),
    ("apache", "apache", r"apache|apache software"),
    ("artistic-1", "artistic", r"artistic (?:licen[cs]e )?1 0"),
    ("artistic-2", "artistic", r"artistic (?:licen[cs]e )?2 0"),
    ("mpl-1.1", "mpl", r"mpl 1 1|mpl v1 1"),
    ("mpl-2", "mpl", r"mpl 2 0|mpl v2(?: 0)?|mpl 2"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?v?1 1"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1", "epl", r"epl 1 0"),
    ("epl-2", "epl", r"epl 2 0"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v )?v?1 0"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v )?v?2 0"),
    ("edl", "eclipse", r"eclipse distribution(?: licen[cs]e)? (?:version |v )?v?1 0"),
    ("cddl-1", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1", "distribution", r"common development and distribution(?: licen[cs]e)?(?: 1 0)?"),
    ("cpl-1", "common", r"common public licen[cs]e(?: version)? 1 0"),
    ("eupl-1.1", "eupl", r"eupl (?:v )?v?1 1"),
    ("eupl-1.2", "eupl", r"eupl (?:v )?v?1 2"),
    ("eupl", "european", r"european union public"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: [12] [01])?"),
    ("osl-3", "osl", r"osl 3 0"),
    ("osl-3", "open", r"open software licen[cs]e (?:version |v )?v?3 0"),
    ("afl-3", "academic", r"academic free licen[cs]e (?:version |v )?v?3 0"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("bsl-1", "boost", r"boost software(?: licen[cs]e)?(?: version)?(?: 1 0)?|boost"),
    ("bsl-1", "bsl", r"bsl 1 0"),
    ("busl-1.1", "business", r"business source(?: licen[cs]e)?(?: 1 1)?"),
    ("sspl-1", "sspl", r"sspl(?: v1| 1 0)?"),
    ("sspl-1", "server", r"server side public(?: licen[cs]e)?(?: version 1)?"),
    ("elastic-2", "elastic", r"elastic(?: licen[cs]e)?(?: 2 0| v2)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v2| version 2)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("openssl", "openssl", r"openssl(?: ssleay)?"),
    ("php-3", "php", r"php(?: licen[cs]e)?(?: version)? 3 01?"),
    ("psf-2", "psf", r"psf(?: 2 0)?"),
    ("psf-2", "python", r"python software foundation"),
    ("ruby", "ruby", r"ruby"),
    ("perl", "perl", r"perl|perl 5"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"ncsa|university of illinois ncsa(?: open source)?"),
    ("upl-1", "universal", r"universal permissive(?: licen[cs]e)?(?: v1 0| 1 0)?"),
    ("vim", "vim", r"vim"),
    ("curl", "curl", r"curl"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font(?: licen[cs]e)?(?: version)?(?: 1 1)?"),
    ("odbl-1", "odbl", r"odbl(?: 1 0| v1 0)?"),
    ("odbl-1", "database", r"open database(?: licen[cs]e)?(?: v1 0)?"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl-1", "pddl", r"pddl(?: 1 0)?"),
    ("gfdl", "gfdl", r"gfdl(?: 1 [123])?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation(?: licen[cs]e)?(?: version)?(?: 1 [123])?"),
    ("proprietary", "proprietary", r"proprietary|proprietary software"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?"),
]

# GNU families times versions: (label, gate, short name, long name, versions).
GNU = [
    ("gpl", "gpl", "general", r"gpl", r"(?:gnu )?general public", ("1", "2", "3")),
    ("lgpl", "lgpl", "lesser", r"lgpl", r"(?:gnu )?lesser general public", ("2 1", "3")),
    ("lgpl", "lgpl", "library", r"lgpl", r"(?:gnu )?library general public", ("2",)),
    ("agpl", "agpl", "affero", r"agpl", r"(?:gnu )?affero general public", ("1", "3")),
]
# Creative Commons: every combination of its clauses times versions.
CC_CLAUSES = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Forms in order: name, extra gate, pattern around a name, confidence.
FORMS: list[tuple[str, str, str, float]] = [
    ("tag", "spdx", r"spdx licen[cs]e identifier (?:{name})", 0.99),
    ("grant", "license", r"(?:licensed|released|distributed|available|published|provided|covered|offered|used|redistributed|dual licensed) (?:to you )?(?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: (?:public )?licen[cs]e)?", 0.95),
    ("under", "license", r"under (?:the )?(?:terms of )?(?:the )?(?:{name}) (?:public )?licen[cs]e", 0.9),
    ("field", "license", r"licen[cs]e(?:d)? (?:is |type |name |declared |concluded )?(?:{name})", 0.8),
    ("name", "license", r"(?:{name}) (?:public )?licen[cs]e(?:d)?", 0.7),
]

# Passages of license texts and addresses.
PASSAGES: list[tuple[str, tuple[str, ...], str]] = [
    ("mit", ("permission", "granted"), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", ("permission", "purpose"), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", ("redistribution", "binary"), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", ("neither", "endorse"), r"neither the name of .{1,120}? may be used to endorse or promote products"),
    ("apache-2", ("apache", "compliance"), r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2", ("apache", "licenses"), r"apache org licenses license 2 0"),
    ("gpl", ("redistribute", "general"), r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", ("gnu", "licenses"), r"gnu org licenses(?: old licenses)?(?: gpl)?(?: [123] 0)?"),
    ("mpl-2", ("mozilla", "source"), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", ("mozilla", "mpl"), r"mozilla org (?:en us )?mpl 2 0"),
    ("unlicense", ("unencumbered", "public"), r"this is free and unencumbered software released into the public domain"),
    ("unlicense", ("unlicense", "org"), r"unlicense org"),
    ("zlib", ("express", "warranty"), r"this software is provided as is without any express or implied warranty"),
    ("wtfpl", ("everyone", "verbatim"), r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("public-domain", ("public", "domain"), r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain|public domain dedication"),
    ("cc0", ("cc0",), r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", ("publicdomain", "zero"), r"creativecommons org publicdomain zero 1 0"),
    ("all-rights-reserved", ("rights", "reserved"), r"all rights reserved"),
    ("beerware", ("beer", "license"), r"the beer ware license"),
]
_PASSAGE = 0.97

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that count as the gate word "license".
_SAME = {b"licence": b"license", b"licensed": b"license", b"licenced": b"license", b"licenses": b"license", b"licences": b"license"}


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    level: int
    gates: frozenset[bytes]
    pattern: re.Pattern[bytes]
    confidence: float

    @property
    def order(self) -> int:
        return _ORDER[id(self)]


def _versioned() -> list[tuple[str, str, str]]:
    """GNU and Creative Commons names, from their parameters."""
    found = []
    for label, short_gate, long_gate, short, long, versions in GNU:
        for version in versions:
            number, spoken = version.replace(" ", "."), version if " " in version else f"{version}(?: 0)?"
            for later, ending in (("-or-later", r"(?: or later| or any later version| plus)"), ("", r"(?: only)?")):
                found.append((f"{label}-{number}{later}", short_gate, rf"(?:gnu )?{short} ?(?:version |v )?v?{spoken}{ending}"))
                found.append((f"{label}-{number}{later}", long_gate, rf"{long} licen[cs]e ?(?:version |v )?v?{spoken}{ending}"))
        found.append((label, short_gate, rf"(?:gnu )?{short}"))
        found.append((label, long_gate, long))
    for clauses in CC_CLAUSES:
        label, short, long = "cc-" + "-".join(clauses), " ".join(clauses), " ".join(CC_WORDS[c] for c in clauses)
        for version in (*CC_VERSIONS, ""):
            tail = f" {version}" if version else ""
            found.append((label + ("-" + version.replace(" ", ".") if version else ""), "cc", f"cc {short}{tail}"))
            found.append((label + ("-" + version.replace(" ", ".") if version else ""), "creative", f"creative commons {long}{' (?:international )?(?:licen[cs]e )?' + version if version else ''}"))
    return found


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


def _rules() -> list[Rule]:
    names = NAMES + _versioned()
    found = [Rule(label, "passage", 1, frozenset(g.encode() for g in gates), _compiled(pattern), _PASSAGE) for label, gates, pattern in PASSAGES]
    for level, (form, gate, around, confidence) in enumerate(FORMS):
        for label, own, pattern in names:
            found.append(Rule(label, form, level + (level > 0), frozenset({gate.encode(), own.encode()}), _compiled(around.format(name=pattern)), confidence))
    # Names that can't be taken for an ordinary word stand for themselves, last of all.
    for label, own, pattern in names:
        if " " in pattern and (own in ("cc", "creative") or any(c.isdigit() for c in label)):
            found.append(Rule(label, "bare", len(FORMS) + 1, frozenset({own.encode()}), _compiled(pattern), 0.5))
    labels = {label for label, _, _ in names}
    general = {label for label in labels if any(other.startswith(label + "-") for other in labels)}
    # A name without its version or ending comes after all that have one.
    return sorted((replace(r, level=r.level + 100 * (r.label in general)) for r in found), key=lambda r: r.level)


RULES = _rules()
_ORDER = {id(rule): i for i, rule in enumerate(RULES)}
_BASE = [(label, phrase.split()[-1].encode(), _compiled(phrase)) for phrase, label in BASE.items()]
_GATED: dict[bytes, list[Rule]] = {}
for _rule in RULES:
    _GATED.setdefault(min(_rule.gates - {b"license", b"spdx"} or _rule.gates), []).append(_rule)
_KEYWORDS = frozenset().union(*(r.gates for r in RULES)) | _SAME.keys() | {gate for _, gate, _ in _BASE}


def _parts(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, at most about PART bytes of it at a time; no word is cut."""
    raw = (text or "").encode("utf-8", "replace").translate(_LOWERED)
    at = 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):
            last = _WORD.match(raw, end)
            end = last.end() if last else end
        yield _WORD.findall(raw, at, end)
        at = end


def _suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (level, first, end, rule): those within no interval of an earlier level, nor within a longer or earlier one of their own."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    reach: list[int] = []
    for level in sorted({d[0] for d in found}):
        most = -1
        for d in sorted((d for d in found if d[0] == level), key=lambda d: (d[1], -d[2], d[3])):
            before = bisect.bisect_right(starts, d[1])
            if most < d[2] and not (before and reach[before - 1] >= d[2]):
                kept.append(d)
            most = max(most, d[2])
        kept.sort(key=lambda d: d[1])
        starts, reach, most = [d[1] for d in kept], [], -1
        for d in kept:
            most = max(most, d[2])
            reach.append(most)
    return kept


def scan_text(text: str | None) -> tuple:
    """A row of RESULT."""
    n_words, base, found = 0, [], []
    tail: list[bytes] = []
    tail_hits: frozenset[bytes] = frozenset()
    for words in _parts(text):
        own_hits = _KEYWORDS.intersection(words)
        hits = own_hits | tail_hits
        if hits:
            hits |= {_SAME[h] for h in hits & _SAME.keys()}
            line, offset = b" ".join([*tail, *words]), n_words - len(tail)
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)

            def matches(pattern: re.Pattern[bytes]) -> Iterator[tuple[int, int]]:
                for m in pattern.finditer(line):
                    first, end = (np.searchsorted(blanks, m.span()) + offset).tolist()
                    if end >= n_words:  # others were found with the part before
                        yield first, end + 1

            for label, gate, pattern in _BASE:
                if gate in hits:
                    base += [(first, label) for first, _ in matches(pattern)]
            for gate in hits & _GATED.keys():
                for rule in _GATED[gate]:
                    if rule.gates <= hits:
                        found += [(rule.level, first, end, rule.order) for first, end in matches(rule.pattern)]
        n_words += len(words)
        tail = [*tail, *words][-OVERLAP:]
        tail_hits = _KEYWORDS.intersection(tail)
    kept = sorted(_suppressed(found), key=lambda d: (d[1], d[2]))
    shown = [(RULES[r].label, RULES[r].form, first, end - 1, RULES[r].confidence) for _, first, end, r in kept]
    sure = {label: 0.9 for _, label in base}
    for label, _, _, _, confidence in shown:
        sure[label] = max(sure.get(label, 0.0), confidence)
    doubt = 1.0
    for label in sorted(sure):
        doubt *= 1 - sure[label]
    places = [first for first, _ in base]
    return n_words, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(sure)), 1 - doubt if sure else 0.0, shown


def scan(docs: DataFrame, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (all by default) and those of RESULT."""
    names = [field.split()[0] for field in RESULT.split(", ")[:8]]

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            rows = pd.DataFrame([scan_text(t) for t in batch], columns=names, dtype=object)
            yield rows.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})
        release()

    keep = [c for c in (passing if passing is not None else docs.columns) if c not in names]
    return docs.select(*keep, found(F.col(text).cast("string")).alias("_found")).select(*keep, *[F.col(f"_found.{n}").alias(n) for n in names])
